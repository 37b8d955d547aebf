"""Entities: a static table, optionally with the latest values of a telemetry feed; and relationships between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.functions.clock import Clock, within
from meltemi.operators.latest import latest

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class LiveBinding:
    """Telemetry columns exposed as properties: source column -> property name."""

    table: str
    key: str
    props: Mapping[str, str]
    ts: str = "timestamp"


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    key: str
    live: LiveBinding | None = None


@dataclass(frozen=True)
class Relationship:
    """``source`` rows point at ``target`` through a foreign key of the source's table."""

    name: str
    source: str
    target: str
    fk: str


@dataclass(frozen=True)
class Ontology:
    entities: Mapping[str, Entity] = field(default_factory=dict)
    relationships: Mapping[str, Relationship] = field(default_factory=dict)


def live_values(tables: Tables, binding: LiveBinding, *, clock: Clock | None = None, span: str | None = None, props: Sequence[str] | None = None) -> DataFrame:
    """Key, ``live_time`` and ``live_<property>`` of each asset's newest report, over all time or within a lookback."""
    wanted = {src: prop for src, prop in binding.props.items() if props is None or prop in props}
    events = tables[binding.table]
    if clock is not None and span is not None:
        events = within(events, clock, span, ts=binding.ts)
    newest = latest(events, binding.key, ts=binding.ts, cols=list(wanted))
    return newest.select(binding.key, F.col(binding.ts).alias("live_time"), *[F.col(src).alias(f"live_{prop}") for src, prop in wanted.items()])


def entity_view(
    tables: Tables,
    entity: Entity,
    *,
    clock: Clock | None = None,
    span: str | None = None,
    recent: str | None = None,
    props: Sequence[str] | None = None,
) -> DataFrame:
    """Static rows with their latest live values; silent assets stay listed with NULLs.

    ``span`` limits what counts as live. ``recent`` does not: it names a stretch (such as "1 day") to look at first, so that
    older events are read only for the assets that did not report in it.
    """
    static = tables[entity.table]
    if entity.live is None:
        return static
    if clock is not None and recent is not None and span is None:
        live = _newest_part_first(tables, entity, clock, recent, props)
    else:
        live = live_values(tables, entity.live, clock=clock, span=span, props=props)
    if entity.live.key != entity.key:
        live = live.withColumnRenamed(entity.live.key, entity.key)
    return static.join(live, entity.key, "left")


def _newest_part_first(tables: Tables, entity: Entity, clock: Clock, recent: str, props: Sequence[str] | None) -> DataFrame:
    """Latest values per asset of the static table: from the recent events, and from older ones for those missing there.

    One plan whatever the number of missing assets: older events meet their keys in a semi-join, which Spark broadcasts where it has measured
    them to be small.
    """
    live = entity.live
    assert live is not None
    at = Clock(clock.as_of, {"recent": recent})
    found = live_values(tables, live, clock=at, span="recent", props=props)
    keys = tables[entity.table].select(F.col(entity.key).alias(live.key)).distinct()
    missing = keys.join(found.select(live.key), live.key, "left_anti")
    events = tables[live.table]
    older = events.where(F.col(live.ts) <= at.back("recent")).join(missing, live.key, "left_semi")
    return found.unionByName(live_values({live.table: older}, live, props=props))


def follow(
    df: DataFrame,
    tables: Tables,
    ontology: Ontology,
    relationship: str,
    *,
    cols: Mapping[str, str],
    reverse: bool = False,
    on: str | None = None,
    how: str = "inner",
) -> DataFrame:
    """One hop: rows of ``df`` joined to the entity at the other end, with ``cols`` (source column -> name) added.

    Forward hops match the foreign key ``on`` (default: the relationship's) with the target's
    key. Reverse hops match the target key held in ``on`` with the foreign key of the source's table.
    """
    rel = ontology.relationships[relationship]
    source, target = ontology.entities[rel.source], ontology.entities[rel.target]
    far, far_key, near = (source, rel.fk, on or target.key) if reverse else (target, target.key, on or rel.fk)
    other = tables[far.table].select(F.col(far_key).alias("_far"), *[F.col(c).alias(n) for c, n in cols.items()])
    return df.join(other, df[near] == other["_far"], how).drop("_far")
