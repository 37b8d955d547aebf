"""The ontology as nodes and edges: edge tables, slices, referential quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.operators.entities import Entity, Ontology, Tables
from meltemi.session import shared_dir


def edges(tables: Tables, ontology: Ontology, relationships: Sequence[str] | None = None) -> DataFrame:
    """(src_type, src_id, rel, dst_type, dst_id), one row per non-null foreign key."""
    out: DataFrame | None = None
    for name in relationships or list(ontology.relationships):
        rel = ontology.relationships[name]
        source = ontology.entities[rel.source]
        part = tables[source.table].where(F.col(rel.fk).isNotNull()).select(
            F.lit(rel.source).alias("src_type"),
            F.col(source.key).cast("string").alias("src_id"),
            F.lit(name).alias("rel"),
            F.lit(rel.target).alias("dst_type"),
            F.col(rel.fk).cast("string").alias("dst_id"),
        )
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def nodes(tables: Tables, ontology: Ontology, types: Sequence[str] | None = None) -> DataFrame:
    """(type, id) of every instance of the chosen entity types."""
    out: DataFrame | None = None
    for name in types or list(ontology.entities):
        entity = ontology.entities[name]
        part = tables[entity.table].select(F.lit(name).alias("type"), F.col(entity.key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def endpoints(edge_rows: DataFrame) -> DataFrame:
    """Distinct nodes that an edge set touches."""
    src = edge_rows.select(F.col("src_type").alias("type"), F.col("src_id").alias("id"))
    dst = edge_rows.select(F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))
    return src.unionByName(dst).distinct()


def subgraph(
    tables: Tables, ontology: Ontology, relationships: Sequence[str], *, seeds: DataFrame | None = None, hops: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a slice: the chosen relationships, or only their edges within ``hops`` of ``seeds`` (type, id)."""
    all_edges = edges(tables, ontology, relationships)
    if seeds is None:
        return endpoints(all_edges), all_edges
    spark, folder = all_edges.sparkSession, shared_dir(all_edges.sparkSession, "hops")
    # Every hop's nodes and edges are written once; a hop reads what is new, and the end reads all hops' folders as one table.
    reached, found = f"{folder}/nodes", f"{folder}/edges"
    start = seeds.select("type", F.col("id").cast("string").alias("id")).distinct()
    for hop in range(hops):
        start.write.parquet(f"{reached}/hop={hop}")
        frontier = spark.read.schema(start.schema).parquet(f"{reached}/hop={hop}")
        # Only nodes that the last hop reached first look for edges.
        source = frontier.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"))
        target = frontier.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"))
        outgoing = all_edges.join(source, ["src_type", "src_id"], "left_semi").select(*all_edges.columns)
        incoming = all_edges.join(target, ["dst_type", "dst_id"], "left_semi").select(*all_edges.columns)
        outgoing.unionByName(incoming).distinct().write.parquet(f"{found}/hop={hop}")
        new = spark.read.schema(all_edges.schema).parquet(f"{found}/hop={hop}")
        visited = spark.read.schema(start.schema).parquet(reached).select("type", "id")
        start = endpoints(new).join(visited, ["type", "id"], "left_anti")
    chosen = spark.read.schema(all_edges.schema).parquet(found).select(*all_edges.columns).distinct() if hops > 0 else all_edges
    return endpoints(chosen), chosen


def dangling(tables: Tables, ontology: Ontology, relationships: Sequence[str] | None = None) -> DataFrame:
    """Edges whose target does not exist.

    Foreign keys are reduced to distinct values before they are looked up; a table is only read again for the
    keys found missing.
    """
    out: DataFrame | None = None
    for name in relationships or list(ontology.relationships):
        rel = ontology.relationships[name]
        source, target = ontology.entities[rel.source], ontology.entities[rel.target]
        known = tables[target.table].select(F.col(target.key).alias("_fk"))
        used = tables[source.table].where(F.col(rel.fk).isNotNull()).select(F.col(rel.fk).alias("_fk")).distinct()
        missing = used.join(known, "_fk", "left_anti")
        rows = tables[source.table].select(F.col(source.key).alias("_id"), F.col(rel.fk).alias("_fk")).join(missing, "_fk", "left_semi")
        part = rows.select(
            F.lit(rel.source).alias("src_type"),
            F.col("_id").cast("string").alias("src_id"),
            F.lit(name).alias("rel"),
            F.lit(rel.target).alias("dst_type"),
            F.col("_fk").cast("string").alias("dst_id"),
        )
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def isolated(tables: Tables, ontology: Ontology, relationships: Sequence[str] | None = None) -> DataFrame:
    """Nodes of the types the relationships connect that no such edge touches.

    A node's own foreign keys are in its row, so only unconnected rows are looked up among the keys pointing at them.
    """
    rels = [ontology.relationships[n] for n in relationships or list(ontology.relationships)]
    out: DataFrame | None = None
    for name in sorted({end for r in rels for end in (r.source, r.target)}):
        entity = ontology.entities[name]
        lone = tables[entity.table]
        for r in rels:
            if r.source == name:
                lone = lone.where(F.col(r.fk).isNull())
        ids = lone.select(F.col(entity.key).alias("_id"))
        for r in rels:
            if r.target == name:
                source = ontology.entities[r.source]
                pointed = tables[source.table].where(F.col(r.fk).isNotNull()).select(F.col(r.fk).alias("_id")).distinct()
                ids = ids.join(pointed, "_id", "left_anti")
        part = ids.select(F.lit(name).alias("type"), F.col("_id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def unknown_reporters(tables: Tables, entity: Entity) -> DataFrame:
    """Telemetry keys without a static row, with their number of events."""
    live = entity.live
    assert live is not None
    seen = tables[live.table].groupBy(live.key).agg(F.count("*").alias("events"))
    return seen.join(tables[entity.table].select(F.col(entity.key).alias(live.key)), live.key, "left_anti")


def grid_disagreement(tables: Tables) -> DataFrame:
    """Plants whose own grid zone differs from the grid of a substation they feed."""
    via = tables["substations"].where(F.col("fed_by_plant_id").isNotNull()).select(
        F.col("fed_by_plant_id").alias("plant_id"), F.col("connected_grid_id").alias("substation_grid"), "substation_id"
    )
    joined = tables["power_plants"].select("plant_id", "grid_zone").join(via, "plant_id")
    return joined.where(F.col("grid_zone") != F.col("substation_grid"))


def capacity_mismatch(tables: Tables, *, tolerance_mw: float = 0.05) -> DataFrame:
    """Wind farms whose stated capacity differs from the sum over their turbines."""
    fleet = tables["wind_turbines"].groupBy("plant_id").agg(F.sum("capacity_mw").alias("turbines_mw"), F.count("*").alias("turbines"))
    farms = tables["power_plants"].where(F.col("plant_type") == "Wind Farm").select("plant_id", F.col("capacity_mw").alias("stated_mw"))
    joined = farms.join(fleet, "plant_id", "left")
    return joined.where(F.abs(F.col("stated_mw") - F.coalesce("turbines_mw", F.lit(0.0))) > tolerance_mw)
