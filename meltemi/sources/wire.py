"""JSON events: parse, conform to a feed's schema, route, quarantine. Works on batch and stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltemi.sources.schemas import FEED_OF_STREAM, FEEDS, Feed

BAD = "_corrupt_record"


def as_wire(df: DataFrame, value: str = "value") -> DataFrame:
    """Rows as JSON text, one event per row, timestamps in ISO form."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"timestampFormat": iso + "XXX", "timestampNTZFormat": iso}
    return df.select(F.to_json(F.struct(*df.columns), options).alias(value))


def _wire_schema(feeds: Mapping[str, Feed]) -> T.StructType:
    """Columns of all feeds by name, times as text, and a column for text that does not parse."""
    fields: dict[str, T.StructField] = {}
    for feed in feeds.values():
        for f in feed.schema:
            fields.setdefault(f.name, T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType))
    return T.StructType([*fields.values(), T.StructField(BAD, T.StringType())])


def typed(raw: DataFrame, feeds: Mapping[str, Feed] = FEEDS, value: str = "value") -> DataFrame:
    """Text to columns by name, in one parse for all feeds: a missing path is NULL, unknown fields are dropped.

    The time column travels as ISO text with an offset and is cast here. The parse sits behind a
    generator, so neither the routes' filters nor their projections repeat it.
    """
    schema = _wire_schema(feeds)
    parsed = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    rows = raw.select(F.col(value).alias("_raw"), F.inline(F.array(parsed)))
    times = {f.name for feed in feeds.values() for f in feed.schema if isinstance(f.dataType, T.TimestampType)}
    return rows.select(*[F.expr(f"try_cast(`{c}` AS timestamp)").alias(c) if c in times else F.col(c) for c in rows.columns])


def _sound() -> Column:
    return F.col(BAD).isNull() & F.col("timestamp").isNotNull()


def feed_rows(rows: DataFrame, feed: Feed) -> DataFrame:
    """One feed's well-formed events out of the typed rows, by equality on the discriminator."""
    return rows.where((F.col("stream_type") == feed.stream_type) & _sound()).select(*feed.schema.names)


def parsed_feed(raw: DataFrame, feed: Feed, value: str = "value") -> DataFrame:
    """One feed's events straight from the text. Lines that cannot name the feed are skipped before the parse."""
    text = F.col(value)
    maybe = text.contains(feed.stream_type) | text.contains("\\u")
    return feed_rows(typed(raw.where(maybe), {feed.stream_type: feed}, value), feed)


def routes(rows: DataFrame, feeds: Mapping[str, Feed] = FEEDS) -> dict[str, DataFrame]:
    """One DataFrame per feed from the typed rows."""
    return {name: feed_rows(rows, feed) for name, feed in feeds.items()}


def quarantine(rows: DataFrame, feeds: Mapping[str, Feed] = FEEDS) -> DataFrame:
    """Every typed row the routes leave out: text, stream_type, reason."""
    known = F.coalesce(F.col("stream_type").isin(*[feed.stream_type for feed in feeds.values()]), F.lit(False))
    reason = (
        F.when(F.col("stream_type").isNull(), "malformed")
        .when(~known, "unknown stream_type")
        .otherwise("does not fit the schema")
    )
    return rows.where(~(known & _sound())).select(F.col("_raw").alias("raw"), "stream_type", reason.alias("reason"))


def merged(*parts: DataFrame) -> DataFrame:
    """Union by name; columns one side lacks are NULL there (schema merge)."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def feed_of(stream_type: str) -> Feed:
    return FEEDS[FEED_OF_STREAM[stream_type]]
