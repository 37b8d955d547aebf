"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltemi.llm.frames import settled

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block.
BLOCK = 256
#: Slots take the multiples of the golden ratio's fraction, as whole numbers modulo 2^31 (the multiplier is odd, so no point repeats before all have come).
CIRCLE, GOLDEN = 1 << 31, 1_327_217_885
#: Cells that the circle is cut into to find a point's source by an equality join.
CELLS = 4096
#: A slot number's lower digits: 4,096 slots a cell, 1,024 cells a stretch.
LOW, MID = 4096, 1024


@dataclass(frozen=True)
class Mix:
    """``documents`` (key, source, src, size, start; one row per document), ``sources`` (their targets) and ``slots`` (slot, src, epoch, block, words)."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block: int


def sizes(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """Rows (``key``, ``source``, ``size``): words of every whole text; a null text has none."""
    return docs.select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3) -> DataFrame:
    """One row per source: ``src`` (its place in code point order, null last), ``weight`` (the weights in turn), ``source_size``, ``target``.

    The sources share the sum of all sizes by weight. A target stops at ``repeats`` times its source's size; what it leaves is shared again by weight among the others, until none is
    above. That is the level at which all uncapped targets per weight are equal: sources ordered by size per weight are capped as long as the level without them lies above their own.
    The windows see one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), F.col("src") % len(weights)).cast("decimal(38,0)")).withColumn(
        "cap", (F.col("source_size") * repeats).cast("decimal(38,0)")
    )
    by_room = Window.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), "src")
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    judged = weighed.withColumn("capped", left.cast("double") * F.col("weight").cast("double") > F.col("cap").cast("double") * others.cast("double"))
    # Where the two products round apart the level equals the cap, and either way gives the same target.
    free = F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    shared = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    level = free.cast("double") / shared.cast("double")
    return judged.select(
        "src",
        "source",
        F.col("weight").cast("bigint").alias("weight"),
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight").cast("double")).alias("target"),
    )


def _running(rows: DataFrame, group: str, high: str, low: str, value: str) -> DataFrame:
    """For every (group, high, low) the sum of ``value`` in the cells before it, as ``before``. No window sees more rows than one digit has values, so a hot group is many small ones."""
    cells = rows.groupBy(group, high, low).agg(F.sum(value).alias("cell"))
    stretches = cells.groupBy(group, high).agg(F.sum("cell").alias("stretch"))
    upto = (Window.unboundedPreceding, -1)
    over = stretches.select(group, high, F.coalesce(F.sum("stretch").over(Window.partitionBy(group).orderBy(high).rowsBetween(*upto)), F.lit(0)).alias("over"))
    within = cells.select(group, high, low, F.coalesce(F.sum("cell").over(Window.partitionBy(group, high).orderBy(low).rowsBetween(*upto)), F.lit(0)).alias("within"))
    return within.join(over, [group, high]).select(group, high, low, (F.col("over") + F.col("within")).alias("before"))


def shuffled(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document's first word in its source's shuffled stream, as ``start``; ``row`` numbers the documents of a cell of the order.

    The order is that of the md5 digest of the key. Its first two bytes are the digits by which running sums are split, so a source with a third of all rows is ordered in 65,536 cells.
    """
    digest = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    named = sized.join(sources.select("src", F.col("source").alias("_s")), F.col("source").eqNullSafe(F.col("_s")))
    rows = named.select("key", "source", "src", "size", digest.alias("digest"), F.substring(digest, 1, 2).alias("d1"), F.substring(digest, 3, 2).alias("d2"))
    before = _running(rows, "src", "d1", "d2", "size")
    cell = Window.partitionBy("src", "d1", "d2").orderBy("digest", "key", "size")
    inside = F.coalesce(F.sum("size").over(cell.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.select("*", inside.alias("inside"), F.row_number().over(cell).alias("row"))
    return numbered.join(before, ["src", "d1", "d2"]).select("key", "source", "src", "size", "d1", "d2", "row", (F.col("before") + F.col("inside")).alias("start"))


def schedule(spark: SparkSession, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (``slot``, ``src``, ``epoch``, ``block``, ``words``): which block of which source a slot takes, and how many of its first words.

    A source needs ``slots`` slots to take its target's whole words: all blocks of a full epoch, the rest's blocks of the last one, whose last block is cut short. As many points as
    all sources need slots are mapped through the cumulative needs; the r-th slot of a source takes its r-th block, epoch after epoch. What the points give a source beyond its need is
    left out, and slots that they still owe it come last; either is a handful, since the points are spread so evenly.
    """
    quota = F.floor("target").cast("bigint")
    needs = (
        sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
        .withColumn("full", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0))
        .withColumn("rest", quota - F.col("full") * F.col("source_size"))
        .withColumn("need", F.col("full") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("bigint"))
    )
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needs = needs.withColumn("upto", F.sum("need").over(upto)).withColumn("total", F.sum("need").over(Window.partitionBy()))
    needs = settled(needs.select("src", "source_size", "blocks", "full", "rest", "need", "upto", "total"), "mix-needs")
    total = needs.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n")).first()["n"]

    share = needs.where("need > 0").select("src", ((F.col("upto") - F.col("need")) / F.col("total")).alias("a"), (F.col("upto") / F.col("total")).alias("b"))
    last = F.least(F.floor(F.col("b") * CELLS), F.lit(CELLS - 1))
    arcs = share.select("src", "a", "b", F.explode(F.sequence(F.floor(F.col("a") * CELLS), last)).alias("cell"))
    point = F.col("x") / F.lit(CIRCLE)
    points = spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % CIRCLE) * GOLDEN % CIRCLE).alias("x"))
    placed = points.select("slot", point.alias("p"), F.floor(point * CELLS).alias("cell")).join(arcs, "cell").where("p >= a and p < b")
    rows = placed.select("src", "slot", F.expr(f"slot div {LOW * MID}").alias("d1"), F.expr(f"slot div {LOW} % {MID}").alias("d2"), F.lit(1).cast("bigint").alias("one"))
    before = _running(rows, "src", "d1", "d2", "one")
    inside = F.row_number().over(Window.partitionBy("src", "d1", "d2").orderBy("slot")) - 1
    ranked = rows.select("*", inside.alias("inside")).join(before, ["src", "d1", "d2"]).select("src", "slot", (F.col("before") + F.col("inside")).alias("rank"))

    had = rows.groupBy("src").agg(F.count("*").alias("had"))
    short = needs.join(had, "src", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("need > had")
    behind = F.coalesce(F.sum(F.col("need") - F.col("had")).over(Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    owed = short.select("src", "had", "total", behind.alias("behind"), F.explode(F.expr("sequence(had, need - 1)")).alias("rank"))
    owed = owed.select("src", (F.col("total") + F.col("behind") + F.col("rank") - F.col("had")).alias("slot"), "rank")

    turns = ranked.unionByName(owed).join(needs, "src").where("rank < need")
    turns = turns.select("slot", "src", F.expr("rank div blocks").alias("epoch"), F.expr("rank % blocks").alias("block"), "source_size", "full", "rest")
    length = F.least(F.lit(block), F.when(F.col("epoch") < F.col("full"), F.col("source_size")).otherwise(F.col("rest")) - F.col("block") * block)
    return turns.select("slot", "src", "epoch", "block", length.cast("bigint").alias("words"))


def plan(
    docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block: int = BLOCK
) -> Mix:
    """The mix of all documents. Sizes, targets and order are written to the shared folder, so the texts are read once and every later step sees the same rows."""
    spark = docs.sparkSession
    sized = settled(sizes(docs, key, source, text), "mix-sizes")
    sources = settled(targets(sized, weights, repeats), "mix-targets")
    return Mix(settled(shuffled(sized, sources), "mix-order"), sources, schedule(spark, sources, block), block)


def pieces(mix: Mix) -> DataFrame:
    """Rows (key, src, d1, d2, row, ``block``, ``first``, ``words``): the parts of every document that lie in one block; a document without words has none."""
    last = F.expr(f"(start + size - 1) div {mix.block}")
    spread = mix.documents.where("size > 0").select("*", F.explode(F.sequence(F.expr(f"start div {mix.block}"), last)).alias("block"))
    begin = F.col("block") * mix.block
    first = F.greatest(F.col("start"), begin)
    return spread.select("key", "src", "d1", "d2", "row", "start", "block", (first - begin).alias("first"), (F.least(F.col("start") + F.col("size"), begin + mix.block) - first).alias("words"))


def mixture(mix: Mix) -> DataFrame:
    """Rows (``slot``, ``at``, key, ``src``, ``epoch``, ``from_word``, ``n_words``): the mixed stream in the order of (slot, at). Blocks meet their slots by (source, block): even keys."""
    taken = mix.slots.withColumnRenamed("words", "limit")
    words = F.least(F.col("words"), F.col("limit") - F.col("first"))
    met = pieces(mix).join(taken, ["src", "block"]).where("limit > first")
    from_word = F.greatest(F.col("block") * mix.block - F.col("start"), F.lit(0))
    return met.select("slot", F.col("first").alias("at"), "key", "src", "d1", "d2", "row", "epoch", from_word.alias("from_word"), words.alias("n_words"))


def mix_sources(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), repeats: int = 3, block: int = BLOCK) -> DataFrame:
    """Rows (key, ``size``, ``source_size``, ``target``, ``taken``): how many words the mix takes of every document, repeats counted.

    A source's taken words add up to the whole words of its target, and no document gives more than ``repeats`` times its size. Every document keeps its row: a null or empty
    text has size 0 and gives nothing; a null source is a source, the last one; a null key is shuffled like an empty one; rows of equal key, source and size are separate documents
    that may stand for each other. An empty table gives no rows. Only the three named columns are read, so other columns may have any name.
    """
    mix = plan(docs, key=key, source=source, text=text, weights=weights, repeats=repeats, block=block)
    place = ["src", "d1", "d2", "row"]
    taken = mixture(mix).groupBy(*place).agg(F.sum("n_words").alias("taken"))
    out = mix.documents.join(taken, place, "left").join(mix.sources.select("src", "source_size", "target"), "src")
    return out.select(F.col("key").alias(key), "size", "source_size", "target", _or_zero("taken").alias("taken"))


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("bigint")


#: The same totals in closed form: a source's stream is taken from its start, whole epochs first.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY source
), weighed AS (
  SELECT *, 1 + src % 3 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM per
), judged AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
    > cap * sum(weight) OVER (ORDER BY cap::DOUBLE / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM weighed
), aimed AS (
  SELECT src, source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE
    (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE * weight END AS target FROM judged
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, floor(a.target)::BIGINT AS quota,
    coalesce(sum(s.size) OVER (PARTITION BY a.src ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - start)) END::BIGINT AS taken
FROM placed
"""
