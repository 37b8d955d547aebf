"""Line deduplication by content-defined chunks of lines, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltemi.session import settled

#: A chunk ends after a line whose rolling hash is divisible by this: so many lines a chunk on average.
EVERY = 3
#: Lines under the rolling hash, and its multiplier and modulus.
WINDOW, FACTOR, MODULUS = 3, 1_000_003, 2_147_483_647


def line_hash(line: Column) -> Column:
    """28 bits of the line's digest."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def rolling(hashes: Column, i: Column) -> Column:
    """Polynomial hash of a line and the lines before it; lines before the first count as 0."""
    total = F.lit(0).cast("bigint")
    for back in reversed(range(WINDOW)):
        one = F.coalesce(F.when(i >= back, F.get(hashes, (i - back).cast("int"))), F.lit(0))
        total = (total * FACTOR + one) % MODULUS
    return total


def with_lines(docs: DataFrame, text: str, paired: bool = False) -> DataFrame:
    """``docs`` with ``_lines`` and ``_ends``: the numbers of the lines that end a chunk, the last line always among them.

    With ``paired`` no chunk is one line, unless the text is: the hash ends none at the first line, at the last but one, or right behind a line where it says so too.
    """
    lined = docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
    hashed = lined.withColumn("_hashes", F.transform("_lines", line_hash))
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    last = F.size("_lines") - 1

    def told(i: Column) -> Column:
        return rolling(F.col("_hashes"), i) % EVERY == 0

    ends = F.filter(every, lambda i: (i == last) | (told(i) & (i > 0) & (i != last - 1) & ~told(i - 1) if paired else told(i)))
    return hashed.withColumn("_ends", F.when(F.col(text).isNotNull(), ends)).drop("_hashes")


def _starts() -> Column:
    return F.transform("_ends", lambda e, k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_ends"), k - 1) + 1))


def chunks(lined: DataFrame, *carried: str) -> DataFrame:
    """Rows (carried columns, ``chunk``, ``body``) of the chunks of two lines or more; ``chunk`` numbers a document's chunks."""
    spans = F.arrays_zip(_starts().alias("s"), F.col("_ends").alias("e"))
    many = lined.select(*carried, "_lines", F.posexplode(spans).alias("chunk", "span")).where("span.e > span.s")
    return many.select(*carried, "chunk", F.array_join(F.slice("_lines", F.col("span.s") + 1, F.col("span.e") - F.col("span.s") + 1), "\n").alias("body"))


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", paired: bool = False) -> DataFrame:
    """Rows (every column of ``docs``, ``kept_text``, ``n_lines``, ``n_removed_lines``, ``n_removed_chunks``).

    Lines end at "\\n". A chunk ends where the rolling hash of the last lines' hashes says so, whatever stands further before or behind: inserted lines
    move no boundary beyond their neighbours. A chunk of two lines or more that also stands earlier (smaller key, or same document and earlier) is removed, after its bytes have been
    compared with the first one's; single-line chunks stay, of which ``paired`` makes none in texts of two lines or more. A null text stays null with 0 lines; an empty one has one empty line. Rows of one key
    and equal text count as one document and get the same result; null keys come first. Columns of ``docs`` named like a result give way to it; the key and the text must not be named so. Copies of a chunk meet in partial counts and minima only, and joins on a hot chunk can be split, as its side has all the
    copies and the other one row.
    """
    made = ("kept_text", "n_lines", "n_removed_lines", "n_removed_chunks")
    columns = [c for c in docs.columns if c not in made]
    # The text travels once: inside the row.
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_print"))
    lined = with_lines(docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_print"), F.col(text).alias("_text")), "_text", paired)
    place = F.struct("_key", "_print", "chunk")
    told = F.xxhash64("body").alias("h1"), F.hash("body").alias("h2")
    every = chunks(lined, "_key", "_print")
    marks = every.select(*told, place.alias("place")).groupBy("h1", "h2").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    repeated = marks.where("first != last").select("h1", "h2", "first")
    # All bodies move once, to find the repeated chunks; what is written and compared are the bodies of those only, the first one's beside each later one's.
    met = settled(every.select("*", *told).join(repeated, ["h1", "h2"]).withColumn("is_first", place.eqNullSafe(F.col("first"))).drop("first"), "chunks")
    firsts = met.where("is_first").select("h1", "h2", F.col("body").alias("first_body")).dropDuplicates(["h1", "h2"])
    later = met.where("not is_first").join(firsts, ["h1", "h2"]).where(F.col("body") == F.col("first_body"))
    gone = later.select("_key", "_print", "chunk").groupBy("_key", "_print").agg(F.collect_set("chunk").alias("_gone"))
    joined = named.join(
        gone.select(F.col("_key").alias("_k"), F.col("_print").alias("_p"), "_gone"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_print") == F.col("_p")), "left"
    )
    again = with_lines(joined.select("_row", F.col("_row").getField(text).alias("_text"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone")), "_text", paired)
    spans = again.withColumn("_spans", F.filter(F.arrays_zip(_starts().alias("s"), F.col("_ends").alias("e")), lambda x, k: ~F.array_contains("_gone", k)))
    kept = F.flatten(F.transform("_spans", lambda x: F.slice("_lines", x["s"] + 1, x["e"] - x["s"] + 1)))
    n_lines = F.coalesce(F.size("_lines"), F.lit(0))
    out = spans.withColumn("_kept", kept).withColumn("_n", F.when(F.col("_text").isNull(), 0).otherwise(n_lines))
    removed = F.when(F.col("_text").isNull(), 0).otherwise(F.col("_n") - F.size("_kept"))
    return out.select(
        *[F.col("_row").getField(c).alias(c) for c in columns],
        F.array_join("_kept", "\n").alias("kept_text"),
        F.col("_n").cast("bigint").alias("n_lines"),
        removed.cast("bigint").alias("n_removed_lines"),
        F.size("_gone").cast("bigint").alias("n_removed_chunks"),
    )


ORACLE = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines
), rolled AS (
  SELECT *, max(i) OVER (PARTITION BY doc_id) AS last,
    (((((coalesce(lag(h, 2) OVER w, 0)) % {MODULUS}) * {FACTOR} + coalesce(lag(h, 1) OVER w, 0)) % {MODULUS}) * {FACTOR} + h) % {MODULUS} AS r
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(CASE WHEN r % {EVERY} = 0 OR i = last THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM rolled
), bodies AS (
  SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk
), judged AS (
  SELECT *, n > 1 AND row_number() OVER (PARTITION BY body ORDER BY n = 1, doc_id, chunk) > 1 AS gone FROM bodies
)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(CASE WHEN gone THEN n END), 0)::BIGINT AS n_removed_lines,
  count(CASE WHEN gone THEN 1 END)::BIGINT AS n_removed_chunks,
  CASE WHEN any_value(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(CASE WHEN NOT gone THEN body END, chr(10) ORDER BY chunk), '')) END AS kept_sha256
FROM documents d LEFT JOIN judged j ON d.doc_id = j.doc_id GROUP BY d.doc_id
"""
