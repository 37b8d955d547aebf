"""Ranked lexical search: pair-bound MaxScore over an index of shards of whole documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from meltemi.llm.frames import bounded_broadcast, settled, sliced
from meltemi.llm.words import ALNUM, utf8

#: A term is a run of letters, digits and non-ASCII characters; only A-Z are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text in a shard of the index (a longer document is a shard of its own), and (item, term) rows that are searched for at once.
SHARD_BYTES, BLOCK_ROWS = 16 << 20, 250_000
#: One shard in so many is searched first, for every item's threshold in the others.
FIRST = 32


def term_weight(n_docs: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * df + 1).cast("double"))).cast("bigint")


def _postings(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; terms; borders of each term's postings; their texts; their counts). Terms are told apart by their bytes, not by a hash."""
    raw, offsets = utf8(texts)
    low = ALNUM[raw]
    n = len(raw)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = low != 0
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    if not len(starts):
        return counts, pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    # Words and the gaps between them in turn: an array of spans over the same bytes.
    spans = np.empty(2 * len(starts), np.int64)
    spans[0::2], spans[1::2] = starts, ends
    every = pa.Array.from_buffers(pa.large_binary(), len(spans) - 1, [None, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(low))])
    coded = pc.dictionary_encode(every)
    codes = coded.indices.to_numpy(zero_copy_only=False)[0::2].astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs, tf = np.unique(codes * len(counts) + owner, return_counts=True)
    code = pairs // len(counts)
    borders = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1], [True])))
    terms = coded.dictionary.take(pa.array(code[borders[:-1]])).cast(pa.binary()).cast(pa.string())
    return counts, terms, borders, (pairs % len(counts)).astype(np.int32), tf.astype(np.int32)


def _packed(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    """One binary value per stretch of 32-bit numbers."""
    at = (borders * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (``shard``, ``term``, ``df``, ``docs``, ``tfs``, ``keys``, ``sizes``): a row per term of a shard with its postings, and one without a term that lists the shard's documents.

    A shard is a stretch of one task's rows with some 16 MB of text, so its number and its size do not hang on the data's skew. Postings are numbers of the shard's documents.
    """
    keys = docs.schema[key].dataType
    schema = StructType(
        [
            StructField("shard", LongType()),
            *StructType.fromDDL("term string, df bigint, docs binary, tfs binary").fields,
            StructField("keys", ArrayType(keys)),
            StructField("sizes", ArrayType(LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() << 32

        def indexed(held: list[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            texts = whole.column(1).combine_chunks()
            counts, terms, borders, owner, tf = _postings(texts if isinstance(texts, pa.Array) else texts.chunk(0))
            n = len(terms)
            own = pa.table({"keys": [whole.column(0).to_pylist()], "sizes": [counts.tolist()]}, schema=pa.schema([types.field("keys"), types.field("sizes")]))
            yield pa.RecordBatch.from_arrays([pa.array([shard]), *[pa.nulls(1, types.field(c).type) for c in ("term", "df", "docs", "tfs")], own["keys"].chunk(0), own["sizes"].chunk(0)], schema=types)
            columns = [pa.array(np.full(n, shard)), terms.cast(types.field("term").type), pa.array(np.diff(borders)), _packed(owner, borders), _packed(tf, borders)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, types.field("keys").type), pa.nulls(n, types.field("sizes").type)], schema=types)

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for part in sliced(batch, batch.schema.names[1], shard_bytes):
                new = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
                if held and size + new > shard_bytes:
                    yield from indexed(held, number)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += new
        if held:
            yield from indexed(held, number)

    return settled(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema), "lexical-index")


class Shard:
    """One shard's postings as impacts, with the bounds that skipping needs."""

    def __init__(self, rows: pa.Table, weights: dict[str, int], n_docs: int, n_terms: int) -> None:
        own = rows.filter(pc.is_null(rows["term"]))
        self.keys = own["keys"].combine_chunks().flatten() if not isinstance(own["keys"], pa.Array) else own["keys"].flatten()
        sizes = np.array(own["sizes"][0].as_py(), np.int64)
        self.length = 75 + (25 * sizes * n_docs) // max(1, n_terms)
        places = pc.sort_indices(self.keys, null_placement="at_end").to_numpy()
        self.place = np.empty(len(places), np.int64)
        self.place[places] = np.arange(len(places))
        self.lists: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        told = rows.filter(pc.is_valid(rows["term"]))
        for term, docs, tfs in zip(told["term"].to_pylist(), told["docs"].to_pylist(), told["tfs"].to_pylist()):
            at, tf = np.frombuffer(docs, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
            self.lists[term] = (at, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * self.length[at])))
        self.most = {term: int(impact.max()) for term, (_, impact) in self.lists.items()}
        self.pairs: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}

    def pair(self, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
        """The intersection list of two terms: both impacts in every document that holds both."""
        if (a, b) not in self.pairs:
            (few, low), (many, high) = self.lists[a], self.lists[b]
            if len(few) > len(many):
                second, first = self.pair(b, a)
                self.pairs[a, b] = (first, second)
                return self.pairs[a, b]
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            both = many[at] == few
            self.pairs[a, b] = (low[both], high[at[both]])
        return self.pairs[a, b]

    def joint(self, a: str, na: int, b: str, nb: int) -> int:
        """The most that two terms can add to one document: together in their intersection, or the better one alone."""
        first, second = self.pair(a, b)
        alone = max(na * self.most[a], nb * self.most[b])
        return max(alone, int((na * first + nb * second).max())) if len(first) else alone

    def bounds(self, terms: list[tuple[str, int]]) -> list[int]:
        """For every prefix of the terms, the most it can add to one document: neighbours combined as pairs wherever that is tighter than their maxima."""
        out = [0]
        for k, (term, n) in enumerate(terms):
            best = out[k] + n * self.most[term]
            if k:
                best = min(best, out[k - 1] + self.joint(*terms[k - 1], term, n))
            out.append(best)
        return out

    def search(self, terms: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score of ``least`` or more, best first; equal scores by key."""
        terms = sorted(((t, n) for t, n in terms if t in self.lists), key=lambda x: (x[1] * self.most[x[0]], x[0]))
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not terms or sum(n * self.most[t] for t, n in terms) < least:
            return nothing
        upto = self.bounds(terms)
        if upto[-1] < least:
            return nothing
        # Documents with none of the terms from `essential` on cannot reach the threshold.
        essential = max(p for p in range(len(upto)) if upto[p] < least)
        score = np.zeros(len(self.place), np.int64)
        for term, n in terms[essential:]:
            at, impact = self.lists[term]
            score[at] += n * impact
        found = np.flatnonzero(score)
        for p in range(essential, 0, -1):
            if len(found) > k:
                kth = len(found) - k
                least = max(least, int(np.partition(score[found], kth)[kth]))
            found = found[score[found] + upto[p] >= least]
            term, n = terms[p - 1]
            at, impact = self.lists[term]
            if len(found) < len(at):
                here = np.minimum(np.searchsorted(at, found), len(at) - 1)
                met = at[here] == found
                score[found[met]] += n * impact[here[met]]
            else:
                score[at] += n * impact
        found = found[score[found] >= least]
        best = found[np.lexsort((self.place[found], -score[found]))][:k]
        return best, score[best]


def _queries(items: DataFrame, item: str, text: str) -> DataFrame:
    """Rows (``item``, ``digest``, ``term``, ``n``): the distinct items' terms with their numbers of occurrences. Equal ids with different texts are different items."""
    words = F.regexp_extract_all(F.translate(F.col(f"`{text}`"), UPPER, LOWER), F.lit(TERM), 0)
    told = items.select(F.col(f"`{item}`").alias("item"), F.sha2(F.col(f"`{text}`"), 256).alias("digest"), words.alias("words")).dropDuplicates(["item", "digest"])
    return told.select("item", "digest", F.explode("words").alias("term")).groupBy("item", "digest", "term").agg(F.count("*").alias("n"))


def search(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (item, ``rank``, key, ``score``): each item's ``k`` documents of highest score above 0, equal scores by ascending key.

    All documents are indexed and ranked. A null text has no terms; a document without terms counts in nothing; a null key ranks behind equal scores; rows of equal
    key are separate documents, each with a rank. An item without terms has no rows; equal rows of items are one item. An empty table on either side gives no rows. Only the named columns
    are read, so others may have any name.

    Texts are read once, for the index, and never shuffled; then only postings of the items' terms move, to the task of their shard. Items go out in blocks of bounded size.
    One shard in 32 is searched first; its scores are every item's threshold in the rest, where most shards cannot reach it and end at their bounds.
    """
    spark = docs.sparkSession
    index = build_index(docs, key=key, text=text, shard_bytes=shard_bytes)
    sizes = index.where("term is null").select(F.explode("sizes").alias("n"))
    row = sizes.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    asked = settled(_queries(items, item, item_text), "lexical-items")
    held = index.where("term is not null").join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("held"))
    weighed = settled(asked.join(held, "term").withColumn("weight", term_weight(row["docs"], F.col("held"))), "lexical-weights")
    blocks = max(1, -(-weighed.count() // BLOCK_ROWS))
    schema = StructType([StructField("item", docs_type(items, item)), StructField("digest", StringType()), StructField("key", docs_type(docs, key)), StructField("score", LongType())])
    found = None
    for b in range(blocks):
        block = weighed if blocks == 1 else weighed.where(F.pmod(F.xxhash64("item", "digest"), F.lit(blocks)) == b)
        part = _searched(spark, index, block, schema, k, row["docs"], row["terms"])
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item", "digest").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")


def docs_type(df: DataFrame, column: str) -> Any:
    return df.schema[column].dataType


def _searched(spark: Any, index: DataFrame, block: DataFrame, schema: StructType, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """The best of every shard for one block of items, in two rounds."""
    rows = block.select("item", "digest", "term", "n", "weight").toArrow().to_pylist()
    weights = {r["term"]: r["weight"] for r in rows if r["weight"] > 0}
    queries: dict[tuple[Any, str], list[tuple[str, int]]] = {}
    for r in rows:
        if r["weight"] > 0:
            queries.setdefault((r["item"], r["digest"]), []).append((r["term"], r["n"]))
    n_bytes = sum(len(r["term"]) + 200 for r in rows)
    terms = block.where("weight > 0").select("term").distinct()
    wanted = index.where("term is not null").join(terms, "term", "left_semi").unionByName(index.where("term is null"))
    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0

    def round_of(part: DataFrame, least: dict[tuple[Any, str], int]) -> DataFrame:
        sent = bounded_broadcast(spark, (weights, queries, least), 2 * n_bytes, "a block of items")

        def ask(table: pa.Table) -> pa.Table:
            from pyspark.sql.pandas.types import to_arrow_schema

            weights, queries, least = sent.value
            shard = Shard(table, weights, n_docs, n_terms)
            out: dict[str, list[Any]] = {"item": [], "digest": [], "key": [], "score": []}
            for (item, digest), terms in queries.items():
                best, score = shard.search(terms, k, max(1, least.get((item, digest), 1)))
                if len(best):
                    out["item"] += [item] * len(best)
                    out["digest"] += [digest] * len(best)
                    out["key"] += shard.keys.take(pa.array(best)).to_pylist()
                    out["score"] += score.tolist()
            return pa.table(out, schema=to_arrow_schema(schema))

        return settled(part.groupBy("shard").applyInArrow(ask, schema), "lexical-found")

    first = round_of(wanted.where(early), {})
    place = F.row_number().over(Window.partitionBy("item", "digest").orderBy(F.col("score").desc()))
    reached = first.withColumn("place", place).where(F.col("place") == k).select("item", "digest", "score").toArrow().to_pylist()
    return first.unionByName(round_of(wanted.where(~early), {(r["item"], r["digest"]): r["score"] for r in reached}))


#: The same ranking by joining all terms; ids of documents and items must be unique.
ORACLE = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY 1, 2
), sizes AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1
), totals AS (
  SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes
), weights AS (
  SELECT term, floor(1000.0::DOUBLE * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term, nd
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY 1, 2
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * nd) // nt)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), totals GROUP BY 1, 2
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""
