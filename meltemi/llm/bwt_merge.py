"""Repeated byte strings across all documents, by merging shard Burrows-Wheeler transforms at content-chosen anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.frames import map_columns, settled, sliced
from meltemi.llm.words import mixed, powers, utf8

#: Bytes of a string that counts as repeated, and of the gram that anchors it.
LENGTH, GRAM = 100, 16
#: Offsets that an anchor can have in a string.
OFFSETS = LENGTH - GRAM + 1
#: Every string holds so many bytes before its anchor's gram, or so many after it.
REACH = (LENGTH - GRAM) // 2
#: Different spans of one gram that meet in a task; more go by the digests of their strings.
TOGETHER = 20_000


class Anchors:
    """Anchors of a block of texts.

    The anchor of a string of LENGTH bytes is its gram of smallest fingerprint, the leftmost of equals: a matter of its bytes alone, so equal strings
    have equal anchors at equal offsets. Consecutive strings of one text share anchors; an anchor's span is all bytes of its strings. ``low`` and ``high`` are its first and last string's starts.
    """

    def __init__(self, texts: pa.Array) -> None:
        self.raw, self.offsets = utf8(texts)
        n = len(self.raw)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
        empty = np.zeros(0, np.int64)
        self.text = self.at = self.low = self.high = empty
        if n < LENGTH:
            return
        grams = mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        bits = np.uint64(max(20, int(n).bit_length()))
        key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
        # Smallest key of OFFSETS neighbours: doubled runs, then two runs that overlap.
        run, width = key, 1
        while width * 2 <= OFFSETS:
            run = np.minimum(run[: len(run) - width], run[width:])
            width *= 2
        rest = OFFSETS - width
        least = np.minimum(run[: len(run) - rest], run[rest:]) if rest else run
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        starts = np.arange(len(anchor))
        text = np.searchsorted(self.offsets, starts, side="right") - 1
        whole = starts + LENGTH <= self.offsets[text + 1]
        starts, anchor, text = starts[whole], anchor[whole], text[whole]
        if not len(starts):
            return
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        self.at, self.text, self.low, self.high = anchor[first], text[first], starts[first], starts[last]

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes from a to b."""
        return mixed((self.sums[b] - self.sums[a]) * self.down[a])


def _bucketed(docs: DataFrame, n: int) -> DataFrame:
    """Rows (bucket, anchors): every anchor of every text, packed by the bucket of its gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text", 1 << 20):
                a = Anchors(part.column("text"))
                if not len(a.at):
                    continue
                out = np.empty(len(a.at), _ANCHOR)
                gram = a.digest(a.at, a.at + GRAM)
                out["gram"] = gram >> np.uint64(32)
                out["span"] = mixed(a.digest(a.low, a.high + LENGTH) ^ ((a.at - a.low).astype(np.uint64) << np.uint64(8)) ^ (a.high - a.low).astype(np.uint64))
                out["doc"] = part.column("doc").to_numpy()[a.text]
                out["print"] = part.column("print").to_numpy()[a.text]
                begin = a.offsets[a.text]
                out["at"], out["most"], out["least"] = a.at - begin, a.at - a.low, a.at - a.high
                # Where no string of the span reaches that far, the gram's own bytes stand in; nothing asks for them.
                out["left"] = a.digest(a.at - np.where(out["most"] >= REACH, REACH, 0), a.at + GRAM) >> np.uint64(32)
                out["right"] = a.digest(a.at, a.at + GRAM + np.where(out["least"] < REACH, REACH, 0)) >> np.uint64(32)
                bucket = (gram % np.uint64(n)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                bucket, out = bucket[by], out[by]
                cut = np.flatnonzero(np.diff(bucket, prepend=-1))
                blobs = [x.tobytes() for x in np.split(out, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(blobs, pa.binary())], names=["bucket", "anchors"])

    return docs.mapInArrow(run, "bucket long, anchors binary").repartition(n, "bucket")


#: An anchor on its way: fingerprints of gram and span, and of the gram with REACH bytes before it and after it, document, place, and the largest and smallest offset of its strings.
#: Half a fingerprint is enough for gram, left and right: where two are equal by chance, spans are compared that share nothing.
_ANCHOR = np.dtype([("gram", "u4"), ("left", "u4"), ("right", "u4"), ("span", "u8"), ("doc", "i8"), ("print", "i4"), ("at", "u4"), ("most", "u1"), ("least", "u1")])


def shared(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which of the given spans, all different, can have a string in common with another one of their group.

    Equal strings stand at equal offsets from their anchors. If it begins REACH bytes or more before them, both spans have the same REACH bytes before the gram; else they have the same REACH bytes after it.
    """
    out = np.zeros(len(x), bool)
    for side, some in (("left", x["most"] >= REACH), ("right", x["least"] < REACH)):
        at = np.flatnonzero(some)
        at = at[np.lexsort((x[side][at], group[at]))]
        same = (x[side][at[1:]] == x[side][at[:-1]]) & (group[at[1:]] == group[at[:-1]])
        out[at[1:][same]] = True
        out[at[:-1][same]] = True
    return out


def _judged(buckets: DataFrame) -> DataFrame:
    """Rows (doc, print, at, most, least, kind) of the anchors whose strings may stand elsewhere too.

    Kind 0: the whole span stands earlier, so all its strings do. Kind 1: a span that is the first of its kind, to be merged with others of its gram that it may share a string with; kind 2: the same,
    where more than TOGETHER such spans have the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(b, []).append(blob)
        while held:
            _, blobs = held.popitem()
            x = np.frombuffer(b"".join(blobs), _ANCHOR)
            del blobs
            x = x[np.lexsort((x["at"], x["print"], x["doc"], x["span"], x["gram"]))]
            x = x[np.append(True, x[1:] != x[:-1])]  # repeated rows are one document
            gram = np.ones(len(x), bool)
            gram[1:] = x["gram"][1:] != x["gram"][:-1]
            span = gram.copy()
            span[1:] |= x["span"][1:] != x["span"][:-1]
            group = np.cumsum(gram) - 1
            first = np.flatnonzero(span)
            open_ = np.zeros(len(x), bool)
            open_[first] = shared(x[first], group[first])
            kinds = np.bincount(group, weights=open_)[group].astype(np.int64)
            kind = np.where(~span, 0, np.where(kinds <= TOGETHER, 1, 2))
            out = x[~span | open_]
            kind = kind[~span | open_]
            for a in range(0, len(out), 100_000):
                o = out[a : a + 100_000]
                columns = [o["doc"], o["print"], o["at"].astype("i4"), o["most"].astype("i4"), o["least"].astype("i4"), kind[a : a + 100_000].astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc", "print", "at", "most", "least", "kind"])

    return buckets.mapInArrow(run, "doc long, print int, at int, most int, least int, kind int")


def interleave(order: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """One refinement: entries keep their order within equal symbols, and symbols come in order.

    ``order`` is the interleave of all shards so far, ``symbols`` the transform's column: the byte before each suffix. Afterwards the entries stand in the order of the
    suffixes one byte longer.
    """
    return order[np.argsort(symbols[order], kind="stable")]


def repeated(grams: np.ndarray, bodies: np.ndarray, ranks: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the string at each offset (0 to OFFSETS - 1 bytes before the anchor) of each span also stands in a span of lower rank.

    ``bodies``: bytes of every span, OFFSETS - 1 before the anchor and LENGTH from it on; ``ranks``: the spans' order of first starts. The shards' suffixes begin as they come, and the
    interleave is refined by one column of the transform after the other, from the end of the longest string to the byte before the farthest start. Two neighbours have a common
    prefix of LENGTH bytes when they agree in the bytes before the anchor (the block they share so far) and in the rest after it (their common prefix there).
    """
    n, before = len(bodies), OFFSETS - 1
    out = np.zeros((n, OFFSETS), bool)
    order = np.argsort(grams, kind="stable")
    columns = np.ascontiguousarray(bodies.T)
    for c in range(before + LENGTH - 1, before - 1, -1):
        order = interleave(order, columns[c])
    # Common prefixes of neighbours from the anchor on.
    shared = np.zeros(n, np.int64)
    same = np.ones(max(n - 1, 0), bool)
    for c in range(before, before + LENGTH):
        same = same & (columns[c][order[1:]] == columns[c][order[:-1]])
        shared[1:] += same
    block = np.zeros(n, np.int64)  # of equal bytes before the anchor
    for offset in range(OFFSETS):
        if offset:
            symbol = columns[before - offset]
            order = interleave(order, symbol)
            new = np.ones(n, bool)
            new[1:] = (symbol[order[1:]] != symbol[order[:-1]]) | (block[order[1:]] != block[order[:-1]])
            block[order] = np.cumsum(new)
        else:
            right = np.empty(n, np.int64)
            at_anchor = order
        right[at_anchor] = np.cumsum(shared < LENGTH - offset)
        live = order[(least[order] <= offset) & (offset <= most[order])]
        if not len(live):
            continue
        new = np.ones(len(live), bool)
        new[1:] = (block[live[1:]] != block[live[:-1]]) | (right[live[1:]] != right[live[:-1]])
        first = np.flatnonzero(new)
        lowest = np.minimum.reduceat(ranks[live], first)
        out[live, offset] = ranks[live] > np.repeat(lowest, np.diff(np.append(first, len(live))))
    return out


def _spans(joined: DataFrame) -> DataFrame:
    """Rows (gram, doc, print, at, most, least, body) of the spans to merge; ``body`` holds their bytes only."""

    def work(docs: pa.Array, prints: pa.Array, texts: pa.Array, lists: pa.Array) -> list:
        raw, offsets = utf8(texts)
        up, down = powers(len(raw) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])])
        flat = lists.flatten()
        at, most, least = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        place = offsets[owner] + at
        data = raw.tobytes()
        bodies = [data[a:b] for a, b in zip((place - most).tolist(), (place - least + LENGTH).tolist())]
        gram = mixed((sums[place + GRAM] - sums[place]) * down[place]).view(np.int64)
        index = pa.array(owner)
        return [gram, docs.take(index), prints.take(index), at, most, least, bodies]

    return map_columns(joined, "gram long, doc long, print int, at int, most int, least int, body binary", work, text="text", max_bytes=1 << 20)


def _merged(spans: DataFrame) -> DataFrame:
    """Rows (doc, print, low, high): runs of string starts that the merge of a task's shards finds repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [b for b in batches if b.num_rows]
        if not shards:
            return
        t = pa.Table.from_batches(shards).combine_chunks()
        one = np.lexsort(tuple(t.column(k).to_numpy() for k in (3, 2, 1)))
        same = np.all([t.column(k).to_numpy()[one[1:]] == t.column(k).to_numpy()[one[:-1]] for k in (1, 2, 3)], axis=0)
        t = t.take(pa.array(one[np.append(True, ~same)])).combine_chunks()  # repeated rows are one document
        gram, doc, mark, at, most, least = (t.column(k).to_numpy() for k in range(6))
        n, before = len(gram), OFFSETS - 1
        bodies = np.zeros((n, before + LENGTH), np.uint8)
        raw, cut = utf8(t.column(6).combine_chunks())
        size = np.diff(cut)
        into = np.repeat(np.arange(n) * (before + LENGTH) + before - most, size) + np.arange(len(raw)) - np.repeat(cut[:-1], size)
        bodies.reshape(-1)[into] = raw
        found = repeated(gram, bodies, np.arange(n), most, least)  # rows stand by document and place
        edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        columns = [doc[row], mark[row], at[row] - last + 1, at[row] - first]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (columns[0], columns[1], columns[2].astype("i4"), columns[3].astype("i4"))], names=["doc", "print", "low", "high"])

    return spans.mapInArrow(run, "doc long, print int, low int, high int")


def _by_digest(joined: DataFrame) -> DataFrame:
    """The same for spans of very frequent grams: strings meet by two fingerprints, and partial minima leave the tasks."""

    def work(docs: pa.Array, prints: pa.Array, texts: pa.Array, lists: pa.Array) -> list:
        raw, offsets = utf8(texts)
        up, down = powers(len(raw) + 1)
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(mixed(raw.astype(np.uint64) + np.uint64(k)) * up[: len(raw)])]) for k in (1, 977)]
        flat = lists.flatten()
        at, most, least = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
        owner = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        runs = most - least + 1
        each = np.repeat(np.arange(len(at)), runs)
        start = (at - most)[each] + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        place = offsets[owner[each]] + start
        digests = [mixed((s[place + LENGTH] - s[place]) * down[place]).view(np.int64) for s in sums]
        index = pa.array(owner[each])
        return [*digests, docs.take(index), prints.take(index), start]

    rows = map_columns(joined, "d1 long, d2 long, doc long, print int, start int", work, text="text", max_bytes=1 << 18)
    first = rows.groupBy("d1", "d2").agg(F.min(F.struct("doc", "print", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = rows.join(first.drop("n"), ["d1", "d2"]).where(F.struct("doc", "print", "start") != F.col("first"))
    return later.select("doc", "print", F.col("start").alias("low"), F.col("start").alias("high"))


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, print, low, high): runs of repeated string starts of the documents; ``print`` tells texts of one key apart.

    A start is repeated if its LENGTH bytes also start earlier: in a document of smaller key, or in the same document before. Every anchor
    of every text takes part.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.hash(text).alias("print"), F.coalesce(text, F.lit("")).alias("text"))
    judged = settled(_judged(_bucketed(named, n)), "anchors")
    copies = judged.where("kind = 0").select("doc", "print", (F.col("at") - F.col("most")).alias("low"), (F.col("at") - F.col("least")).alias("high"))
    anchor = F.struct("at", "most", "least")
    lists = judged.where("kind > 0").groupBy("doc", "print").agg(
        F.collect_list(F.when(F.col("kind") == 1, anchor)).alias("few"), F.collect_list(F.when(F.col("kind") == 2, anchor)).alias("many")
    )
    joined = named.join(lists, ["doc", "print"])
    runs = copies.unionByName(_merged(_spans(joined.where(F.size("few") > 0).select("doc", "print", "text", "few")).repartition(n, "gram")))
    if not judged.where("kind = 2").isEmpty():
        runs = runs.unionByName(_by_digest(joined.where(F.size("many") > 0).select("doc", "print", "text", "many")))
    return runs


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Rows (key, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, with ``with_text`` also ``kept`` bytes) of every document.

    Removed is every byte under a string of LENGTH bytes that also starts earlier; all is judged on the texts as they come. Null, empty and short texts lose nothing. Rows of equal key and text are
    one document and get the same result; texts that share a key follow each other by a hash. A row with a null key takes no part and loses nothing.
    """
    kind = docs.schema[key].dataType.simpleString()
    # Written, so that the spans' bytes are gone before the texts move again.
    runs = settled(repeats(docs, key=key, text=text), "runs")
    lists = runs.groupBy("doc", "print").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    rows = docs.select(F.col(key).alias("_key"), F.hash(text).alias("print"), F.coalesce(text, F.lit("")).alias("text"))
    joined = rows.join(lists, (F.col("_key").cast("long") == F.col("doc")) & (rows["print"] == lists["print"]), "left").select("_key", "text", "runs")

    def work(keys: pa.Array, texts: pa.Array, lists: pa.Array) -> list:
        out: list[list] = [[], [], [], [], []]
        for t, runs in zip(texts.to_pylist(), lists.to_pylist()):
            raw = t.encode("utf-8", "surrogatepass")
            gone = np.zeros(len(raw) + 1, np.int64)
            for r in runs or ():
                gone[r["low"]] += 1
                gone[r["high"] + LENGTH] -= 1
            covered = np.cumsum(gone)[:-1] > 0
            kept = raw if not runs else np.frombuffer(raw, np.uint8)[~covered].tobytes()
            starts = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if runs else 0
            for column, value in zip(out, (len(raw), len(raw) - len(kept), starts, hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                column.append(value)
        return [keys, *(pa.array(c, pa.binary()) if i == 4 else c for i, c in enumerate(out))]

    done = map_columns(joined, f"_key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", work, text="text", max_bytes=1 << 20)
    return done.select(F.col("_key").alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
