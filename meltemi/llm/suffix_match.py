"""Benchmark decontamination: suffix arrays over training shards, searched for every benchmark suffix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.frames import bounded_broadcast, map_columns, settled
from meltemi.llm.words import Words

#: Bytes of benchmark texts and ids that the driver reads at a time; more are read as further blocks.
BLOCK_BYTES = 8 << 20
#: Suffixes that go out together, some 25 MB with their windows: a block is cut into such pieces, inside an item too.
PIECE = 1 << 17
#: Pieces that a Python worker keeps; of more, each is read again from the executor's disk for every shard.
HELD = 4
#: Suffixes that are looked up at once.
LOOKED_UP = 1 << 15
#: Ids that stand beside one text; of more, the text is listed several times.
IDS = 100_000
#: Words of a suffix that the arrays put in order: beyond any window, and as far as a longest match is followed.
DEPTH = 81


class SuffixArray:
    """The suffixes of a shard's word sequence, in order of their first ``depth`` words' fingerprints.

    Words get ranks; three ranks packed in one number order all suffixes by three words, three such ranks by nine, and so on. After each round
    only suffixes that still share their key with another one are ordered further. The sequence ends with, and texts are parted by, rank 0.
    """

    def __init__(self, prints: np.ndarray, breaks: np.ndarray, depth: int = DEPTH) -> None:
        #: Places of words among words and text ends; breaks[i]: number of words before the end of text i.
        n_words, n = len(prints), len(prints) + len(breaks)
        ends = breaks + np.arange(len(breaks))
        is_word = np.ones(n, bool)
        is_word[ends] = False
        self.place = np.flatnonzero(is_word)
        self.vocabulary, ranks = np.unique(prints, return_inverse=True)
        self.sequence = np.zeros(n + depth, np.int64)
        self.sequence[self.place] = ranks + 1
        self.n_words = n_words
        rank = self.sequence[: n + depth].copy()
        order = np.arange(n)
        reach, live = 1, order
        bits = max(1, int(n + 1).bit_length())
        parts = max(2, min(3, 63 // bits))  # a single text of over two million words goes by pairs
        slots = order
        while len(live) and reach < depth:
            # Rank 0 ends a suffix: what follows a text's end must not part equal suffixes before it.
            key = rank[live]
            for k in range(1, parts):
                key = key << bits | np.where(self._ended(live, k * reach), 0, rank[live + k * reach])
            by = np.argsort(key, kind="stable")
            key, sorted_live = key[by], live[by]
            # Suffixes that share a key sit side by side, so they swap places among themselves.
            order = order.copy() if reach == 1 else order
            order[slots] = sorted_live
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            # A rank is one more than the first slot of its group, so ranks of settled suffixes stay right.
            group = slots[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] + 1
            fresh = rank.copy() if reach > 1 else np.zeros_like(rank)
            fresh[sorted_live] = group
            alone = new & np.append(new[1:], True)
            rank, live, slots = fresh, sorted_live[~alone], slots[~alone]
            reach *= parts
        self.order = order
        self.depth = min(reach, depth)

    def _ended(self, places: np.ndarray, ahead: int) -> np.ndarray:
        """Whether a text ends within the next ``ahead`` places."""
        if "_ends" not in self.__dict__:
            self._ends = np.concatenate([[0], np.cumsum(self.sequence == 0)])
        return self._ends[places + ahead] > self._ends[places]

    def ranks(self, prints: np.ndarray) -> np.ndarray:
        """Ranks of foreign words; words that the shard lacks get -1."""
        if not len(self.vocabulary):
            return np.full(len(prints), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, prints), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == prints, at + 1, -1)

    def search(self, queries: np.ndarray, lengths: np.ndarray, *, upper: bool) -> np.ndarray:
        """Binary search of all queries (rows of ranks, their lengths) at once: the first suffix not below, or above with ``upper``, the query."""
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.order))
        rows = np.arange(len(queries))
        while len(open_ := rows[lo[rows] < hi[rows]]):
            mid = (lo[open_] + hi[open_]) >> 1
            at = self.order[mid]
            sign = np.zeros(len(open_), np.int8)
            todo = np.arange(len(open_))
            for k in range(queries.shape[1]):
                todo = todo[k < lengths[open_[todo]]]
                if not len(todo):
                    break
                diff = self.sequence[at[todo] + k] - queries[open_[todo], k]
                sign[todo] = np.sign(diff)
                todo = todo[diff == 0]
            right = sign <= 0 if upper else sign < 0
            lo[open_] = np.where(right, mid + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], mid)
        return lo

    def common(self, places: np.ndarray, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``places`` share with the queries from their start."""
        out = np.zeros(len(queries), np.int64)
        todo = np.arange(len(queries))
        for k in range(queries.shape[1]):
            todo = todo[k < lengths[todo]]
            todo = todo[self.sequence[places[todo] + k] == queries[todo, k]]
            if not len(todo):
                break
            out[todo] += 1
        return out


@dataclass(frozen=True)
class TestBlock:
    """Benchmark suffixes: per distinct window its fingerprints, and the texts that contain it. Equal texts are one, with the ids of its items."""

    names: list[list[str | None]]  # ids of the items with each text
    prints: np.ndarray  # of all words of the block
    starts: np.ndarray  # of each suffix among them
    lengths: np.ndarray  # words of the suffix, to the end of its item or DEPTH
    items: np.ndarray  # number of each suffix's text
    words: np.ndarray  # number of each suffix's first word in its text
    sizes: np.ndarray  # words of a window of each suffix's text
    windows: np.ndarray  # suffix that stands for each window
    window_words: np.ndarray  # words of the window
    window_items: list[set[int]]  # numbers of the texts with each window

    def ids(self, windows: set[int]) -> set[str]:
        """Ids of the items with any of the windows; an id that is null is not listed."""
        return {x for i in set().union(*(self.window_items[w] for w in windows)) for x in self.names[i] if x is not None}


def test_blocks(names: Sequence[Sequence[Any]], texts: Sequence[str | None], window: int) -> Iterator[TestBlock]:
    """The suffixes and windows of some texts, at most PIECE suffixes a block. A text of fewer words than a window, but not none, is one window."""
    words = Words(pa.array(texts, pa.string()))
    per = words.counts
    item = words.text_of()
    word = np.arange(len(item)) - words.first[:-1][item]
    left = per[item] - word
    size = np.minimum(per[item], window)
    ids = [[None if x is None else str(x) for x in some] for some in names]
    for a in range(0, len(item), PIECE):
        own = slice(a, a + PIECE)
        # What the last suffixes reach beyond the piece comes with it.
        prints = words.prints[a : a + PIECE + max(DEPTH, window)]
        first, n = int(item[a]), len(item[own])
        holds = np.flatnonzero(left[own] >= size[own])
        width = size[own][holds]
        wide = np.zeros((len(holds), window), np.uint64)
        for k in range(window):
            inside = k < width
            wide[inside, k] = prints[holds[inside] + k]
        _, one, of = np.unique(wide, axis=0, return_index=True, return_inverse=True) if len(holds) else (None, np.zeros(0, int), np.zeros(0, int))
        having: list[set[int]] = [set() for _ in one]
        for w, i in zip(of.ravel().tolist(), (item[own][holds] - first).tolist()):
            having[w].add(i)
        yield TestBlock(
            ids[first : int(item[own][-1]) + 1], prints, np.arange(n), np.minimum(left[own], DEPTH), item[own] - first, word[own], size[own], holds[one], width[one], having
        )


def blocks(bench: DataFrame, *, key: str, text: str, window: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of bounded size, whatever its own. Its items are the query set: they are read on the driver block by block, never all documents.

    Equal texts are read and searched once, with the ids of their items; many ids of one text are dealt over several rows by a hash.
    """
    rows = bench.select(F.col(key).cast("string").alias("name"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    salt = -(-rows.count() // IDS) or 1
    # An array around each id, as null ids would be left out.
    listed = F.flatten(F.collect_list(F.array("name"))).alias("names")
    grouped = rows.groupBy("text", F.pmod(F.xxhash64("name"), F.lit(salt)).alias("salt")).agg(listed)
    bytes_ = F.octet_length("text") + F.octet_length(F.concat_ws(" ", "names")) + 16 * F.size("names")
    n = -(-(grouped.agg(F.sum(bytes_).alias("n")).first()["n"] or 0) // BLOCK_BYTES)
    if n > 1:
        grouped = settled(grouped, "benchmark")
    for k in range(n):
        got = grouped.where(F.pmod(F.xxhash64("text", "salt"), F.lit(n)) == k).select("text", "names").toArrow().sort_by("text")
        yield from test_blocks(got.column("names").to_pylist(), got.column("text").to_pylist(), window)


def _sent(docs: DataFrame, bench: DataFrame, item: str, window: int) -> list[Any]:
    return [bounded_broadcast(docs.sparkSession, block, _bytes(block), "a benchmark block") for block in blocks(bench, key=item, text="text", window=window)]


def _each(sent: list[Any]) -> Iterator[TestBlock]:
    """The blocks one after the other; of many, a worker holds one at a time."""
    for shared in sent:
        yield shared.value
        if len(sent) > HELD and getattr(shared, "_path", None):
            shared.__dict__.pop("_value", None)


@dataclass
class Hits:
    """What a shard has in common with a block."""

    places: np.ndarray  # first document word (number in the shard) of each occurrence of a window
    windows: np.ndarray
    longest: np.ndarray  # per suffix: words of its longest match
    where: np.ndarray  # and the document word where one begins


def search_shard(array: SuffixArray, block: TestBlock) -> Hits:
    """Searches every suffix of the block in a shard's array: longest verbatim match, and all occurrences of every window."""
    ranks = np.append(array.ranks(block.prints), np.full(DEPTH, -1))
    n, many = len(array.order), len(block.starts)
    longest, where = np.zeros(many, np.int64), np.zeros(many, np.int64)
    none = np.zeros(0, np.int64)
    if not n or not array.n_words or not many:
        return Hits(none, none, longest, where)
    for a in range(0, many, LOOKED_UP):
        part = slice(a, a + LOOKED_UP)
        rows = ranks[block.starts[part, None] + np.arange(DEPTH)]
        # The longest match is beside the place where the suffix would stand. A word that the shard lacks ends it.
        known = np.where((rows == -1).any(axis=1), (rows == -1).argmax(axis=1), DEPTH)
        lengths = np.minimum(block.lengths[part], known)
        at = array.search(rows, lengths, upper=False)
        for beside in (at - 1, at):
            place = array.order[np.clip(beside, 0, n - 1)]
            shared = np.where((beside >= 0) & (beside < n), array.common(place, rows, lengths), 0)
            better = shared > longest[part]
            longest[part], where[part] = np.where(better, shared, longest[part]), np.where(better, place, where[part])
    found = np.flatnonzero(longest[block.windows] >= block.window_words)
    lo, hi = none, none
    for a in range(0, len(found), LOOKED_UP):
        some = found[a : a + LOOKED_UP]
        rows = ranks[block.starts[block.windows[some], None] + np.arange(DEPTH)]
        lo = np.append(lo, array.search(rows, block.window_words[some], upper=False))
        hi = np.append(hi, array.search(rows, block.window_words[some], upper=True))
    runs = hi - lo
    inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    places = array.order[np.repeat(lo, runs) + inside]
    word = np.cumsum(array.sequence > 0) - 1
    return Hits(word[places], np.repeat(found, runs), longest, word[where])


def _shard(texts: pa.Array) -> tuple[Words, SuffixArray]:
    words = Words(texts)
    return words, SuffixArray(words.prints, words.first[1:])


def scan(
    docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 10, shard_bytes: int = 3 << 20
) -> DataFrame:
    """Rows (key, ``n_words``, ``hit`` numbers of the words inside an occurrence of a window, ``items`` array of item ids as strings) of every document.

    Words are runs of ASCII letters (A-Z lowered), digits and non-ASCII letters. Each shard is a run of whole documents; matches
    never cross documents, and every document of a shard is indexed. Null and wordless documents have no words and no spans; items without words
    have no window; an item with a null id marks words but is not listed; repeated rows come out each. An empty benchmark hits nothing. No document is
    shuffled: one map searches block after block of the benchmark in each shard's array.
    """
    return _marked(docs, bench, key, text, item, window, shard_bytes).select(F.col("_key").alias(key), F.col("_n").alias("n_words"), F.col("_hit").alias("hit"), F.col("_items").alias("items"))


def _marked(docs: DataFrame, bench: DataFrame, key: str, text: str, item: str, window: int, shard_bytes: int) -> DataFrame:
    """Every column of ``docs`` as ``_c0``, ``_c1`` ..., with what :func:`scan` finds."""
    others = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)]
    none = F.array().cast("array<long>")
    state = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.lit(0).cast("long").alias("_n"), none.alias("_hit"), none.cast("array<string>").alias("_items"), *others)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields)
    sent = _sent(docs, bench, item, window)

    def work(keys: pa.Array, texts: pa.Array, _n: pa.Array, _hit: pa.Array, _items: pa.Array, *rest: pa.Array) -> list:
        words, array = _shard(texts)
        n, size = len(words.prints), len(keys)
        hit = np.zeros(n, bool)
        names: dict[int, set[str]] = {}
        for b in _each(sent):
            found = search_shard(array, b)
            delta = np.bincount(found.places, minlength=n + 1) - np.bincount(found.places + b.window_words[found.windows], minlength=n + 1)
            hit |= np.cumsum(delta)[:n] > 0
            doc = np.searchsorted(words.first, found.places, side="right") - 1
            windows: dict[int, set[int]] = {}
            for pair in np.unique(doc * max(1, len(b.windows)) + found.windows).tolist():
                d, w = divmod(pair, len(b.windows))
                windows.setdefault(d, set()).add(w)
            for d, some in windows.items():
                names.setdefault(d, set()).update(b.ids(some))
        marked = np.flatnonzero(hit)
        cut = np.searchsorted(marked, words.first)
        new_hit = [marked[cut[k] : cut[k + 1]] - words.first[k] for k in range(size)]
        new_items = [sorted(names.get(k, ())) for k in range(size)]
        return [keys, texts, words.counts, pa.array(new_hit, pa.list_(pa.int64())), pa.array(new_items, pa.list_(pa.string())), *rest]

    return map_columns(state, schema, work, text="_text", max_bytes=shard_bytes)


def _bytes(block: TestBlock) -> int:
    return sum(a.nbytes for a in vars(block).values() if isinstance(a, np.ndarray)) + sum(64 + 80 * len(x) for x in block.window_items) + sum(72 + len(x or "") for some in block.names for x in some)


def digests(docs: DataFrame, bench: DataFrame, *, window: int = 10) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = scan(docs, bench, window=window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 10, shard_bytes: int = 3 << 20) -> DataFrame:
    """The documents, all their columns, without those that contain a window. Clean rows pass through the same map, so nothing is joined."""
    state = _marked(docs, bench, key, text, item, window, shard_bytes).where(F.size("_hit") == 0)
    return state.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])


def longest_matches(
    docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", window: int = 10, shard_bytes: int = 3 << 20
) -> DataFrame:
    """Rows (``item_id``, ``item_word``, key, ``doc_word``, ``n_words``): for every benchmark suffix its longest match over all shards, if of a window's length.

    One row per suffix and shard reaches Spark, which keeps the longest; equal ones go to the smallest key. Matches count up to DEPTH words.
    """
    kind = docs.schema[key].dataType.simpleString()
    sent = _sent(docs, bench, item, window)

    def work(keys: pa.Array, texts: pa.Array) -> list:
        words, array = _shard(texts)
        out: list[list] = [[], [], [], [], []]
        for b in _each(sent):
            hits = search_shard(array, b)
            at = np.flatnonzero(hits.longest >= b.sizes)
            # One row for each item of the text.
            at = np.repeat(at, np.array([len(x) for x in b.names], np.int64)[b.items[at]]) if len(at) else at
            again = np.arange(len(at)) - np.searchsorted(at, at)
            doc = np.searchsorted(words.first, hits.where[at], side="right") - 1
            rows = [b.names[i][k] for i, k in zip(b.items[at], again)], b.words[at], keys.take(pa.array(doc, pa.int64())).to_pylist(), hits.where[at] - words.first[doc], hits.longest[at]
            for column, more in zip(out, rows):
                column.extend(more)
        return out

    out = map_columns(docs.select(key, text), f"item_id string, item_word long, `{key}` {kind}, doc_word long, n_words long", work, text=text, max_bytes=shard_bytes)
    best = F.max_by(F.struct(key, "doc_word", "n_words"), F.struct("n_words", -F.col(key), -F.col("doc_word"))).alias("_m")
    return out.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", f"_m.{key}", "_m.doc_word", "_m.n_words")
