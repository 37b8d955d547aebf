"""Near-duplicate documents by a chosen-path set similarity join."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltemi.llm.components import components
from meltemi.llm.frames import map_columns, settled
from meltemi.llm.words import Words, mixed, shingles


@dataclass(frozen=True)
class Paths:
    """Shape of the search.

    ``trees`` independent trees; at its root a set chooses one or two of its ``tokens`` minwise tokens (1 / similarity of them on average), below
    two, at least one of them where it differs from the node's pivot. A node of at most ``small`` sets is compared exhaustively, and so are the sets outside a larger node's main component, if they are as few. ``slack``: a pair is set aside where so few
    of its ``bits`` agree, one of each minwise value, that a similarity at the threshold is out of question (that many standard deviations). The values come from ``rounds`` rounds that deal all
    shingles over the places; the first ``tokens`` of them choose the paths. With 12 trees a pair at the threshold meets at no root once in 2 * 10^9 times.
    """

    trees: int = 12
    tokens: int = 64
    small: int = 48
    levels: int = 3
    bits: int = 1024
    rounds: int = 16
    slack: float = 5.0
    seed: int = 11


SIZE = 5
THRESHOLD = 75

#: Bytes of texts whose sets a worker makes at once: each byte takes some hundred in between.
_SLICE = 512 << 10


def _sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of each text, sorted within it; range of each text). A text of fewer words has its whole sequence as one."""
    counts = words.counts
    prints = words.prints
    owner = words.text_of()
    left = words.first[1:][owner] - np.arange(len(prints))
    every = shingles(prints, size)
    at = np.flatnonzero(left[: len(every)] >= size)
    values, of = [every[at]], [owner[at]]
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        if len(short):
            values.append(shingles(prints, k)[words.first[short]])
            of.append(short)
    value, text = np.concatenate(values), np.concatenate(of)
    by = np.lexsort((value, text))
    value, text = value[by], text[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(counts) + 1))


def _identity(value: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from a cryptographic digest of its sorted shingles: equal sets have equal names."""
    names = [hashlib.blake2b(value[a:b].tobytes(), digest_size=8).digest() for a, b in zip(cut[:-1], cut[1:])]
    return np.frombuffer(b"".join(names), np.int64)


#: No minwise value is that large.
_NONE = np.uint64((1 << 64) - 1)
_LOW = np.uint64((1 << 54) - 1)


def _minwise(value: np.ndarray, cut: np.ndarray, p: Paths) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``tokens`` minwise values, rows of ``bits`` / 8 bytes with one bit of each of ``bits`` values) of each set; empty sets get zeros.

    Every round deals each shingle to one place, where the earliest round's smallest value stays (fast similarity sketching); a place that no round has filled gets the smallest of all
    shingles under a hash function of its own. Two sets agree in a place as often as they are similar, for a number of hashes that hardly depends on ``bits``.
    """
    rng = np.random.default_rng(p.seed)
    seeds = rng.integers(0, 1 << 63, p.rounds + p.bits, dtype=np.uint64)
    top = np.uint64(64 - (p.bits - 1).bit_length())
    size = np.diff(cut)
    filled = np.flatnonzero(size)
    tokens, packed = np.zeros((len(size), p.tokens), np.uint64), np.zeros((len(size), p.bits // 8), np.uint8)
    for some in np.split(filled, np.arange(128, len(filled), 128)):
        n = size[some]
        least = np.full((len(some), p.bits), _NONE)
        flat = least.reshape(-1)
        one = value[_ranges(cut[some], n)]
        place = np.repeat(np.arange(len(some)) * p.bits, n)
        for k in range(p.rounds):
            h = mixed(one ^ seeds[k])
            np.minimum.at(flat, place + (h >> top).astype(np.int64), (h & _LOW) | np.uint64(k << 54))
            if k % 4 == 1:
                left = (least == _NONE).any(axis=1)[place // p.bits]
                one, place = one[left], place[left]
        of, at = np.nonzero(least == _NONE)
        many = n[of]
        for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(np.cumsum(many) >> 20)) + 1):
            if len(part):
                ends = np.cumsum(many[part])
                h = mixed(value[_ranges(cut[some][of[part]], many[part])] ^ np.repeat(seeds[p.rounds + at[part]], many[part]))
                least[of[part], at[part]] = np.minimum.reduceat(h & _LOW, ends - many[part]) | np.uint64(p.rounds << 54)
        tokens[some] = least[:, : p.tokens]
        packed[some] = np.packbits((mixed(least) & np.uint64(1)).astype(np.uint8), axis=1)
    return tokens, packed


def _ranges(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + many[i], one range after the other."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)


def signatures(docs: DataFrame, p: Paths, *, key: str, text: str, size: int) -> DataFrame:
    """Rows (key, ``n_shingles``, ``set_id``, ``sketch``, ``bits``, ``roots``): a byte per minwise token, a bit per minwise value, and the root nodes that the set chooses in the trees."""
    kind = docs.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array) -> list:
        value, cut = _sets(Words(texts, "blank"), size)
        least, bits = _minwise(value, cut, p)
        sizes = np.diff(cut)
        sketch = (mixed(least) & np.uint64(0xFF)).astype(np.uint8)
        rng = np.random.default_rng(p.seed + 1)
        roots = []
        for tree in range(p.trees):
            # One token, and a second one in a third of the trees: 100 / 75 on average, alike for all sets.
            for token in rng.permutation(p.tokens)[: 2 if tree % 3 == 0 else 1]:
                roots.append(mixed(least[:, token] + np.uint64((tree * 1009 + int(token) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64))
        roots = np.stack(roots, axis=1)
        return [keys, sizes, _identity(value, cut), [x.tobytes() for x in sketch], [x.tobytes() for x in bits], pa.array([r if n else None for r, n in zip(roots, sizes)], pa.list_(pa.int64()))]

    return map_columns(docs.select(key, text), f"`{key}` {kind}, n_shingles long, set_id long, sketch binary, bits binary, roots array<long>", work, text=text, max_bytes=_SLICE)


_MINE = ("set_id", "sketch", "bits", "n_shingles", "component")
_ASKED = ("set_id", "bits", "n_shingles", "component")


def _rooted(sets: DataFrame) -> DataFrame:
    """Rows (``set_id``, ``node``, ``pivot``) of root nodes with at least two sets. Only names move: most sets are alone."""
    rows = sets.select("set_id", F.explode("roots").alias("node"))
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.max("set_id").alias("pivot")).where("size > 1")
    return rows.join(nodes.select("node", "pivot"), "node")


def _members(rows: DataFrame) -> DataFrame:
    """Rows of nodes with at least two components, with the node's size, its pivot (a member of its largest component) and how many stand outside that component."""
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("set_id", "node").alias("h"), "set_id", "sketch", "bits", "n_shingles")).alias("m"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component", "m")).alias("p"), F.count("*").alias("parts")).where("parts > 1")
    pivot = F.struct("p.m.set_id", "p.m.sketch", "p.m.bits", "p.m.n_shingles", "p.component").alias("pivot")
    return rows.join(nodes.select("node", "size", (F.col("size") - F.col("p.n")).alias("outside"), pivot), "node")


def _bits(rows: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(rows.to_pylist()), np.uint64).reshape(len(rows), -1)


def _near(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray, p: Paths, threshold: int) -> np.ndarray:
    """Whether the bits and sizes of each pair allow the threshold."""
    agree = (1 + threshold / 100) / 2
    most = p.bits * (1 - agree) + p.slack * (p.bits * agree * (1 - agree)) ** 0.5
    return (100 * np.minimum(m, n) >= threshold * np.maximum(m, n)) & (np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most)


def _compared(sides: DataFrame, p: Paths, threshold: int) -> DataFrame:
    """Pairs (a, b) from rows (left, right) of two short lists: every pair across components whose bits and sizes allow the threshold."""

    def columns(lists: pa.Array) -> tuple:
        flat = lists.flatten()
        cut = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
        return flat.field(0).to_numpy(), _bits(flat.field(1)), flat.field(2).to_numpy(), flat.field(3).to_numpy(), cut

    def work(left: pa.Array, right: pa.Array) -> list:
        (i, x, m, c, at), (j, y, n, d, bt) = columns(left), columns(right)
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        single = len(i) == len(j) == len(left) and (np.diff(at) == 1).all() and (np.diff(bt) == 1).all()
        if single:
            near = (c != d) & _near(x, y, m, n, p, threshold)
            one, two = [i[near]], [j[near]]
        for k in range(0 if single else len(left)):
            u, v = slice(at[k], at[k + 1]), slice(bt[k], bt[k + 1])
            a, b = np.nonzero(c[u, None] != d[None, v])
            near = _near(x[u][a], y[v][b], m[u][a], n[v][b], p, threshold)
            one.append(i[u][a[near]])
            two.append(j[v][b[near]])
        a, b = np.concatenate(one), np.concatenate(two)
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], axis=1), axis=0)
        return [np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])]

    return map_columns(sides.select("left", "right"), "a long, b long", work)


def _with_pivots(rooted: DataFrame, sets: DataFrame, p: Paths, threshold: int) -> DataFrame:
    """Candidate pairs of every set with its root nodes' pivots, at most as many as it has roots."""
    pairs = rooted.where("set_id != pivot").select(F.col("set_id").alias("a"), F.col("pivot").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("set_id").alias(side), F.col("bits").alias(f"bits_{side}"), F.col("n_shingles").alias(f"n_{side}")), side)

    def work(a: pa.Array, b: pa.Array, x: pa.Array, y: pa.Array, m: pa.Array, n: pa.Array) -> list:
        near = pa.array(_near(_bits(x), _bits(y), m.to_numpy(), n.to_numpy(), p, threshold))
        return [a.filter(near), b.filter(near)]

    near = map_columns(pairs.select("a", "b", "bits_a", "bits_b", "n_a", "n_b"), "a long, b long", work)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pairs(members: DataFrame, p: Paths, threshold: int) -> DataFrame:
    """Candidate pairs of sets in different components of a node: all of a small node; of a large one those with its pivot, and where few stand outside the main component, those few with every member."""
    mine, pivot = F.struct(*_ASKED), F.struct(*[f"pivot.{c}" for c in _ASKED])
    large = members.where(F.col("size") > p.small)
    pivots = large.where("component != pivot.component").select(F.array(mine).alias("left"), F.array(pivot).alias("right"))
    small = members.where(F.col("size") <= p.small).groupBy("node").agg(F.collect_list(mine).alias("left")).select("left", F.col("left").alias("right"))
    open_ = large.where(F.col("outside") <= p.small)
    few = open_.where("component != pivot.component").groupBy("node").agg(F.collect_list(mine).alias("right"))
    wide = open_.select("node", F.array(mine).alias("left")).join(few, "node").select("left", "right")
    return _compared(small.unionByName(pivots).unionByName(wide), p, threshold).distinct()


def _last_links(members: DataFrame, full: DataFrame, p: Paths, threshold: int) -> DataFrame:
    """Links (a, b) that connect what is linked in the nodes, found on full sets.

    Every set outside a node's main component is met by every member, block by block, however many they are. Pairs that the bits allow are confirmed where they meet and never become
    rows; in a pair of blocks one link between two components is enough.
    """
    mine = F.struct(*_ASKED, "shingles")
    rows = members.drop("sketch").join(full, "set_id")
    blocks = lambda c: F.ceil(F.col(c) / p.small)
    block = lambda c: F.pmod(F.xxhash64("set_id"), blocks(c))
    # Blocks of members are dealt over parts of 16, and each part gets all the blocks outside.
    left = rows.groupBy("node", block("size").alias("block")).agg(F.collect_list(mine).alias("left")).withColumn("part", F.floor(F.col("block") / 16)).drop("block")
    right = rows.where("component != pivot.component").groupBy("node", block("outside").alias("block")).agg(F.collect_list(mine).alias("right"), F.first(blocks("size")).alias("blocks"))
    right = right.select("node", "right", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / 16))).alias("part"))

    def columns(lists: pa.Array) -> tuple:
        flat = lists.flatten()
        cut, sets = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]), flat.field(4)
        return flat.field(0).to_numpy(), _bits(flat.field(1)), flat.field(2).to_numpy(), flat.field(3).to_numpy(), sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy(), cut

    def work(left: pa.Array, right: pa.Array) -> list:
        (i, x, m, c, s, es, at), (j, y, n, d, t, et, bt) = columns(left), columns(right)
        found = []
        for k in range(len(left)):
            u, v = slice(at[k], at[k + 1]), slice(bt[k], bt[k + 1])
            a, b = np.nonzero(c[u, None] != d[None, v])
            near = _near(x[u][a], y[v][b], m[u][a], n[v][b], p, threshold)
            joined: dict[int, int] = {}

            def top(z: int, joined: dict[int, int] = joined) -> int:
                while z in joined:
                    z = joined[z]
                return z

            for e, f in zip((a[near] + at[k]).tolist(), (b[near] + bt[k]).tolist()):
                one, two = top(int(c[e])), top(int(d[f]))
                if one != two:
                    mine, other = s[es[e] : es[e + 1]], t[et[f] : et[f + 1]]
                    common = int((other[np.minimum(np.searchsorted(other, mine), len(other) - 1)] == mine).sum())
                    if 100 * common >= threshold * (len(mine) + len(other) - common):
                        joined[one] = two
                        found.append((min(i[e], j[f]), max(i[e], j[f])))
        return list(np.array(found, np.int64).reshape(-1, 2).T)

    return map_columns(left.join(right, ["node", "part"]).select("left", "right"), "a long, b long", work).distinct()


def _full_sets(wanted: DataFrame, docs: DataFrame, sets: DataFrame, *, key: str, text: str, size: int) -> DataFrame:
    """Rows (``set_id``, sorted ``shingles``) of the wanted sets, made anew from the texts of the documents that stand for them, and of those only."""
    texts = docs.select(key, text).join(sets.join(wanted, "set_id").select(F.col("rep").alias(key)), key, "left_semi")

    def work(texts: pa.Array) -> list:
        value, cut = _sets(Words(texts, "blank"), size)
        return [_identity(value, cut), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(value.view(np.int64)))]

    full = map_columns(texts.select(text), "set_id long, shingles array<long>", work, text=text, max_bytes=_SLICE)
    return settled(full.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, sets: DataFrame, *, key: str, text: str, size: int, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    wanted = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    full = _full_sets(wanted, docs, sets, key=key, text=text, size=size)
    left = pairs.join(full.select(F.col("set_id").alias("a"), F.col("shingles").alias("s")), "a")
    met = left.join(full.select(F.col("set_id").alias("b"), F.col("shingles").alias("t")), "b")
    common = met.select("a", "b", F.size(F.array_intersect("s", "t")).alias("n"), (F.size("s") + F.size("t")).alias("m"))
    return common.where(F.lit(100) * F.col("n") >= F.lit(threshold) * (F.col("m") - F.col("n"))).select("a", "b")


def _children(members: DataFrame, p: Paths) -> DataFrame:
    """Large nodes branch: every member goes on by one or two of its minwise tokens, with its value there.

    The first is where it differs from the node's pivot: what all members share, such as a very common line, tells nothing and would keep them together. So is the second,
    unless most tokens agree with the pivot's; then it is any token, as similar sets seldom differ from the pivot in the same one.
    """
    kinds = {f.name: f.dataType.simpleString() for f in members.schema.fields}

    def work(set_id: pa.Array, sketch: pa.Array, bits: pa.Array, n_shingles: pa.Array, component: pa.Array, node: pa.Array, against: pa.Array) -> list:
        n = len(set_id)
        mine, pivot = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(n, p.tokens) for x in (sketch, against))
        differs, parent, row = mine != pivot, node.to_numpy().view(np.uint64), np.arange(n)
        near = differs.sum(axis=1) * 2 <= p.tokens
        children = []
        for k in range(2):
            salted = mixed(parent + np.uint64(k + 1))
            order = ((salted % np.uint64(p.tokens)).astype(np.int64)[:, None] + np.arange(p.tokens)) % p.tokens
            told = np.take_along_axis(differs, order, 1)
            at = order[row, np.where(near, 0, told.argmax(axis=1)) if k else told.argmax(axis=1)]
            children.append(mixed(salted ^ mixed((at * 256 + mine[row, at]).astype(np.uint64) + np.uint64(1))))
        take = np.concatenate([row, np.flatnonzero(children[0] != children[1])])
        child = np.concatenate([children[0], children[1][take[n:]]]).view(np.int64)
        return [*(x.take(pa.array(take)) for x in (set_id, sketch, bits, n_shingles, component)), child]

    open_ = members.where((F.col("size") > p.small) & (F.col("outside") > p.small))
    return map_columns(open_.select(*_MINE, "node", F.col("pivot.sketch").alias("against")), ", ".join(f"{c} {kinds[c]}" for c in (*_MINE, "node")), work)


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: int = THRESHOLD, paths: Paths = Paths()
) -> DataFrame:
    """Rows (key, ``n_shingles``, ``component_id``, ``kept``) of every document.

    Words are runs of anything but ASCII white space, A-Z lowered. Documents whose sets of ``size``-word shingles have
    100 * common >= ``threshold`` * union are linked; ``component_id`` is the smallest key reachable, ``kept`` says that it is the own one. A text of fewer words has one shingle; one without words, or
    null, has none and stands alone. Rows of equal key are one document if their texts are equal. A row with a null key is linked with nothing, has a null component and is kept. An empty table gives an empty result.

    Equal sets are one set from the start, so copies form no pairs. Trees share no state and run side by side, level by level. First every node's members meet its pivot. Then nodes with one component are
    done, small ones are compared exhaustively, large ones with a pivot, and those with many sets outside their main component branch further. After the last level these sets meet all members
    in blocks. Every link is confirmed on full sets.
    """
    name, docs = key, docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key, text = "_key", "_text"
    signed = settled(signatures(docs, paths, key=key, text=text, size=size), "signatures")
    own = signed.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    sets = settled(own.groupBy("set_id").agg(F.min(key).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"), F.first("roots").alias("roots")), "distinct")
    rows = _rooted(sets)
    links: DataFrame | None = None
    tried: DataFrame | None = None
    for level in range(paths.levels + 1):
        first, last = level == 0, level == paths.levels
        members = settled(rows if first else _members(rows), "nodes")
        new: DataFrame | None = None
        if last:
            full = _full_sets(members.select("set_id").distinct(), docs, sets, key=key, text=text, size=size)
            new = settled(_last_links(members, full, paths, threshold), "confirmed")
        else:
            found = _with_pivots(members, sets, paths, threshold) if first else _pairs(members, paths, threshold)
            pairs = settled(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "pairs")
            tried = pairs if tried is None else pairs.unionByName(tried)
            if not pairs.isEmpty():
                new = settled(_confirmed(pairs, docs, sets, key=key, text=text, size=size, threshold=threshold), "confirmed")
        if new is not None and not new.isEmpty():
            links = new if links is None else new.unionByName(links)
        going = members if first else members.where((F.col("size") > paths.small) & (F.col("outside") > paths.small))
        if last or going.isEmpty():
            break
        rows = members.select("set_id", "node").join(sets.select("set_id", "sketch", "bits", "n_shingles"), "set_id").withColumn("component", F.col("set_id")) if first else _children(members, paths)
        if links is not None:
            # Only to spare pairs that are connected already: a few rounds do.
            labels = settled(components(links, rounds=2), "labels")
            rows = rows.drop("component").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    named = sets.select("set_id", "rep")
    if links is not None:
        labels = components(links)
        named = named.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
        least = named.groupBy("component").agg(F.min("rep").alias("least"))
        named = named.join(least, "component").select("set_id", F.col("least").alias("component_id"))
    else:
        named = named.select("set_id", F.col("rep").alias("component_id"))
    alone = F.col("n_shingles") == 0
    out = signed.select(key, "n_shingles", "set_id").join(named, "set_id", "left")
    component = F.when(F.col(key).isNull(), F.lit(None)).when(alone, F.col(key)).otherwise(F.col("component_id"))
    found = out.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    return found.withColumnRenamed(key, name)
