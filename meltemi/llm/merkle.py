"""A Merkle manifest of a dataset by time-forward processing: digests travel up and proofs down in queues ordered by node label."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltemi.llm.frames import crc_bucket, settled

#: Children of a node, and levels that one sweep takes within a task: its blocks are FAN ** LEVELS consecutive nodes.
FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_POWERS = [FAN**k for k in range(39)]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf_digest(values: list[Column]) -> Column:
    """sha256 of the fields one after the other: ``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def swept(children: list[tuple[int, str]], levels: int) -> Iterator[tuple[int, int, list[str]]]:
    """Time-forward sweep over a block: (level, index, child digests) of its nodes by label, children first.

    ``children`` are (index, digest) of the block's nodes at level 0. Every node's digest is put into the queue under its parent's label; a node takes what
    stands under its own label, which is always the queue's front.
    """
    queue = [(1, i // FAN, i, digest) for i, digest in children] if levels else []
    heapq.heapify(queue)
    while queue:
        level, index, _, _ = queue[0]
        run: list[str] = []
        while queue and queue[0][:2] == (level, index):
            run.append(heapq.heappop(queue)[3])
        yield level, index, run
        if level < levels:
            heapq.heappush(queue, (level + 1, index // FAN, index, _digest("".join(run))))


def _raised(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """The digest of one block's top node, one row."""
    first = rows.iloc[0]
    levels = min(most, int(first["height"]))
    top = first["digest"]
    for _, _, run in swept(list(zip(rows["idx"], rows["digest"])), levels):
        top = _digest("".join(run))
    return pd.DataFrame({"tree": [first["tree"]], "idx": [first["block"]], "digest": [top], "height": [first["height"] - levels]})


def lowered(children: list[tuple[int, str]], levels: int, suffix: str) -> dict[int, str]:
    """The reversed sweep: every level-0 node's proof. Runs are met from the top down; a parent's proof goes to its children under their labels.

    A proof lists, from the node's own level to the root, the digests left and right of the node's run as ``left*right``, levels parted by ``;``.
    """
    runs = list(swept(children, levels))
    proofs = {(levels, index): suffix for level, index, _ in runs if level == levels} or {(0, i): suffix for i, _ in children}
    for level, index, run in reversed(runs):
        above = proofs.pop((level, index))
        for k in range(len(run)):
            own = "".join(run[:k]) + "*" + "".join(run[k + 1 :])
            proofs[(level - 1, index * FAN + k)] = f"{own};{above}" if above else own
    return {index: proof for (_, index), proof in proofs.items()}


def folded(digest: str, proof: str) -> str:
    """The root that a node's digest and its proof lead to."""
    for step in proof.split(";") if proof else ():
        left, right = step.split("*")
        digest = _digest(left + digest + right)
    return digest


def proof_digest(proof: str) -> str:
    """sha256 of all siblings from the leaf's level up, left to right."""
    return _digest(proof.replace("*", "").replace(";", ""))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {FAN**levels}"))


def _passed_down(rows: pd.DataFrame, above: pd.DataFrame, most: int) -> dict[int, str]:
    levels = min(most, int(rows["height"].iloc[0]))
    return lowered(list(zip(rows["idx"], rows["digest"])), levels, above["proof"].iloc[0])


def _inner(rows: pd.DataFrame, above: pd.DataFrame, levels: int) -> pd.DataFrame:
    """Proofs of one block's nodes, from its own proof."""
    if rows.empty:
        return pd.DataFrame({"tree": [], "idx": [], "proof": []})
    proofs = _passed_down(rows, above, levels)
    return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "proof": [proofs[i] for i in rows["idx"]]})


def _leaves(rows: pd.DataFrame, above: pd.DataFrame, levels: int) -> pd.DataFrame:
    """The leaves of one block: digest of the proof, and the root that the claimed leaf leads to."""
    if rows.empty:
        return pd.DataFrame({"tree": [], "idx": [], "proof_sha256": [], "folded_root": []})
    proofs = _passed_down(rows, above, levels)
    mine = [proofs[i] for i in rows["idx"]]
    back = [folded(claim, proof) for claim, proof in zip(rows["claim"], mine)]
    return pd.DataFrame({"tree": rows["tree"], "idx": rows["idx"], "proof_sha256": [proof_digest(p) for p in mine], "folded_root": back})


def _height(n: Column) -> Column:
    """Levels above n leaves: the smallest h with FAN ** h >= n."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))


def placed(leaves: DataFrame) -> DataFrame:
    """Rows (``tree``, ``idx``, ``key``, ``digest``, ``claim``, ``height``, ``grp``): every leaf's place in its group's tree, trees numbered by group (null first, bytewise).

    One range partitioning by (group, key) puts all leaves in order, whatever group is hot; equal rows are told apart by any number, as they may stand for each other. Places are the
    partition's offset within the group plus the row's number there.
    """
    order = [F.col("grp").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("digest"), F.col("claim")]
    told = leaves.withColumn("tie", F.monotonically_increasing_id())
    cut = settled(told.repartitionByRange(*order, "tie").withColumn("part", F.spark_partition_id()), "merkle-order")
    counts = cut.groupBy("part", "grp").agg(F.count("*").alias("n"))
    per = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(per.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("part").alias("_p"), F.col("grp").alias("_g"), before.alias("before"), F.sum("n").over(per).alias("all"))
    trees = leaves.select("grp").distinct().select(F.col("grp").alias("_t"), (F.row_number().over(Window.orderBy(F.col("grp").asc_nulls_first())) - 1).cast("bigint").alias("tree"))
    number = F.row_number().over(Window.partitionBy("part", "grp").orderBy(*order[1:], "tie"))
    rows = cut.withColumn("number", number).join(offsets, (F.col("part") == F.col("_p")) & F.col("grp").eqNullSafe(F.col("_g"))).join(trees, F.col("grp").eqNullSafe(F.col("_t")))
    return rows.select("tree", (F.col("before") + F.col("number") - 1).alias("idx"), "key", "digest", "claim", _height(F.col("all")).cast("bigint").alias("height"), "grp")


def _grown(nodes: DataFrame, purpose: str, levels: int) -> list[DataFrame]:
    """The nodes of every sweep up, from the given ones to one node a tree; a block is raised in one task, and its top goes to the next sweep's queue."""
    sweeps = [nodes]
    tallest = nodes.agg(F.coalesce(F.max("height"), F.lit(0)).alias("h")).first()["h"]
    for k in range(-(-tallest // levels)):
        up = _blocks(sweeps[-1], levels).groupBy("tree", "block").applyInPandas(lambda rows: _raised(rows, levels), "tree long, idx long, digest string, height long")
        sweeps.append(settled(up, f"merkle-{purpose}-{k}"))
    return sweeps


def _handed_down(sweeps: list[DataFrame], proofs: DataFrame, purpose: str, levels: int) -> DataFrame:
    """Proofs of the first sweep's nodes from those of the last one's, block by block."""
    for k, nodes in reversed(list(enumerate(sweeps[:-1]))):
        met = _blocks(nodes, levels).groupBy("tree", "block").cogroup(proofs.withColumnRenamed("idx", "block").groupBy("tree", "block"))
        proofs = settled(met.applyInPandas(lambda rows, above: _inner(rows, above, levels), "tree long, idx long, proof string"), f"merkle-{purpose}-proofs-{k}")
    return proofs


def manifest(
    docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text", tampered: Column | None = None, levels: int = LEVELS
) -> DataFrame:
    """Rows (key, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``), one per row of ``docs``.

    Leaves of a group ascend by key and become one subroot, three by three; the subroots, by group, become the root in the same way. Rows for which ``tampered`` holds are checked
    with their text's line ends deleted: ``folded_root`` is recomputed from that leaf and the original siblings, and ``verified`` says whether it is the root.

    A null field counts as ``-``, apart from an empty one. A null group is a group, the first one; null keys come first. Rows of equal key are separate leaves, ordered by their digests;
    equal rows may stand for each other. An empty table has no rows. Only the named columns are read, so others may have any name.

    Texts are read once, by the two digests, and never shuffled. A task sweeps blocks of 3^levels (729) nodes by a queue ordered by label; between sweeps the shuffle by block is the queue,
    so 22 levels over 3 * 10^10 leaves take four sweeps up and four down.
    """
    column = {c: F.col(f"`{c}`") for c in fields}
    spoilt = {c: F.replace(v, F.lit("\n"), F.lit("")) if c == text else v for c, v in column.items()}
    leaf = leaf_digest(list(column.values()))
    claim = leaf if tampered is None else F.when(tampered, leaf_digest(list(spoilt.values()))).otherwise(leaf)
    leaves = settled(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("grp"), leaf.alias("digest"), claim.alias("claim")), "merkle-leaves")
    base = settled(placed(leaves), "merkle-placed")
    sweeps = _grown(base, "group", levels)
    subroots = sweeps[-1].select("tree", F.col("digest").alias("subroot"))
    crowns = subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), _height(F.count("*").over(Window.partitionBy())).cast("bigint").alias("height"))
    top = _grown(settled(crowns, "merkle-subroots"), "top", levels)
    whole = _handed_down(top, top[-1].select("tree", "idx", F.lit("").alias("proof")), "top", levels)
    ends = whole.select(F.col("idx").alias("tree"), F.lit(0).cast("bigint").alias("idx"), "proof")
    if len(sweeps) == 1:
        # Every group is a single leaf: its proof is its subroot's.
        low = base.select("tree", "idx", "digest", "claim", F.lit(0).cast("bigint").alias("height"))
    else:
        ends = _handed_down(sweeps[1:], ends, "group", levels)
        low = base.select("tree", "idx", "digest", "claim", "height")
    met = _blocks(low, levels).groupBy("tree", "block").cogroup(ends.withColumnRenamed("idx", "block").groupBy("tree", "block"))
    done = met.applyInPandas(lambda rows, above: _leaves(rows, above, levels), "tree long, idx long, proof_sha256 string, folded_root string")
    root = F.lit(next((r["digest"] for r in top[-1].select("digest").take(1)), None)).cast("string")
    named = base.select("tree", "idx", "key", "digest").join(done, ["tree", "idx"]).join(subroots, "tree")
    return named.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def even_crc(key: str = "doc_id") -> Column:
    """Rows whose key's crc32 is even; a null key is not among them."""
    return F.coalesce(crc_bucket(key, 2) == 0, F.lit(False))


def oracle(levels: int = 12) -> str:
    """The manifest in SQL, written out level by level: up to 3^12 leaves a group."""
    coded = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    leaf = " || ".join(coded.format(c) for c in FIELDS)
    bad = " || ".join(coded.format(c if c != "text" else "replace(text, chr(10), '')") for c in FIELDS)
    # crc32, one bit a step: the register is shifted, and the polynomial added where a one falls out.
    crc = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(strlen(doc_id::VARCHAR)),
      lambda i: list_prepend(-ascii(substr(doc_id::VARCHAR, (i + 1)::INT, 1))::BIGINT - 1, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0])))),
      lambda c, s: CASE WHEN s < 0 THEN xor(c, -s - 1) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)"""
    parts = [
        f"leafs AS MATERIALIZED (SELECT doc_id, source, sha256({leaf}) AS leaf, CASE WHEN xor({crc}, 4294967295) % 2 = 0 THEN sha256({bad}) ELSE sha256({leaf}) END AS claim FROM documents)",
        "trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        "a0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, leaf AS h, doc_id, leaf, claim FROM leafs JOIN trees ON leafs.source IS NOT DISTINCT FROM trees.source)",
    ]

    def grow(name: str) -> None:
        for k in range(levels):
            parts.append(
                f"{name}{k + 1} AS MATERIALIZED (SELECT tree, CASE WHEN n > 1 THEN idx // 3 ELSE idx END AS idx, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h "
                f"FROM (SELECT tree, idx, h, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY 1, 2, n)"
            )

    def step(name: str, k: int, source: str, out: str, tree: str, idx: str) -> None:
        # A run's digests left and right of a node; a tree that is one node already is passed through.
        parts.append(
            f"{out} AS MATERIALIZED (SELECT p.* EXCLUDE (proof, back), proof || coalesce(l, '') || coalesce(r, '') AS proof, CASE WHEN many THEN sha256(coalesce(l, '') || back || coalesce(r, '')) ELSE back END AS back "
            f"FROM {source} p JOIN (SELECT x.tree, x.idx, any_value(x.many) AS many, string_agg(y.h, '' ORDER BY y.idx) FILTER (WHERE y.idx < x.idx) AS l, string_agg(y.h, '' ORDER BY y.idx) FILTER (WHERE y.idx > x.idx) AS r "
            f"FROM (SELECT *, count(*) OVER (PARTITION BY tree) > 1 AS many FROM {name}{k}) x JOIN {name}{k} y ON x.tree = y.tree AND x.idx // 3 = y.idx // 3 GROUP BY 1, 2) s "
            f"ON s.tree = {tree} AND s.idx = {idx} // 3 ** {k}::BIGINT)".replace(f"3 ** {k}::BIGINT", str(3**k))
        )

    grow("a")
    parts.append(f"b0 AS MATERIALIZED (SELECT 0::BIGINT AS tree, tree AS idx, h FROM a{levels})")
    grow("b")
    parts.append("p0 AS MATERIALIZED (SELECT tree, idx, doc_id, leaf, '' AS proof, claim AS back FROM a0)")
    for k in range(levels):
        step("a", k, f"p{k}", f"p{k + 1}", "p.tree", "p.idx")
    for k in range(levels):
        step("b", k, f"p{levels + k}", f"p{levels + k + 1}", "0", "p.tree")
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, back AS folded_root, back = r.h AS verified "
        f"FROM p{2 * levels} p JOIN a{levels} s ON s.tree = p.tree CROSS JOIN b{levels} r"
    )
