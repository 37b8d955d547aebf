"""The mixing schedule and the Merkle manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from meltemi.llm import merkle, source_mix


def made(spark, rows):
    """(doc_id, source, text) as a table whose other columns have the operators' own names."""
    return spark.createDataFrame([(d, t, "en", s, 3, 1, "x", 2.0) for d, s, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, slot string, target double")


# ---- mixing ----


def wanted(docs, weights=(1, 2, 3), repeats=3):
    """Targets by capping and sharing again until none is above."""
    size = Counter()
    for _, source, text in docs:
        size[source] += len((text or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, target = set(), {}
    while True:
        left = sum(size.values()) - sum(repeats * size[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: Fraction(repeats * size[s]) if s in capped else Fraction(left * weight[s], free) for s in order}
        above = {s for s in order if s not in capped and target[s] > repeats * size[s]}
        if not above:
            return size, target
        capped |= above


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["hot", "b", "ż", "a", None, "B", "tiny", "empty"]
    docs = [(i, rng.choices(names, [20, 3, 3, 3, 2, 2, 0, 0])[0], " ".join("w" for _ in range(rng.randrange(0, 90)))) for i in range(n)]
    return docs + [(n, "tiny", "one two"), (n + 1, "empty", None), (n + 2, "empty", ""), (n + 3, "hot", "w " * 20_000), (None, "a", "x y"), (3, "b", "again"), (3, "b", "again")]


@pytest.mark.parametrize("block", [7, 64])
def test_taken_words(spark, block):
    docs = corpus(1)
    size, target = wanted(docs)
    got = source_mix.mix_sources(made(spark, docs), block=block)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == len(docs)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, len((t or "").split())) for d, _, t in docs)
    total = Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        total[round(r.target, 6)] += r.taken
    for s in target:
        assert any(abs(r.target - float(target[s])) < 1e-6 * max(1, float(target[s])) and r.source_size == size[s] for r in rows)
    assert sum(total.values()) == sum(int(t) for t in target.values())
    for t, taken in total.items():
        assert taken == sum(int(x) for x in target.values() if round(float(x), 6) == t)
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix_sources(made(spark, docs).repartition(5), block=block).collect()))


def test_schedule_is_spread_evenly_and_repeats_by_epoch(spark):
    docs = corpus(2)
    mix = source_mix.plan(made(spark, docs), block=16)
    target = {r.src: r.target for r in mix.sources.collect()}
    source_size = {r.src: r.source_size for r in mix.sources.collect()}
    slots = sorted(mix.slots.collect())
    assert len({s.slot for s in slots}) == len(slots)
    per = defaultdict(list)
    for s in slots:
        per[s.src].append(s)
    for src, mine in per.items():
        blocks = -(-source_size[src] // 16)
        assert [(s.epoch, s.block) for s in mine] == [divmod(r, blocks) for r in range(len(mine))]
        assert sum(s.words for s in mine) == int(target[src])
    # Any beginning of the schedule holds every source in proportion, to within a few blocks.
    had, whole = Counter(), sum(len(m) for m in per.values())
    for n, s in enumerate(slots, 1):
        had[s.src] += 1
        if n <= whole - 20:
            assert all(abs(had[x] - n * len(per[x]) / whole) < 6 for x in per)
    # The stream has every word of a full epoch once, in pieces that lie within their documents.
    words = Counter()
    for r in source_mix.mixture(mix).collect():
        assert r.n_words > 0 and r.from_word >= 0
        words[r.src, r.epoch] += r.n_words
    for (src, epoch), n in words.items():
        assert n == min(source_size[src], int(target[src]) - epoch * source_size[src])


def test_mix_of_little(spark):
    assert source_mix.mix_sources(made(spark, [])).count() == 0
    assert [tuple(r) for r in source_mix.mix_sources(made(spark, [(1, "a", None), (2, None, "")])).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    alone = source_mix.mix_sources(made(spark, [(1, "a", "x y z")])).collect()
    assert [(r.size, r.target, r.taken) for r in alone] == [(3, 3.0, 3)]


# ---- manifest ----


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """(root, [steps of (left, right) per leaf])"""
    nodes, steps, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            steps[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        at = [k // 3 for k in at]
        nodes = [sha("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], steps


def brute(docs):
    groups = defaultdict(list)
    for d, s, t in docs:
        leaf = coded(d, s, "en", 3, t)
        bad = d is not None and zlib.crc32(str(d).encode()) % 2 == 0
        groups[s].append((d is not None, d or 0, leaf, d, coded(d, s, "en", 3, t.replace("\n", "") if t and bad else t)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    root, tops = tree([built[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, leaf, d, claim), steps in zip(sorted(groups[s]), built[s][1]):
            back = claim
            for left, right in steps + top:
                back = sha(left + back + right)
            out.append((d, leaf, built[s][0], root, sha("".join(a + b for a, b in steps + top)), back, back == root))
    return out


def check(spark, docs, parts=3, **how):
    got = merkle.manifest(made(spark, docs).repartition(parts), tampered=merkle.even_crc(), **how)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute(docs)))


def test_manifest(spark):
    rng = random.Random(3)
    docs = [(i, rng.choice(["hot", "hot", "a", "B", "ż", None, ""]), rng.choice(["one\nline", "none", "", None, "x\n" * 3000, "ż\n"])) for i in range(2200)]
    docs += [(None, "a", "t"), (None, None, "u\n"), (7, "hot", "same\n"), (7, "hot", "same\n"), (7, "hot", "other"), (5000, "lone", "one\ntwo")]
    check(spark, docs)


@pytest.mark.parametrize("n", [1, 3, 4, 10])
def test_manifest_of_few(spark, n):
    check(spark, [(i, "s", f"{i}\n") for i in range(n)], 2)
    if n == 4:
        check(spark, [(i, f"s{i}", "a\nb") for i in range(n)], 2)


def test_manifest_in_several_sweeps(spark):
    check(spark, [(i, ["a", "b", None][i % 7 % 3], f"{i}\n{i % 5}") for i in range(300)] + [(900 + i, f"s{i:02d}", "x\n") for i in range(12)], levels=2)


def test_manifest_of_nothing_and_without_tampering(spark):
    assert merkle.manifest(made(spark, [])).count() == 0
    got = merkle.manifest(made(spark, corpus(3, 50))).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1


def test_swept_queue_is_in_label_order():
    labels = [(level, index) for level, index, _ in merkle.swept([(i, sha(str(i))) for i in range(9, 36)], 3)]
    assert labels == sorted(labels) and labels[0] == (1, 3) and labels[-1] == (3, 1)
