"""Ranked search by pair-bound MaxScore against scoring every document."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from meltemi.llm import lexical

TERM = re.compile(lexical.TERM)


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    """[(item, rank, doc, score)] of lists of (id, text)."""
    told = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in told), sum(sum(c.values()) for _, c in told)
    held = Counter(t for _, c in told for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in told:
            m = 75 + 25 * sum(c.values()) * n_docs // max(1, length)
            s = sum(n * weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, n in Counter(terms(text)).items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d, s))
        out += [(item, r + 1, d, s) for r, (_, _, d, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] if x[2] is not None else 0))[:k])]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def made(spark, docs, key="doc_id", kind="long"):
    return spark.createDataFrame([(d, t, "x", 1, "s") for d, t in docs], f"{key} {kind}, text string, term string, shard int, item_id string")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(300)]
    docs += [(300 + i, docs[0][1].upper()) for i in range(40)]  # more equal scores than places
    docs += [(400, None), (401, ""), (402, "?! ..."), (403, " ".join(rng.choices(words, k=30_000))), (404, "Straße, ŻÓŁĆ straße"), (5, docs[5][1]), (None, docs[7][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    items += [(30, docs[0][1]), (31, None), (32, ""), (33, "nowhere at all zzz"), (34, "straße Żółć"), (35, "w1 w1 w1 w2"), (35, "w1 w1 w1 w2"), (36, docs[7][1]), (36, "w2 w3")]
    return docs, items


def test_every_rank_and_score(spark, corpus, monkeypatch):
    docs, items = corpus
    want = sorted(brute(docs, items), key=str)
    table, asked = made(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert rows(lexical.search(table, asked)) == want
    # Many shards, a first round with several of them, and items in blocks: the same rows.
    monkeypatch.setattr(lexical, "FIRST", 2)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 100)
    assert rows(lexical.search(table, asked, shard_bytes=1500)) == want
    assert rows(lexical.search(table, asked, k=3, shard_bytes=1500)) == sorted(brute(docs, items, 3), key=str)


def test_string_keys_and_empty_tables(spark, corpus):
    docs, items = corpus
    asked = spark.createDataFrame(items[:3], "item_id long, text string")
    named = [(f"k{d:04d}", t) for d, t in docs if d is not None]
    got = lexical.search(made(spark, named, "name", "string"), asked, key="name")
    assert got.columns == ["item_id", "rank", "name", "score"]
    assert rows(got) == sorted([(i, r, f"k{d:04d}", s) for i, r, d, s in brute([x for x in docs if x[0] is not None], items[:3])], key=str)
    assert lexical.search(made(spark, docs).limit(0), asked).count() == 0
    assert lexical.search(made(spark, docs), asked.limit(0)).count() == 0
    assert lexical.search(made(spark, [(1, None), (2, "")]), asked).count() == 0


def shard_of(texts):
    counts, names, borders, owner, tf = lexical._postings(pa.array(texts))
    own = {"term": [None], "docs": [None], "tfs": [None], "keys": [list(range(len(texts)))], "sizes": [counts.tolist()]}
    for k, name in enumerate(names.to_pylist()):
        a, b = borders[k], borders[k + 1]
        for column, value in (("term", name), ("docs", owner[a:b].tobytes()), ("tfs", tf[a:b].tobytes()), ("keys", None), ("sizes", None)):
            own[column].append(value)
    return lexical.Shard(pa.table(own), dict.fromkeys(names.to_pylist(), 1000), len(texts), int(counts.sum()))


def test_pair_bounds_hold_and_are_tighter():
    rng = random.Random(8)
    shard = shard_of([" ".join(rng.choices("abcdefghij", k=rng.randrange(1, 7))) for _ in range(60)])
    tighter = 0
    for _ in range(200):
        asked = [(t, rng.randrange(1, 4)) for t in rng.sample("abcdefghij", rng.randrange(1, 6))]
        bounds = shard.bounds(asked)
        for p in range(len(asked) + 1):
            best = [0] * 60
            for term, n in asked[:p]:
                for d, impact in zip(*shard.lists[term]):
                    best[d] += n * int(impact)
            assert max(best) <= bounds[p]
            tighter += bounds[p] < sum(n * shard.most[t] for t, n in asked[:p])
    assert tighter > 100


def test_terms_are_told_apart_by_their_bytes():
    """Words whose polynomials modulo 2^64 are equal stay two terms."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    _, names, _, _, _ = lexical._postings(pa.array([word + " " + other]))
    assert sorted(names.to_pylist()) == sorted([word, other])
