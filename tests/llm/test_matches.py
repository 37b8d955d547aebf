"""Decontamination, chunk and byte-string deduplication, near duplicates and near vectors against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meltemi.llm import bwt_merge, chosen_path, components, itq, line_chunks, suffix_match
from meltemi.llm.words import Words
from meltemi.session import settled


def spoken(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, hit string, n_words int")


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def contaminated():
    rng = random.Random(1)
    items = [spoken(rng, 40), spoken(rng, 12), "Short item here", "", None, "!!!", spoken(rng, 11), spoken(rng, 10)]
    items.append(items[7])
    a = items[0].split()
    texts = [None, "", "...", items[0], "x " + " ".join(a[5:25]).upper() + " y " + " ".join(a[20:40]), " ".join(a[:9]), "so Short, item; HERE it is, short item", items[7] + "." + items[7], spoken(rng, 5000) + " " + items[6]]
    return items, texts + [spoken(rng, 200) for _ in range(20)] + [texts[4]]


def hits(text, windows):
    words, marked, found = ALNUM.findall(lowered(text)), set(), set()
    for w, ids in windows.items():
        for k in range(len(words) - len(w) + 1):
            if tuple(words[k : k + len(w)]) == w:
                marked |= set(range(k, k + len(w)))
                found |= ids
    return len(words), marked, found


def test_decontamination(spark, contaminated):
    items, texts = contaminated
    windows = {}
    for i, t in enumerate(items):
        words = ALNUM.findall(lowered(t))
        n = min(10, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[k : k + n]), set()).add(str(i))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts).repartition(3)
    got = {r.doc_id: r for r in suffix_match.digests(docs, bench).collect()}
    clean = {r.doc_id for r in suffix_match.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, marked, found = hits(t, windows)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(marked), len(found), bool(marked)), t
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (i in clean) == (not marked)
    assert suffix_match.decontaminate(docs, bench).columns == docs.columns


def test_decontamination_in_blocks_and_with_nothing(spark, contaminated, monkeypatch):
    items, texts = contaminated
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, texts)
    whole = sorted(map(tuple, suffix_match.digests(docs, bench).collect()))
    monkeypatch.setattr(suffix_match, "BLOCK_BYTES", 120)
    assert sorted(map(tuple, suffix_match.digests(docs, bench).collect())) == whole
    assert suffix_match.digests(docs, bench.limit(0)).where("contaminated").count() == 0
    assert suffix_match.digests(docs.limit(0), bench).count() == 0


def test_decontamination_by_a_large_benchmark(spark):
    """Some 4.4 MB of items: more than one broadcast takes, a long item among them, and a third of all items with one text."""
    rng = random.Random(9)
    items = [spoken(rng, 1200, 10**6) for _ in range(400)] + [spoken(rng, 160_000, 10**6)]
    items += ["the very same words stand in each of these items here"] * 200
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    long = items[400].split()
    texts = [" ".join(long[131_000:131_200]), "x " + " ".join(items[7].split()[50:61]) + " y", items[-1] + " x", spoken(rng, 50, 10**6), " ".join(long[-10:])]
    got = {r.doc_id: r for r in suffix_match.scan(frame(spark, texts).repartition(2), bench).collect()}
    assert [len(got[i].hit) for i in range(5)] == [200, 11, 11, 0, 10]
    assert [got[i].items for i in range(5)] == [["400"], ["7"], sorted(str(k) for k in range(401, 601)), [], ["400"]]


def test_pieces_of_items_and_many_ids(spark, contaminated, monkeypatch):
    items, texts = contaminated
    bench = spark.createDataFrame(list(enumerate(items * 2)), "item_id long, text string")
    docs = frame(spark, texts)
    whole = sorted(map(tuple, suffix_match.digests(docs, bench).collect()))
    longest = sorted(map(tuple, suffix_match.longest_matches(docs, bench).collect()))
    for name, value in (("PIECE", 7), ("HELD", 1), ("LOOKED_UP", 3), ("IDS", 2)):
        monkeypatch.setattr(suffix_match, name, value)
    assert sorted(map(tuple, suffix_match.digests(docs, bench).collect())) == whole
    assert sorted(map(tuple, suffix_match.longest_matches(docs, bench).collect())) == longest


def test_longest_matches_name_the_place(spark, contaminated):
    items, texts = contaminated
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = {(r.item_id, r.item_word): r for r in suffix_match.longest_matches(frame(spark, texts), bench).collect()}
    assert (rows["0", 0].doc_id, rows["0", 0].doc_word, rows["0", 0].n_words) == (3, 0, 40)
    assert rows["0", 30].n_words == 10
    assert rows["2", 0].n_words == 3


def test_suffix_array_is_sorted_across_ties():
    rng = random.Random(2)
    copy = spoken(rng, 300)
    texts = [copy, copy, "a a a a a a a a", "", None, spoken(rng, 100, 3), copy[:200]]
    words = Words(pa.array(texts, pa.string()))
    array = suffix_match.SuffixArray(words.prints, words.first[1:])

    def suffix(p):
        s = array.sequence[p : p + suffix_match.DEPTH].tolist()
        return s[: s.index(0)] if 0 in s else s

    order = [suffix(p) for p in array.order]
    assert order == sorted(order) and sorted(array.order.tolist()) == list(range(len(order)))


def chunked(texts):
    """(lines kept, lines removed, chunks removed) of every text, chunk by chunk in order."""
    seen, out = {}, []
    for t in texts:
        if t is None:
            out.append((None, 0, 0, 0))
            continue
        lines = t.split("\n")
        hashes = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        kept, gone, chunks, start = [], 0, 0, 0
        for i in range(len(lines)):
            r = 0
            for back in reversed(range(line_chunks.WINDOW)):
                r = (r * line_chunks.FACTOR + (hashes[i - back] if i >= back else 0)) % line_chunks.MODULUS
            if r % line_chunks.EVERY == 0 or i == len(lines) - 1:
                body = "\n".join(lines[start : i + 1])
                if i > start and body in seen:
                    gone, chunks = gone + i + 1 - start, chunks + 1
                else:
                    kept += lines[start : i + 1]
                    if i > start:
                        seen[body] = True
                start = i + 1
        out.append(("\n".join(kept), len(lines), gone, chunks))
    return out


def test_line_chunks(spark):
    rng = random.Random(3)
    lines = [spoken(rng, 6) for _ in range(40)]
    texts = [None, "", "\n", "\n\n\n\n\n\n\n\n", "one line", "one line", "\n".join(lines), "new\n" + "\n".join(lines), "\n".join(lines[:20] + ["inserted"] + lines[20:]), "\n".join(lines + lines), "x\r\ny\r\n" * 50]
    got = {r.doc_id: r for r in line_chunks.dedup_lines(frame(spark, texts).repartition(3)).collect()}
    for i, want in enumerate(chunked(texts)):
        assert (got[i].kept_text, got[i].n_lines, got[i].n_removed_lines, got[i].n_removed_chunks) == want, i
    assert got[7].n_removed_lines >= 30 and got[8].n_removed_lines >= 30


def test_line_chunks_of_repeated_rows_and_null_keys(spark):
    text = "\n".join(f"line {i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = line_chunks.dedup_lines(docs).collect()
    # The null key comes first; rows of key 1 are one document.
    assert sorted((r.doc_id or 0, r.n_removed_lines > 0) for r in got) == [(0, False), (1, True), (1, True), (2, True)]
    assert line_chunks.dedup_lines(docs.limit(0)).count() == 0


def test_paired_line_chunks_leave_no_single_lines(spark):
    rng = random.Random(10)
    lines = [spoken(rng, 6) for _ in range(60)]
    texts = ["\n".join(lines), "\n".join(lines), "first\n" + "\n".join(lines[5:30]) + "\nlast", "one", "one", "a\nb", "a\nb", None, "", "a\nb\nc", "a\nb\nc"]
    docs = frame(spark, texts).repartition(3)
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs, paired=True).collect()}
    sizes = [e - s for r in line_chunks.with_lines(docs.where("text is not null"), "text", True).collect() for s, e in zip([-1, *r._ends], r._ends) if len(r._lines) > 1]
    assert min(sizes) >= 2
    # The second of two equal texts goes whole; a passage loses all but its edges.
    assert [got[i].n_removed_lines for i in (0, 1, 3, 4, 5, 6, 7, 8, 9, 10)] == [0, 60, 0, 0, 0, 2, 0, 0, 0, 3]
    assert got[1].kept_text == "" and got[4].kept_text == "one" and got[7].kept_text is None
    assert got[2].n_removed_lines >= 15 and got[2].kept_text.startswith("first\n") and got[2].kept_text.endswith("last")
    now = [line for line in texts[2].split("\n") if line not in got[2].kept_text.split("\n")]
    assert len(now) == got[2].n_removed_lines and set(now) <= set(lines)


def test_the_pipeline_removes_whole_copies(spark):
    text = "\n".join(f"line {i} of the text" for i in range(40))
    docs = spark.createDataFrame([(1, text, 1), (2, text, 1)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == {1: text, 2: ""}


def stripped(texts):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(raw[s : s + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("together", [bwt_merge.TOGETHER, 1])
def test_repeated_bytes(spark, monkeypatch, together):
    monkeypatch.setattr(bwt_merge, "TOGETHER", together)
    rng = random.Random(4)
    base = spoken(rng, 300)
    texts = [None, "", "short", "a" * 1000, "ab" * 300, "x" + "a" * 250, base, base, "head " + base[100:700] + " tail", base[:99], base[:100], base[1:101], base[300:450] + base[300:450] + base[350:520], "é" * 200, "zé" * 120]
    texts += [spoken(rng, 30) + base[k : k + 140] + spoken(rng, 30) for k in range(0, 900, 37)]
    got = {r.doc_id: r for r in bwt_merge.remove_repeats(frame(spark, texts).repartition(4)).collect()}
    for i, want in enumerate(stripped(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, (i, texts[i])


def test_repeated_bytes_of_repeated_rows(spark):
    text = "repeat " * 3 + "".join(chr(97 + i % 23) for i in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed) for r in bwt_merge.remove_repeats(docs).collect())
    first = stripped([text])[0][1]
    assert got == [(0, 0), (1, first), (1, first), (2, len(text))]
    assert bwt_merge.remove_repeats(docs.limit(0)).count() == 0


def test_spans_that_share_less_than_a_string_are_not_read(spark):
    """A common phrase of 50 bytes makes anchors of equal grams everywhere, and no string of 100 bytes repeats."""
    rng = random.Random(9)
    phrase = "".join(rng.choice("abcdefgh") for _ in range(50))
    some = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [some(150 + k) + phrase + some(150) for k in range(60)]
    docs = frame(spark, texts).select(F.col("doc_id").alias("doc"), F.hash("text").alias("print"), "text")
    assert bwt_merge._judged(bwt_merge._bucketed(docs, 4)).count() == 0
    # Passages of 99 bytes do not repeat, those of 100 and more do, wherever their anchors are.
    for n in range(99, 190, 7):
        passage = some(n)
        texts += [some(40) + passage + some(60), some(70) + passage, passage + some(90)]
    got = {r.doc_id: r for r in bwt_merge.remove_repeats(frame(spark, texts)).collect()}
    for i, want in enumerate(stripped(texts)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want, (i, texts[i])


def test_settled_tables_leave_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {str(blocks.apply(i)) for i in range(blocks.size()) if str(blocks.apply(i)).startswith("shuffle_")}

    before = files()
    out = settled(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not files() - before
    assert out.count() == 7


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def closure(sets, linked):
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def variants(rng, base, n, rate):
    out = []
    for _ in range(n):
        words = base.split()
        for k in range(len(words)):
            if rng.random() < rate:
                words[k] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("small", [24, 4])
def test_near_duplicates(spark, small):
    rng = random.Random(5)
    texts = [None, "", " \t", "one", "one", "One two", "one two three four", "one two three four five"]
    for _ in range(4):
        base = spoken(rng, 250, 5000)
        texts += [base, *variants(rng, base, 12, 0.01), *variants(rng, base, 12, 0.03)]
    line = spoken(rng, 60, 5000)
    texts += [line + " " + spoken(rng, 40, 5000) for _ in range(60)] + [spoken(rng, 80, 5000) for _ in range(40)]
    rng.shuffle(texts)
    sets = [shingled(t) for t in texts]
    want = closure(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b))
    out = chosen_path.near_duplicates(frame(spark, texts).repartition(3), paths=chosen_path.Paths(small=small)).collect()
    got = {r.doc_id: r for r in out}
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_sets_below_the_threshold_form_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = spoken(rng, 300, 5000)
    texts = variants(rng, base, 120, 0.031)
    sets = [shingled(t) for t in texts]
    between = [(len(a & b), len(a | b)) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(100 * x >= 48 * y for x, y in between) > 5000 > 50 * sum(100 * x >= 75 * y for x, y in between)
    made = []

    def counted(df, purpose, kept=chosen_path.settled):
        out = kept(df, purpose)
        made.append(out.count() if purpose in ("pairs", "confirmed") else 0)
        return out

    monkeypatch.setattr(chosen_path, "settled", counted)
    got = chosen_path.near_duplicates(frame(spark, texts), paths=chosen_path.Paths(small=4)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == closure(sets, lambda a, b: 100 * len(a & b) >= 75 * len(a | b))
    assert sum(made) < 1000


def test_minwise_values_agree_as_often_as_sets_are_similar():
    rng, p = np.random.default_rng(3), chosen_path.Paths()
    for n, common in ((1, 0), (3, 2), (20, 17), (150, 129), (3000, 2571)):
        sets = [np.sort(x[at]) for x in rng.integers(0, 1 << 63, (40, 2 * n - common), dtype=np.uint64) for at in (slice(n), slice(n - common, None))]
        tokens, bits = chosen_path._minwise(np.concatenate(sets), np.arange(len(sets) + 1) * n, p)
        share = common / (2 * n - common)
        assert abs((tokens[::2] == tokens[1::2]).mean() - share) < 0.03
        apart = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1, dtype=int)
        assert abs(apart.mean() - p.bits * (1 - share) / 2) < 10 and apart.std() < 1.5 * (p.bits * (1 - share**2) / 4) ** 0.5


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in chosen_path.near_duplicates(docs).collect()))
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert chosen_path.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(30, 32))
    rows = [c + rng.normal(0, s, 32) for c in centers for s in (0.02, 0.05, 0.1, 0.2)] + [centers[0]] * 20 + [centers[0] * 3]
    rows += [rng.normal(size=32) for _ in range(60)]
    vectors = [[float(x) for x in r] for r in rows]
    odd = [None, [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0], []]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors + odd)], "vec_id long, embedding array<float>, label int, n_links string").repartition(3)
    x = np.array(vectors, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in itq.near_vectors(table).collect()}
    assert len(got) == len(vectors) + len(odd)
    links = sum(got[i].n_links for i in range(len(vectors)))
    assert 0.9 * near.sum() <= links <= near.sum()
    for i in range(len(vectors)):
        assert got[i].n_links <= near[i].sum()
    for i in range(len(vectors), len(got)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert {got[i].component_id for i in range(120, 141)} == {got[120].component_id}
    assert itq.near_vectors(table.where("vec_id < 0")).count() == 0
    assert itq.near_vectors(table.where(F.col("embedding").isNull())).count() == 1


def concentrated(kind):
    rng = np.random.default_rng(11)
    one = rng.normal(size=24)
    one /= np.linalg.norm(one)
    noisy = lambda n, s: one + rng.normal(0, s / np.sqrt(24), (n, 24))
    return {
        "near copies": noisy(150, 0.05),
        "loose copies": noisy(150, 0.25),
        "common direction": noisy(200, 0.33),
        "wide cone with clusters": np.concatenate([noisy(80, 0.6)] + [v + rng.normal(0, 0.05, (4, 24)) for v in noisy(15, 0.6)]),
        "two alone": noisy(2, 0.05),
        "equal and near": np.concatenate([noisy(1, 0.1).repeat(100, axis=0), noisy(30, 0.1)]),
    }[kind]


@pytest.mark.parametrize("kind", ["near copies", "loose copies", "common direction", "wide cone with clusters", "two alone", "equal and near"])
def test_near_vectors_that_share_a_direction(spark, kind):
    """Recall per vector and components against all pairs, where no cluster stands alone."""
    vectors = [[float(v) for v in row] for row in concentrated(kind)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<float>").repartition(3)
    x = np.array(vectors, dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.id: r for r in itq.near_vectors(table, key="id").collect()}
    assert all(got[i].n_links <= near[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.9 * near.sum()
    want = closure(list(range(len(x))), lambda a, b: near[a, b])
    assert np.mean([got[i].component_id == want[i] for i in got]) >= 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def alike(n=1024):
    """Two different words whose polynomials modulo 2^64 agree for every odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_vectors_that_meet_by_chance_are_not_moved(spark, monkeypatch):
    """Keys of unlinked vectors are equal or one bit apart for a share of all pairs; only what may be a link is compared by whole vectors."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1_500, 64))
    x[1_400:] = x[:100] + 0.02 * rng.normal(size=(100, 64))
    table = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    compared, cosines = [], itq._cosines

    def counted(pairs, columns):
        compared.append(pairs.count())
        return cosines(pairs, columns)

    monkeypatch.setattr(itq, "_cosines", counted)
    got = {r.vec_id: r for r in itq.near_vectors(table).collect()}
    assert all(got[i].n_links == (i < 100 or i >= 1_400) and got[i].component_id == (i - 1_400 if i >= 1_400 else i) for i in range(len(x)))
    assert sum(compared) < 1_000, compared


@pytest.mark.parametrize("part", [4, 5])
def test_balls_meet_by_equal_keys_and_those_one_bit_off(spark, part):
    rng = np.random.default_rng(part)
    keys = rng.integers(0, 1 << part, size=(60, 3)) + (np.arange(3) << part)
    center = rng.integers(0, 25, size=60)
    rows = [(int(c), k.astype("<i8").tobytes(), bytes(8), 1.0, 0.0, 0.0) for c, k in zip(center, keys)]
    member = spark.createDataFrame(rows, "center long, keys binary, coarse binary, step float, off double, reach double")
    for tables in ([0, 1, 2], [1]):
        near = (np.bitwise_count(keys[:, None, tables] ^ keys[None, :, tables]) <= 1).any(axis=2)
        want = {(int(min(a, b)), int(max(a, b))) for a, b in zip(*(center[k] for k in np.nonzero(near))) if a != b}
        got = [(r.a, r.b) for r in itq._meetings(member, tables, part, np.pi).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_many_vectors_are_looked_up_by_longer_substrings():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(100, 64)), 4, axis=0)
    x += 0.01 * rng.normal(size=x.shape)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    assert itq.fit(x, itq.Tables(), 0.9, 10_000)[1].part == 16
    assert itq.fit(x, itq.Tables(), 0.9, 10_000_000)[1].part > 16


def test_different_words_stay_different(spark):
    one, other = alike()
    for kind in ("alnum", "blank"):
        prints = Words(pa.array([one, other, one.upper(), "x" * 5000, "x" * 5001]), kind).prints
        assert prints[0] == prints[2] and len(set(prints.tolist())) == 4
    docs = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert [r.component_id for r in chosen_path.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 2, 1]
    hit = suffix_match.digests(docs, spark.createDataFrame([(1, other)], "item_id long, text string"))
    assert [r.contaminated for r in hit.orderBy("doc_id").collect()] == [False, True, False]


def test_word_fingerprints_do_not_depend_on_place(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 40))) for _ in range(500)]
    alone = [Words(pa.array([w])).prints[0] for w in words]
    assert list(Words(pa.array([" ".join(words[:250]), None, " ".join(words[250:])])).prints) == alone
    assert len(set(map(int, alone))) == len(set(words))
