"""The pipeline's stages one after the other, and the registration."""

import corpus_pipeline
from pyspark.sql import functions as F

from meltemi.llm import bpe_automaton
from meltemi.llm.queries import ORACLES, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns and out.dtypes == docs.dtypes, name
        out = out.cache()
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and len(now) > 0.5 * len(ids), name
        if name == "line_dedup":
            assert now == ids
        docs, ids = out, now
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.collect()} == ids


def test_run_is_the_stages_in_turn(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    rows = got.collect()
    assert len({r.doc_id for r in rows}) == len(rows) > 100
    assert all(r.n_tokens == len(r.ids) for r in rows)
    one = bpe_automaton.automaton(vocabulary())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(one.ids(text[r.doc_id]) == r.ids for r in rows)


def test_queries_are_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for k in range(1, 14) for n in QUERIES if n.startswith(f"op{k}_")]
    assert len(QUERIES) == 13 and set(ORACLES) <= set(QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe_encoding"]


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = " ".join(["q"] * 60_000)
    odd = [(9001, None), (9002, ""), (9003, "hello"), (9004, long), (9004, long), (9005, "\n\n"), (None, "of no name")]
    blank = {"source": None, "lang": None}
    rows = spark.createDataFrame(odd, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name not in blank else F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    clashing = docs.unionByName(rows).withColumns({c: F.lit(c) for c in ("kept_text", "n_lines", "id", "set_id", "score", "predicted", "kept", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns, name
        got = [r.doc_id for r in out.select("doc_id").collect()]
        assert {9001, 9002, 9003, 9004, 9005, None} <= set(got), name
        assert got.count(9004) == 2, name
        assert stage(spark, clashing.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clashing, SF).count() == clashing.count()
    bare = clashing.select("doc_id", "text")
    assert corpus_pipeline.drop_repeated_lines(spark, bare, SF).columns == bare.columns
