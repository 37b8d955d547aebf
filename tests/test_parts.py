"""Part tables: every batch once, few parts whatever the number of batches, readers undisturbed."""

import os

from pyspark.sql import functions as F

from meltemi.sources.parts import Part, PartTable, due


def test_parts_of_many_batches_stay_few():
    parts, rewritten, most = [], 0, 0
    for batch in range(1000):
        parts.append(Part(str(batch), 0, batch, batch, 1))
        while old := due(parts, 4, 4):
            rewritten += sum(p.size for p in old)
            parts = [p for p in parts if p not in old] + [Part(f"{old[0].first}+", old[0].level + 1, old[0].first, old[-1].last, sum(p.size for p in old))]
        most = max(most, len(parts))
        assert sorted(b for p in parts for b in range(p.first, p.last + 1)) == list(range(batch + 1))
    assert most <= 3 * 4 + 1000 // 4**4 and rewritten <= 4 * 1000


def test_every_batch_once_and_readers_go_on(spark, folder):
    events = spark.range(120).selectExpr("timestamp_seconds(1776000000 + id * 3000) as timestamp", "cast(id % 3 as string) as turbine_id", "id")
    table = PartTable(folder, events.schema, order=("turbine_id", "timestamp"), fan=3, levels=2, keep=4)
    assert table.read(spark).count() == 0
    early = None
    for batch in range(10):
        mine = events.where(F.col("id") % 10 == batch)
        table.commit(mine, batch)
        table.commit(mine, batch)
        if batch == 7:
            early = table.read(spark)
    assert sorted(r.id for r in early.collect()) == [i for i in range(120) if i % 10 <= 7]
    got = table.read(spark)
    assert sorted(r.id for r in got.collect()) == list(range(120))
    assert got.where("event_date <> to_date(timestamp)").count() == 0
    assert [(p.level, p.first, p.last) for p in table.live(spark)] == [(2, 0, 8), (0, 9, 9)]
    days = got.withColumn("file", F.input_file_name()).select("event_date", "file").distinct().groupBy("event_date").agg(F.count("*").alias("n")).collect()
    assert max(d.n for d in days) <= 2
    named = {f"part={p.name}" for g in table.generations(spark) for p in table.live(spark, g)}
    assert len(table.generations(spark)) <= 5 and set(os.listdir(f"{folder}/data")) == named


def test_a_batch_without_rows(spark, folder):
    events = spark.range(5).selectExpr("timestamp_seconds(1776000000 + id) as timestamp", "id")
    table = PartTable(folder, events.schema, fan=2, levels=2)
    for batch, n in enumerate((0, 5, 0, 0)):
        table.commit(events.where(F.col("id") < n), batch)
    assert table.read(spark).count() == 5
