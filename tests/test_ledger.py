"""Batches that count once, and the replay log on top of them."""

import glob
import os
import random

import pytest

from maskwright.streaming import ledger
from maskwright.streaming import scan as stream_ops

FOUND = "id long, detector string, hit string"
CHANGES = "id long, role string, turn long, text string"


def ids(spark, path, df):
    return sorted((r.id, r.detector, r.hit) for r in ledger.rows(spark, path, df.schema, "detector").collect())


def test_batches_count_once(spark, tmp_path):
    path, made = f"{tmp_path}/t", lambda rows: spark.createDataFrame(rows, FOUND)
    a, b = made([(1, "email", "x"), (2, "card", None), (3, None, "z")]), made([(4, "email", "y")])
    assert ids(spark, path, a) == []
    ledger.put(a, 0, path, "detector")
    ledger.put(a, 0, path, "detector")
    whole = ids(spark, path, a.where("detector is not null"))
    assert [x for x in whole if x[1]] == [(1, "email", "x"), (2, "card", None)] and len(whole) == 3
    ledger.put(a.limit(0), 1, path, "detector")
    b.selectExpr("*", "2 AS batch").write.partitionBy("detector", "batch").mode("append").parquet(f"{path}/data")  # killed before its entry
    assert len(ids(spark, path, a)) == 3
    ledger.put(b, 2, path, "detector")
    assert [x for x in ids(spark, path, a) if x[0] == 4] == [(4, "email", "y")]
    assert sorted(os.listdir(f"{path}/data/detector=email"))[:2] == ["batch=0", "batch=2"]


def test_stream_killed_before_the_entry(spark, tmp_path, monkeypatch):
    for k in range(3):
        spark.createDataFrame([(k * 10 + i, "ab"[i % 2], "h") for i in range(4)], FOUND).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(FOUND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ledger.run_to_end(stream, f"{tmp_path}/t", f"{tmp_path}/cp", "detector")
    enter = ledger._enter

    def dies(counts, path):
        if path.endswith("batch=1"):
            raise RuntimeError("killed")
        enter(counts, path)
    monkeypatch.setattr(ledger, "_enter", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    df = spark.createDataFrame([], FOUND)
    assert [x[0] for x in ids(spark, f"{tmp_path}/t", df)] == [0, 1, 2, 3]
    monkeypatch.setattr(ledger, "_enter", enter)
    run()
    assert [x[0] for x in ids(spark, f"{tmp_path}/t", df)] == [k * 10 + i for k in range(3) for i in range(4)]


def test_replay_log(spark, tmp_path):
    rnd, path, want = random.Random(5), f"{tmp_path}/log", {}
    schema = spark.createDataFrame([], CHANGES).schema
    assert ledger.current(spark, path, schema, ["id", "role"], "turn").count() == 0

    def run(parts):
        for part in parts:
            spark.createDataFrame(part, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            for i, role, turn, text in part:
                if turn >= want.get((i, role), (-1, ""))[0]:
                    want[i, role] = (turn, text)
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        ledger.log_changes(stream, path, f"{tmp_path}/cp", ["id", "role"], "turn", buckets=4)

    def held():
        return {(r.id, r.role): (r.turn, r.text) for r in ledger.current(spark, path, schema, ["id", "role"], "turn").collect()}

    def part(ids):
        return [(i, rnd.choice(["a", None]), turn, f"{i}-{turn}") for i in ids for turn in rnd.sample(range(100), 3)]
    run([part([1, 2, 3, 4, 5, 6]), part([1, 2, 3])])
    assert held() == want
    before = set(glob.glob(f"{path}/delta/data/**/*.parquet", recursive=True))
    touched = ledger.compact(spark, path, schema, ["id", "role"], "turn", batches=2)
    assert 0 < touched <= 4 and held() == want
    assert len(glob.glob(f"{path}/base/data/bucket=*")) == touched
    assert ledger.compact(spark, path, schema, ["id", "role"], "turn", batches=2) == 0
    run([part([2, 7])])
    assert held() == want and before <= set(glob.glob(f"{path}/delta/data/**/*.parquet", recursive=True))
    batch = spark.createDataFrame([(2, "a", 999, "again")], CHANGES).withColumn("bucket", ledger.bucket_of(["id", "role"], 4))
    ledger.put(batch, 0, f"{path}/delta", "bucket")  # batch 0 is in the ledger
    assert held() == want
