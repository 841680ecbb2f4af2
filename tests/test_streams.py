"""Streams that stop and go on: they equal the batch form; batches that come again count once."""

import random

import pytest
from pyspark.sql import functions as F

from casefile.operators import custody
from casefile.streaming import arrivals, state

SCHEMA = "k string, id long, us long"


def requests(n, seed):
    pick = random.Random(seed)
    return sorted(((pick.choice(["hot", "hot", "b", "c"]), k, pick.randrange(0, 50_000_000)) for k in range(n)), key=lambda r: (r[2], r[1]))


def timed(df):
    return df.withColumn("ts", F.timestamp_micros("us"))


def drop_in(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def collected(spark, stream, at):
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return sorted(map(tuple, spark.read.schema(stream.schema).parquet(f"{at}/rows").collect()))


@pytest.mark.parametrize("fixed", [False, True])
def test_limits_go_on_after_a_restart(spark, tmp_path, fixed):
    rows = requests(160, 1)
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    got = []
    for part in (rows[:70], rows[70:]):
        drop_in(spark, part, SCHEMA, path)
        stream = state.limited(timed(spark.readStream.schema(SCHEMA).parquet(path)), "k", 5, 4, fixed)
        got = collected(spark, stream, at)
    assert got == sorted(map(tuple, state.limited_batch(timed(spark.createDataFrame(rows, SCHEMA)), "k", 5, 4, fixed).collect()))


@pytest.mark.parametrize("fixed", [False, True])
def test_a_stream_takes_up_from_a_table(spark, tmp_path, fixed):
    rows = requests(160, 2)
    path = str(tmp_path / "in")
    drop_in(spark, rows[90:], SCHEMA, path)
    before = state.limit_state(timed(spark.createDataFrame(rows[:90], SCHEMA)), "k", 5, 4, fixed)
    got = collected(spark, state.limited(timed(spark.readStream.schema(SCHEMA).parquet(path)), "k", 5, 4, fixed, initial=before), str(tmp_path / "out"))
    later = {r[1] for r in rows[90:]}
    assert got == sorted(tuple(r) for r in state.limited_batch(timed(spark.createDataFrame(rows, SCHEMA)), "k", 5, 4, fixed).collect() if r["id"] in later)


def test_custody_breaks_over_a_restart_and_after_a_table(spark, tmp_path):
    schema = "evidence_id long, id long, us long, input_hash string, output_hash string"
    rows = [(k % 3, k, k * 1_000, "broken" if k in (7, 20, 33) else f"h{k - 3}", f"h{k}") for k in range(40)]
    path, at, got = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in (rows[10:21], rows[21:]):
        drop_in(spark, part, schema, path)
        first = timed(spark.createDataFrame(rows[:10], schema))
        got = collected(spark, state.custody_breaks(timed(spark.readStream.schema(schema).parquet(path)), initial=first), at)
    assert [(r[0], r[1]) for r in got] == [("0", 33), ("2", 20)]
    assert {r["idx"] for r in custody.issues(timed(spark.createDataFrame(rows, schema))).collect()} == {2, 6, 11}


def test_stage_counts_after_each_batch(spark, tmp_path):
    schema = "evidence_id long, id long, us long, stage string"
    pick = random.Random(4)
    path, at, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for part in range(3):
        rows = [(pick.randrange(12), 100 * part + k, pick.randrange(1_000_000) + part * 500_000, pick.choice(["ocr", "fusion", "done"])) for k in range(25)]
        seen += rows
        drop_in(spark, rows, schema, path)
        stream = timed(spark.readStream.schema(schema).parquet(path))
        arrivals.run_batches(state.stage_changes(stream), lambda df: {"changes": df}, at, mode="update").awaitTermination()
        latest = {}
        for e, id_, us, stage in sorted(seen, key=lambda r: (r[2], r[1])):
            latest[e] = stage
        want = {s: list(latest.values()).count(s) for s in set(latest.values())}
        assert {r["stage"]: r["n"] for r in state.stage_counts(arrivals.written(spark, at, "changes")).collect()} == want


EVIDENCE = "evidence_id long, evidence_type string, text string, raw binary, status string"


def test_evidence_to_gate_and_a_batch_that_comes_again(spark, tmp_path):
    path, at = str(tmp_path / "in"), str(tmp_path / "out")
    drop_in(spark, [(1, "text", "you always do this and it's your fault " * 3, None, "pending"), (2, "text", None, None, "pending"), (3, "text", "x", None, "analyzed")], EVIDENCE, path)
    stream = lambda: spark.readStream.schema(EVIDENCE).parquet(path)
    arrivals.process_arrivals(stream(), at).awaitTermination()
    drop_in(spark, [(4, "text", "later " * 20, None, "pending")], EVIDENCE, path)
    arrivals.process_arrivals(stream(), at).awaitTermination()
    tables = lambda: [sorted(map(tuple, arrivals.written(spark, at, n).drop("batch").collect()), key=repr) for n in ("evidence", "results", "custody")]
    first = tables()
    rows = {r["evidence_id"]: r for r in arrivals.written(spark, at, "evidence").collect()}
    assert set(rows) == {1, 2, 4} and rows[2]["status"] == "error" and rows[2]["routing"] == "blocked" and rows[1]["routing"] == "auto_ok"
    assert [len(t) for t in first] == [3, 6, 12]
    chains = arrivals.written(spark, at, "custody").withColumn("ts", F.lit(0))
    assert all(r["valid"] and r["entries"] == 4 for r in custody.verify(chains, "original_hash").collect())
    # The second batch again, as after a failure before it was noted as done; and one that failed half-way.
    again = spark.read.schema(EVIDENCE).parquet(path).filter("evidence_id = 4").drop("status")
    arrivals.write_batch(arrivals.analysed(again), at, 1)
    assert tables() == first
    arrivals.analysed(again)["results"].write.parquet(f"{at}/results/batch=2")
    assert tables() == first


def test_an_analyser_appends_results_with_its_critique(spark):
    from casefile.operators.analysis import ResultAnalyser

    evidence = spark.createDataFrame([(1, "a b c", None), (2, "x", "unreadable"), (3, None, None)], "evidence_id long, text string, error string")
    results = spark.createDataFrame([(1, 4, "ocr", 0.5, "{}", [], 0.5)], "evidence_id long, seq int, agent_type string, confidence double, findings string, errors array<string>, critique double")
    length = F.coalesce(F.length("text"), F.lit(0))
    counting = ResultAnalyser("length", F.lit(0.7), {"chars": length, "blank": length == 0}, F.col("error"))
    got = {(r["evidence_id"], r["seq"]): r for r in counting.apply(evidence, results).collect()}
    assert set(got) == {(1, 4), (1, 5), (2, 0), (3, 0)}
    assert got[1, 5]["critique"] == pytest.approx(0.74) and got[1, 5]["findings"] == '{"chars":5,"blank":false}' and got[1, 5]["errors"] == []
    assert got[2, 0]["errors"] == ["unreadable"] and got[2, 0]["confidence"] == 0 and got[2, 0]["critique"] == 0


def test_a_content_counts_again_once_its_time_is_over(spark, tmp_path):
    schema, path, at, day = "id long, us long, sha256 string", str(tmp_path / "in"), str(tmp_path / "out"), 86_400_000_000
    for rows in ([(1, day // 2, "A")], [(2, day, "A"), (3, 5 * day, "A"), (4, 70 * day, "B")], [(5, 71 * day, "A"), (6, 72 * day, "B")]):
        drop_in(spark, rows, schema, path)
        stream = state.first_by_content(timed(spark.readStream.schema(schema).parquet(path)), "30 days").select("id", "sha256")
        got = collected(spark, stream, at)
    assert got == [(1, "A"), (4, "B"), (5, "A")]
