"""Findings of round 3: values on edges of bins, long recordings, packages, limits and hashes at size."""

import hashlib
import random
import time
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from casefile.functions import text
from casefile.operators import fusion, media, overlap
from casefile.plans.catalog import QUERIES, SQL
from casefile.sources import packed
from casefile.streaming import state


@pytest.mark.parametrize("values", [[0.0, 416.65, 499.98], [k / 100 for k in range(0, 49_999, 7)] + [499.98], [7.5, 7.5, 7.5], [1.0, None, 3.0], [0.0, 1.0, float("nan")]])
def test_histogram_puts_values_on_edges_where_its_sql_does(spark, tmp_path, values):
    rows = [(k, datetime(2024, 1, 1) + timedelta(seconds=k), k % 7, "view", v) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["agg7_histogram"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(SQL["agg7_histogram"]).fetchall())
    assert got.dtypes == [("bin", "bigint"), ("n", "bigint")]


def brute_hash(g):
    bits = "".join("01"[x > sum(g) / len(g)] for x in g[:64])
    return "".join(f"{int(bits[i : i + 4], 2):x}" for i in range(0, len(bits), 4))


def test_mean_hashes_take_time_by_cells_not_by_their_square(spark):
    pick = random.Random(3)
    grays = [[pick.randrange(256) for _ in range(pick.choice([64, 64, 3, 62, 80]))] for _ in range(6_000)]
    df = spark.createDataFrame(list(enumerate(grays)), "id long, g array<int>").coalesce(1)
    began = time.monotonic()
    got = dict(df.select("id", text.mean_hash(F.transform("g", lambda x: x + 0))).collect())
    assert time.monotonic() - began < 30  # one core; minutes where the mean is taken anew for each cell
    assert got == {k: brute_hash(g) for k, g in enumerate(grays)}


def brute_speakers(segments, turns):
    out = {}
    for audio, idx, a, b in segments:
        met = [(min(b, y) - max(a, x), -i, s) for other, i, x, y, s in turns if other == audio and x < b and y > a]
        out[audio, idx] = max(met)[2] if met else "UNKNOWN"
    return out


def test_speakers_of_long_recordings_equal_brute_force(spark, monkeypatch):
    """Intervals of all lengths, on a grid (so ends touch and overlaps tie), some empty, some from end to start."""
    monkeypatch.setattr(overlap, "FEW", 40)
    monkeypatch.setattr(overlap, "MOST", 64)
    pick = random.Random(5)

    def some(audio, n, span, turn):
        rows = []
        for k in range(n):
            a = pick.randrange(span) / 2
            rows.append((audio, pick.randrange(10**9), a, a + pick.choice([0, 0.5, 1, 2, 3, 9, 40, span / 3, -0.5, -7])) + ((f"s{k}",) if turn else ()))
        return rows

    segments = [r for a, n, s in (("hot", 700, 400), ("wide", 300, 100_000), ("small", 9, 20), ("alone", 3, 9)) for r in some(a, n, s, False)]
    turns = [r for a, n, s in (("hot", 900, 400), ("wide", 500, 100_000), ("small", 12, 20)) for r in some(a, n, s, True)]
    got = media.speakers(spark.createDataFrame(segments, "audio_id string, idx long, start double, end double"), spark.createDataFrame(turns, "audio_id string, idx long, start double, end double, speaker string"))
    assert {(r["audio_id"], r["idx"]): r["speaker"] for r in got.collect()} == brute_speakers(segments, turns)


def test_speakers_make_no_pairs(spark):
    """20,000 segments that overlap all of 20,000 turns: 400 million pairs."""
    n = 20_000
    rows = spark.range(n).select(F.lit(1).alias("audio_id"), F.col("id").alias("idx"), (F.col("id") / n).alias("start"), (100 + F.col("id") / n).alias("end"))
    began = time.monotonic()
    got = media.speakers(rows, rows.withColumn("speaker", F.col("idx").cast("string")))
    assert got.filter("speaker <> cast(idx as string)").count() == 0
    assert time.monotonic() - began < 60


def test_package_writer_takes_batches_of_lines(tmp_path):
    """Runs of keys across batches and files, null, empty and long lines; every run is where the index says."""
    pick = random.Random(7)
    rows = [(f"k{k // 5:04d}" if k < 900 else "hot", None if k % 50 == 49 else "é" * pick.choice([0, 1, 7, 300])) for k in range(1_500)]
    batches = [pa.record_batch([pa.array([r[0] for r in rows[a : a + 97]]), pa.array([r[1] for r in rows[a : a + 97]], pa.string())], names=["key", "line"]) for a in range(0, len(rows), 97)]
    writer = packed.PackedWriter(str(tmp_path), 4_000)
    writer.commit([writer.write(iter(batches))])
    table = pq.read_table(next((tmp_path / "index").iterdir())).to_pylist()
    back = {}
    for r in table:
        data = (tmp_path / r["file"]).read_bytes()
        assert len(data) <= 4_000
        run = data[r["offset"] : r["offset"] + r["length"]]
        assert hashlib.sha256(run).hexdigest() == r["sha256"] and run.count(b"\n") == r["lines"]
        back.setdefault(r["key"], []).extend(run.decode().split("\n")[:-1])
    want = {}
    for key, line in rows:
        if line is not None:
            want.setdefault(key, []).append(line)
    assert back == want


def test_withheld_reasons_are_counted_without_sorting_both_sides(spark):
    evidence = spark.createDataFrame([(k, k % 10 / 10, k % 7 / 7, k % 5 / 5, "long enough text " * 5 if k % 3 else "", k % 11 != 0) for k in range(200)] + [(None, 0.0, 0.0, 0.9, "long enough text " * 5, True)], "evidence_id long, deception double, manipulation double, fused_score double, text string, timeline_valid boolean")
    results = spark.createDataFrame([(k % 230, k // 230, "ocr", k % 13 / 13, ["bad"] if k % 17 == 0 else []) for k in range(700)] + [(None, 1, "ocr", 0.1, ["bad"])], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    reasons = fusion.block_reasons(evidence, results)
    got = fusion.withheld_counts(evidence, reasons)
    want = fusion.withheld(fusion.routing(evidence, reasons), reasons).groupBy("code", "severity").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    routed = fusion.routing(evidence, reasons)
    assert [r["routing"] for r in routed.filter("evidence_id is null").collect()] == ["auto_ok"] and routed.count() == 201
    for df in (got, routed):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(Exception, match="no such reason"):
        fusion.withheld_counts(evidence, reasons.withColumn("code", F.lit("OTHER"))).collect()


@pytest.mark.parametrize("fixed", [False, True])
def test_a_limited_key_makes_three_state_calls_a_batch(fixed):
    calls, held = [], {}

    class Value:
        def get(self):
            calls.append("get")
            return held.get("v")

        def update(self, v):
            calls.append("update")
            held["v"] = v

    class Handle:
        getValueState = staticmethod(lambda name, schema: Value())
        registerTimer = staticmethod(lambda at: calls.append("timer"))

    limiter = state.Limiter(fixed, 10, 2)
    limiter.init(Handle())
    out = [r for batch in ([3, 1, 2], [12, 11]) for r in limiter.handleInputRows(("k",), iter([Row(key="k", id=t, ts=None, micros=t * 1_000_000) for t in batch]), None)]
    assert [(r["id"], r["allowed"]) for r in out] == [(1, True), (2, True), (3, False), (11, True), (12, True)]
    assert calls == ["get", "update", "timer"] * 2
