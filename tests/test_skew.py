"""One key with all or most rows: results equal brute force, and no task gets them all."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from casefile.operators import custody, entities, media, ordered, telemetry
from casefile.operators.components import components


def rank_of(values, n_to_rank):
    order = sorted(values, key=lambda v: (math.isnan(v), v))
    return order[n_to_rank(len(order))]


def test_order_statistics_equal_sorting(spark, monkeypatch):
    monkeypatch.setattr(ordered, "FEW", 50)
    monkeypatch.setattr(ordered, "SLICES", 16)
    pick = random.Random(2)
    groups = {
        "hot": [pick.lognormvariate(0, 3) * pick.choice([1, -1]) for _ in range(20_000)],
        "equal": [7.0] * 500 + [8.0] * 499,
        "near": [1.0 + k * 2**-52 for k in range(300)] + [1e300, -1e300, 0.0, -5e-324, 5e-324],
        "odd": [float("inf"), float("-inf"), float("nan"), 0.0, 1.0],
        "one": [3.5],
        None: [float(k % 13) for k in range(400)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("none", None)]
    pick.shuffle(rows)
    ranks = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor((n - 1) / 2), "p95": lambda n: F.least(F.floor(n * F.lit(0.95)), n - 1), "last": lambda n: n - 1}
    want_of = {"first": lambda n: 0, "mid": lambda n: (n - 1) // 2, "p95": lambda n: min(int(n * 0.95), n - 1), "last": lambda n: n - 1}
    got = {r["g"]: r for r in ordered.order_statistics(spark.createDataFrame(rows, "g string, v double").repartition(6), ["g"], "v", ranks).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g]["n"] == len(values)
        for name, f in want_of.items():
            assert repr(got[g][name]) == repr(rank_of(values, f)) or got[g][name] == rank_of(values, f), (g, name)


def test_latencies_of_one_group(spark):
    values = [float((k * 7919) % 10_007) for k in range(10_007)]
    df = spark.createDataFrame([("x", v, True) for v in values], "g string, ms double, success boolean")
    a = telemetry.latency_by_index(df, ["g"], success="success").first()
    b = telemetry.latency_interpolated(df, ["g"]).first()
    assert (a["p50"], a["p95"], a["p99"]) == tuple(float(int(10_007 * q)) for q in (0.5, 0.95, 0.99))
    cuts = statistics.quantiles(values, n=100, method="inclusive")
    assert [b["p50"], b["p95"], b["p99"]] == pytest.approx([cuts[49], cuts[94], cuts[98]])


def chain(n, broken):
    h = lambda x: hashlib.sha256(str(x).encode()).hexdigest()
    return [("hot", k, k // 3, "a", "act", h("no") if k in broken else h(k - 1), h(k), h(-1)) for k in range(n)]


SCHEMA = "evidence_id string, id long, ts long, agent_id string, action string, input_hash string, output_hash string, original_hash string"


def entries(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros(F.col("ts") * 1_000_000))


def test_a_hot_chain_is_dealt_out_and_verified(spark):
    rows = chain(6_000, {17, 3_001, 5_999}) + [("b", 1, 1, "a", "act", "x", "y", "x"), (None, 1, 1, "a", "act", "x", "y", "x"), (None, 2, 2, "a", "act", "y", "z", "x")]
    df = entries(spark, rows).repartition(5)
    got = {r["evidence_id"]: r for r in custody.verify(df, "original_hash").collect()}
    assert (got["hot"]["entries"], got["hot"]["valid"], got["hot"]["breaks"]) == (6_000, False, 3) and got["b"]["valid"] and got[None]["entries"] == 2 and got[None]["valid"]
    assert sorted(r["idx"] for r in custody.issues(df).collect()) == [17, 3_001, 5_999]
    placed = ordered.previous(df, ["evidence_id"], ["ts", "id"], ["output_hash"])
    assert placed.filter("evidence_id = 'hot'").select(F.count_distinct("_idx")).first()[0] == 6_000
    # Small tables' ranges are put together again; large ones' are not.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = df.repartitionByRange("evidence_id", "ts", "id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 4 and max(r["count"] for r in ranges) < 3_000


def test_a_hot_chains_hash_is_a_fold(spark):
    rows = chain(3_000, set()) + [(None, 1, 1, "a", "act", "x", "y", "x")]
    df = entries(spark, rows)
    text = {}
    for r in df.orderBy("ts", "id").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).collect():
        text.setdefault(r["evidence_id"], []).append("|".join((r["t"], r["agent_id"], r["action"], r["input_hash"], r["output_hash"])))
    want = {k: hashlib.sha256("|".join(v).encode()).hexdigest() for k, v in text.items()}
    assert {r["evidence_id"]: r["chain_hash"] for r in custody.chain_hash(df.repartition(4)).collect()} == want
    assert custody.chain_hash(df.limit(0)).count() == 0


def test_sliding_limit_of_a_hot_key(spark):
    pick = random.Random(3)
    rows = [(pick.choice(["hot"] * 9 + ["b", None]), k, pick.randrange(0, 40_000_000)) for k in range(1_500)]
    rows += [("hot", 2_000 + k, 5_000_000) for k in range(20)]
    df = spark.createDataFrame(rows, "k string, id long, us long").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: (r["seen"], r["allowed"], r["remaining"]) for r in telemetry.sliding_limit(df, "k", 2, 30).collect()}
    for key, id_, at in rows:
        seen = sum(k == key and at - 2_000_000 < t < at for k, _, t in rows)
        assert got[id_] == (seen, seen < 30, max(0, 30 - seen - 1))
    keys = telemetry.sliding_limit(df, "k", 2, 30)._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in keys


def test_intervals_of_a_second_and_of_a_day(spark):
    pick = random.Random(6)
    sizes = [0.0, 0.001, 0.5, 1.0, 1.5, 60.0, 4_000.0, 86_400.0]
    a = [(1, k, s := pick.uniform(-500, 90_000), s + pick.choice(sizes)) for k in range(150)] + [(1, 500, 0.0, 86_400.0), (1, 501, 10.0, 10.0), (2, 502, 0.0, 1.0), (1, 503, None, 1.0)]
    b = [(1, k, s := pick.uniform(-500, 90_000), s + pick.choice(sizes), f"s{k}") for k in range(150)] + [(1, 500, 0.0, 86_400.0, "day"), (1, 501, 9.0, 11.0, "x")]
    left, right = spark.createDataFrame(a, "audio_id long, idx long, start double, end double"), spark.createDataFrame(b, "audio_id long, idx long, start double, end double, speaker string")
    pairs = sorted((r["idx"], r["r_idx"]) for r in media.overlapping(left, right, "audio_id").collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] is not None and y[2] < x[3] and y[3] > x[2])
    assert pairs == want
    cells = media._cells(media._level(left), [r[0] for r in media._level(right).select("_level").distinct().collect()])
    assert cells.filter("idx = 500").count() <= 4 and cells.groupBy("idx").count().agg(F.max("count")).first()[0] <= 2 * (len(sizes) + 1)
    got = {r["idx"]: r["speaker"] for r in media.speakers(left, right).collect()}
    assert got[502] == "UNKNOWN" and got[503] == "UNKNOWN" and len(got) == len(a)


def test_components_of_chains_stars_and_cliques(spark):
    pick = random.Random(1)
    links = [(k, k + 1) for k in range(0, 60)] + [(1_000, k) for k in range(100, 180)] + [(a, b) for a in range(300, 310) for b in range(300, 310)] + [(pick.randrange(400, 460), pick.randrange(400, 460)) for _ in range(40)]
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            x = stack.pop()
            if x not in want:
                want[x] = start
                stack += near[x]
    want = {k: v for k, v in want.items() if near[k] - {k}}
    assert {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_clusters_inside_documents_are_greedy(spark):
    rows = [(1, 0, 3, "PERSON", "Ann Lee"), (1, 5, 8, "PERSON", "Bob Ray"), (1, 10, 13, "PERSON", "Ann Ray"), (1, 15, 18, "PERSON", "Ray"), (1, 20, 23, "ORG", "Acme"), (1, 25, 28, "ORG", "ACME"), (1, 30, 33, "ORG", "Acme Inc"), (2, 0, 3, "PERSON", "Lee")]
    got = sorted((r["canonical"], r["label"], tuple(r["mentions"]), r["n"]) for r in entities.clusters(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, text string")).collect())
    # 'Ray' matches the first cluster through 'Ann Ray', which came to it by 'Ann'.
    assert got == [("Acme", "ORG", ("Acme", "ACME"), 2), ("Ann Lee", "PERSON", ("Ann Lee", "Ann Ray", "Ray"), 3)]


def test_clusters_across_documents_with_a_hot_word(spark):
    rows = [(k, 0, 3, "PERSON", f"Hot Name{k}") for k in range(400)] + [(900, 0, 3, "PERSON", "Name7 Other"), (901, 0, 3, "PERSON", "Alone"), (902, 1, 2, "ORG", "Hot"), (903, 1, 2, "ORG", "hot"), (904, 1, 2, "ORG", "Hot Name1"), (905, 1, 2, "PERSON", None)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, label string, text string")
    got = sorted((r["label"], r["canonical"], r["n"], r["n_docs"], r["n_names"]) for r in entities.linked_clusters(df).collect())
    assert got == [("ORG", "Hot", 2, 2, 1), ("PERSON", "Hot Name0", 401, 401, 401)]
