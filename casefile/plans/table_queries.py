"""Queries of custody, relational tables, telemetry, media, mails, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from casefile.functions import mail, score
from casefile.functions import text as t
from casefile.operators import custody as cu
from casefile.operators import email as em
from casefile.operators import media, relational, telemetry
from casefile.plans import text_queries
from casefile.plans.registry import PHRASES, TABLES, _lit, cases, custody, evidence, log, query, read, results, sql
from casefile.session import scratch, ship
from casefile.sources import files, packed, sinks
from casefile.streaming import arrivals, state

R = lambda c, n=6: F.round(c, n)

LINKED = """_w AS (SELECT *, row_number() OVER w - 1 AS idx, lag(output_hash) OVER w AS before FROM custody WINDOW w AS (PARTITION BY evidence_id ORDER BY ts, id)),
_l AS (SELECT *, before IS NULL OR before = input_hash AS ok, CASE WHEN idx = 0 THEN original_hash ELSE before END AS seeded FROM _w)"""


@query("win1_custody_verify", sql("custody", LINKED + " SELECT evidence_id, count(*) AS entries, bool_and(ok) AS valid, count(*) FILTER (NOT ok) AS breaks, min(ts) AS first_ts, max(ts) AS last_ts FROM _l GROUP BY evidence_id"))
def custody_verify(spark, d):
    return cu.verify(custody(spark, d))


@query("win1_custody_issues", sql("custody", LINKED + " SELECT evidence_id, idx::INTEGER AS idx, before AS expected, input_hash AS found FROM _l WHERE NOT ok"))
def custody_issues(spark, d):
    return cu.issues(custody(spark, d))


@query("win2_custody_seeded", sql("custody", LINKED + " SELECT evidence_id, bool_and(seeded = input_hash) AS valid, count(*) FILTER (seeded <> input_hash) AS breaks FROM _l GROUP BY evidence_id"))
def custody_seeded(spark, d):
    return cu.verify(custody(spark, d), "original_hash").select("evidence_id", "valid", "breaks")


@query("win3_chain_hash", sql("custody", "SELECT evidence_id, sha256(string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '|' || agent_id || '|' || action || '|' || input_hash || '|' || output_hash, '|' ORDER BY ts, id)) AS chain_hash FROM custody GROUP BY evidence_id"))
def chain_hash(spark, d):
    return cu.chain_hash(custody(spark, d))


@query("set6_verify_content", sql("evidence", """SELECT evidence_id, CASE WHEN status = 'analyzed' THEN CASE WHEN evidence_id % 13 = 0 THEN 'flagged' ELSE 'verified' END ELSE status END AS new_status, CASE WHEN status = 'analyzed' AND evidence_id % 13 <> 0 THEN 'verified' END AS entry FROM evidence"""))
def verify_content(spark, d):
    e = evidence(spark, d).withColumn("storage_path", F.col("evidence_id").cast("string"))
    scan = e.select(F.col("storage_path").alias("path"), F.when(F.col("evidence_id") % 13 == 0, "x").otherwise(F.col("original_hash")).alias("sha256"))
    out, entries = cu.verify_content(e, scan)
    return out.join(entries.select("evidence_id", F.col("action").alias("entry")), "evidence_id", "left").select("evidence_id", "new_status", "entry")


@query("src13_first_entries", sql("evidence", "SELECT evidence_id, created_at AS ts, 'intake' AS agent_id, 'uploaded' AS action, original_hash AS input_hash, original_hash AS output_hash FROM evidence"))
def first_entries(spark, d):
    return cu.first_entries(evidence(spark, d))


@query("fil1_3_filters", sql("evidence", "SELECT evidence_id, status, evidence_type FROM evidence WHERE status = 'pending' AND evidence_type = 'HIGH'"))
def filters(spark, d):
    return relational.matching(evidence(spark, d), status="pending", evidence_type="HIGH", case_id=None).select("evidence_id", "status", "evidence_type")


@query("fil2_search_cases", sql("cases", "SELECT case_id, title FROM cases WHERE title ILIKE '%0017%' OR case_number ILIKE '%0017%'"))
def search(spark, d):
    return relational.search_cases(cases(spark, d), "0017").select("case_id", "title")


@query("fil4_readable", sql("evidence", "SELECT evidence_id, status FROM evidence WHERE status IN ('analyzed', 'verified')"))
def readable(spark, d):
    return relational.readable(evidence(spark, d)).select("evidence_id", "status")


@query("join1_2_case_counts", sql("cases evidence", "SELECT c.case_id, count(e.evidence_id) AS evidence_count FROM cases c LEFT JOIN evidence e ON c.case_id = e.case_id GROUP BY c.case_id"))
def case_counts(spark, d):
    return relational.case_counts(cases(spark, d), evidence(spark, d)).select("case_id", "evidence_count")


@query("join3_full_evidence", sql("evidence cases custody results", """SELECT e.evidence_id, c.title, coalesce(k.n, -1) AS entries, coalesce(r.n, -1) AS results FROM evidence e LEFT JOIN cases c ON e.case_id = c.case_id
LEFT JOIN (SELECT evidence_id, count(*) AS n FROM custody GROUP BY 1) k ON e.evidence_id = k.evidence_id LEFT JOIN (SELECT evidence_id, count(*) AS n FROM results GROUP BY 1) r ON e.evidence_id = r.evidence_id"""))  # fmt: skip
def full_evidence(spark, d):
    x = relational.full_evidence(evidence(spark, d), cases(spark, d).drop("status"), custody(spark, d), results(spark, d))
    return x.select("evidence_id", "title", F.when(F.col("custody").isNull(), -1).otherwise(F.size("custody")).cast("long").alias("entries"), F.when(F.col("results").isNull(), -1).otherwise(F.size("results")).cast("long").alias("results"))


@query("join7_shared_content", "SELECT sha256(text) AS sha256, count(DISTINCT doc_id) AS items, min(doc_id) AS first_item FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1")
def shared(spark, d):
    return relational.shared_content(read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("sha256")))


REUSE = """WITH t AS (SELECT doc_id, left(sha256(text), 32) AS h FROM documents), r AS (SELECT DISTINCT left(sha256(text), 32) AS h FROM documents WHERE doc_id % 4 = 1)"""


@query("join8_reusable_results", REUSE + " SELECT t.h IN (SELECT h FROM r) AS reused, count(*) AS n FROM t GROUP BY ALL")
def reusable(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text")
    now = F.to_timestamp(F.lit("2024-01-02 00:00:00"))
    old = docs.filter("doc_id % 4 in (1, 2)").select(F.substring(F.sha2("text", 256), 1, 32).alias("text_hash"), F.when(F.col("doc_id") % 4 == 1, F.to_timestamp(F.lit("2024-01-01 23:30:00"))).otherwise(F.to_timestamp(F.lit("2024-01-01 12:00:00"))).alias("made_at"), F.col("doc_id").alias("result"))
    hit, rest = relational.reusable(docs, old, now)
    both = hit.select(F.lit(True).alias("reused")).unionByName(rest.select(F.lit(False).alias("reused")))
    return both.groupBy("reused").agg(F.count(F.lit(1)).alias("n"))


@query("join9_embeddings", sql("evidence", "SELECT e.evidence_id, round(least(1.0, fused_score + CASE WHEN v.vec_id IS NULL THEN 0 ELSE 0.1 END), 6) AS confidence FROM evidence e LEFT JOIN embeddings v ON e.evidence_id = v.vec_id"))
def with_embeddings(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("evidence_id"), "embedding")
    return relational.with_embeddings(evidence(spark, d), v, "fused_score").select("evidence_id", R("fused_score").alias("confidence"))


@query("join6_baseline", sql("log", """_c AS (SELECT event_type AS metric, avg(ms) AS value FROM log GROUP BY 1), _b AS (SELECT event_type AS metric, avg(ms) AS base FROM log WHERE id % 2 = 0 GROUP BY 1)
SELECT metric, round((value - base) / base * 100, 2) AS change_pct, CASE WHEN metric IN ('click', 'error') THEN value < base ELSE value > base END AS improved FROM _c JOIN _b USING (metric) WHERE base > 0"""))  # fmt: skip
def baseline(spark, d):
    x = log(spark, d)
    mean = lambda y: y.groupBy(F.col("event_type").alias("metric")).agg(F.avg("ms").alias("value"))
    return telemetry.against_baseline(mean(x), mean(x.filter("id % 2 = 0")), ["click", "error"]).select("metric", "change_pct", "improved")


@query("agg1_status_counts", sql("evidence", f"SELECT s.status, count(e.evidence_id) AS n, (SELECT count(*) FROM evidence) AS total FROM (SELECT unnest({_lit(relational.EVIDENCE_STATUSES)}) AS status) s LEFT JOIN evidence e ON s.status = e.status GROUP BY s.status"))
def status_counts(spark, d):
    return relational.status_counts(evidence(spark, d))


@query("agg2_case_summary", sql("evidence", "SELECT case_id, count(*) AS total, count(*) FILTER (status IN ('analyzed', 'verified')) AS analyzed, count(*) FILTER (status = 'flagged') AS flagged FROM evidence GROUP BY case_id"))
def case_summary(spark, d):
    return relational.case_summary(evidence(spark, d))


@query("agg4_pipeline_metrics", sql("log", "SELECT event_type AS evidence_type, count(*) AS processed, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(avg(ms), 6) AS mean_ms, round(count(*) FILTER (success) / count(*), 6) AS success_rate FROM log GROUP BY ROLLUP (event_type)"))
def pipeline_metrics(spark, d):
    x = relational.pipeline_metrics(log(spark, d).select(F.col("event_type").alias("evidence_type"), "success", F.col("ms").alias("time_ms")))
    return x.withColumns({"mean_ms": R("mean_ms"), "success_rate": R("success_rate")})


@query("agg16_batch_summary", sql("log", "SELECT grp AS batch_id, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed FROM log GROUP BY 1"))
def batches(spark, d):
    return relational.batch_summary(log(spark, d).withColumnRenamed("grp", "batch_id"))


def _at(q: float) -> str:
    return f"list_sort(list(ms))[least(floor(count(*) * {q}::DOUBLE), count(*) - 1)::BIGINT + 1]"


@query("agg5_latency_by_index", sql("log", f"SELECT grp, count(*) AS n, round(avg(ms), 6) AS mean, min(ms) AS min, max(ms) AS max, round(coalesce(stddev_samp(ms), 0), 6) AS std, round(count(*) * 1000 / sum(ms), 6) AS ops_per_s, round(avg(success::INT), 6) AS success_rate, {_at(0.5)} AS p50, {_at(0.95)} AS p95, {_at(0.99)} AS p99 FROM log GROUP BY grp"))
def latency_index(spark, d):
    x = telemetry.latency_by_index(log(spark, d), ["grp"], "ms", "success")
    return x.withColumns({c: R(c) for c in ("mean", "std", "ops_per_s", "success_rate")})


@query("agg6_latency_interpolated", sql("log", "SELECT grp, count(*) AS n, round(avg(ms), 6) AS mean, round(stddev_pop(ms), 6) AS std, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(count(*) * 1000 / sum(ms), 6) AS throughput FROM log GROUP BY grp"))
def latency_interpolated(spark, d):
    x = telemetry.latency_interpolated(log(spark, d), ["grp"])
    return x.withColumns({c: R(c) for c in ("mean", "std", "p50", "p95", "p99", "throughput")})


@query("agg7_histogram", sql("log", "_e AS (SELECT min(ms) AS lo, max(ms) AS hi FROM log) SELECT least(30, floor((ms - lo) / (hi - lo) * 30) + 1)::BIGINT AS bin, count(*) AS n FROM log, _e GROUP BY 1"))
def histogram(spark, d):
    return telemetry.histogram(log(spark, d))


@query("agg8_cumulative_histogram", sql("log", f"SELECT event_type, le, count(*) FILTER (ms / 100 <= le) AS n, round(sum(ms / 100), 6) AS sum, count(*) AS count FROM log, (SELECT unnest({telemetry.BUCKETS}::DOUBLE[]) AS le) GROUP BY event_type, le"))
def cumulative(spark, d):
    x = telemetry.cumulative_histogram(log(spark, d).withColumn("s", F.col("ms") / 100), ["event_type"], "s")
    return x.withColumn("sum", R("sum"))


@query("agg14_calibration", sql("log", """_c AS (SELECT 'd' || user_id % 4 AS device, avg(40 + ms % 50) AS a, max(40 + ms % 50) AS x, min(40 + ms % 50) AS n, stddev_pop(40 + ms % 50) AS s, avg(ms) AS w, count(*) FILTER (NOT success) AS k FROM log GROUP BY 1)
SELECT device, round(a, 1) AS avg_temp, round(x, 1) AS max_temp, round(n, 1) AS min_temp, round(s, 2) AS temp_stability, round(w, 1) AS avg_power, k AS throttle_events, round(CASE WHEN 85 - x < 0 THEN 0.65 WHEN 85 - x < 5 THEN 0.7 WHEN 85 - x < 10 THEN 0.8 ELSE 0.85 END, 2) AS recommended_load, round(85 - x, 1) AS thermal_headroom FROM _c"""))  # fmt: skip
def calibration(spark, d):
    return telemetry.calibration(log(spark, d).select(F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("device"), (40 + F.col("ms") % 50).alias("gpu_temp_c"), F.col("ms").alias("power_draw_w"), (~F.col("success")).alias("throttled")))


HEALTH = """_t AS (SELECT grp, count(*) AS total, count(*) FILTER (NOT success) AS errors, count(*) FILTER (ms > 100) AS slow FROM log GROUP BY grp),
_n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts DESC, id DESC) AS rn FROM log), _v AS (SELECT grp, avg(ms) AS mean, list_sort(list(ms)) AS v FROM _n WHERE rn <= 100 AND success GROUP BY grp),
_h AS (SELECT _t.*, coalesce(mean, 0) AS mean, coalesce(CASE WHEN len(v) > 20 THEN v[floor(len(v) * 0.95::DOUBLE)::BIGINT + 1] ELSE mean END, 0) AS p95, round(errors / greatest(total, 1) * 100, 2) AS error_rate FROM _t LEFT JOIN _v USING (grp))"""


@query("agg15_query_health", sql("log", HEALTH + " SELECT grp, total, errors, slow, round(mean, 6) AS mean, round(p95, 6) AS p95, error_rate, CASE WHEN error_rate > 5 THEN 'degraded' WHEN p95 > 500 THEN 'warning' ELSE 'healthy' END AS status FROM _h"))
def health(spark, d):
    return telemetry.query_health(log(spark, d), ["grp"]).withColumns({"mean": R("mean"), "p95": R("p95")})


@query("agg19_throughput", sql("log", "_n AS (SELECT date_trunc('hour', ts) AS start, count(*) AS n FROM log GROUP BY 1) SELECT start, n, round(avg(n) OVER (), 6) AS mean_n FROM _n"))
def throughput(spark, d):
    return telemetry.throughput(log(spark, d), width="1 hour").withColumn("mean_n", R("mean_n"))


@query("agg20_analysis_counters", sql("log", "SELECT event_type AS agent, CASE WHEN success THEN 'ok' ELSE 'failed' END AS status, count(*) AS n, round(avg(ms), 6) AS mean_ms FROM log GROUP BY ALL"))
def counters(spark, d):
    x = log(spark, d).select(F.col("event_type").alias("agent"), F.when(F.col("success"), "ok").otherwise("failed").alias("status"), "ms")
    return telemetry.analysis_counters(x).withColumn("mean_ms", R("mean_ms"))


@query("win5_top_k", sql("evidence", "SELECT case_id, evidence_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY fused_score DESC, evidence_id) AS rank FROM evidence) WHERE rank <= 3"))
def top_k(spark, d):
    return relational.top_per_group(evidence(spark, d), ["case_id"], [F.desc("fused_score"), F.col("evidence_id")], 3).select("case_id", "evidence_id", "rank")


@query("win6_last_n", sql("log", "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM log) WHERE rn <= 5"))
def last_n(spark, d):
    return telemetry.last_n(log(spark, d), ["user_id"], 5).select("user_id", "id")


@query("win7_latest_job", sql("log", "SELECT user_id, arg_max(id, struct_pack(a := ts, b := id)) AS id FROM log GROUP BY user_id"))
def latest(spark, d):
    return relational.top_per_group(log(spark, d), ["user_id"], [F.desc("ts"), F.desc("id")], 1).select("user_id", "id")


@query("win10_state_changes", sql("log", "SELECT user_id, id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, id) AS previous FROM log) WHERE previous <> event_type"))
def changes(spark, d):
    return telemetry.state_changes(log(spark, d), ["user_id"], "event_type").select("user_id", "id", "previous", "event_type")


@query("win11_sliding_limit", sql("log", "_s AS (SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS seen FROM log) SELECT id, seen, seen < 3 AS allowed, greatest(0, 3 - seen - 1) AS remaining FROM _s"))
def sliding(spark, d):
    return telemetry.sliding_limit(log(spark, d), "user_id", 86_400, 3).select("id", "seen", "allowed", "remaining")


@query("srt1_page", sql("evidence", "SELECT evidence_id, (SELECT count(*) FROM evidence) AS total, ceil((SELECT count(*) FROM evidence) / 20)::BIGINT AS pages FROM evidence ORDER BY created_at DESC, evidence_id LIMIT 20 OFFSET 40"))
def page(spark, d):
    return relational.page(evidence(spark, d), 3, 20).select("evidence_id", "total", "pages")


@query("srt1_page_after", sql("evidence", "SELECT evidence_id FROM evidence WHERE created_at < TIMESTAMP '2000-01-01' OR (created_at = TIMESTAMP '2000-01-01' AND evidence_id > 100) ORDER BY created_at DESC, evidence_id LIMIT 20"))
def page_after(spark, d):
    import datetime as dt

    return relational.page_after(evidence(spark, d), (dt.datetime(2000, 1, 1), 100), 20).select("evidence_id")


@query("srt2_work_list", sql("evidence", "SELECT evidence_id FROM evidence WHERE status = 'pending' ORDER BY created_at, evidence_id LIMIT 50"))
def work_list(spark, d):
    return relational.pending(evidence(spark, d), 50).select("evidence_id")


@query("srt3_slow_queries", sql("log", "SELECT id, ms FROM log WHERE ms > 100 ORDER BY ts DESC, id DESC LIMIT 10"))
def slow(spark, d):
    return telemetry.latest_where(log(spark, d), F.col("ms") > 100).select("id", "ms")


@query("srt4_ranked_probabilities", sql("texts", "SELECT doc_id, string_agg(source, '>' ORDER BY source) AS ranked FROM texts GROUP BY doc_id"))
def ranked(spark, d):
    from casefile.plans.registry import texts

    p = F.array(F.struct(F.lit(0.5).alias("p"), F.col("source").alias("cls")))
    by = F.array_sort(p, lambda a, b: F.when(a["p"] > b["p"], -1).when(a["p"] < b["p"], 1).otherwise(0))
    return texts(spark, d).select("doc_id", F.array_join(F.transform(by, lambda x: x["cls"]), ">").alias("ranked"))


@query("src12_new_content", sql("evidence", """_n AS (SELECT * FROM evidence WHERE evidence_id % 2 = 0), _o AS (SELECT DISTINCT case_id % 50 AS c, original_hash FROM evidence WHERE evidence_id % 2 = 1)
SELECT min(evidence_id) AS evidence_id FROM _n WHERE (case_id % 50, original_hash) NOT IN (SELECT c, original_hash FROM _o) GROUP BY case_id % 50, original_hash"""))  # fmt: skip
def new_content(spark, d):
    e = evidence(spark, d).withColumn("case_id", F.col("case_id") % 50)
    return relational.new_content(e.filter("evidence_id % 2 = 0"), e.filter("evidence_id % 2 = 1")).select("evidence_id")


@query("set2_bulk_status", sql("evidence", "SELECT CASE WHEN evidence_id % 10 = 3 THEN 'error' ELSE status END AS status, count(*) AS n FROM evidence GROUP BY 1"))
def bulk(spark, d):
    e = evidence(spark, d)
    return relational.with_status(e, e.filter("evidence_id % 10 = 3").select("evidence_id", F.lit("error").alias("new_status"))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("set3_retention", sql("evidence", "SELECT evidence_id FROM evidence WHERE NOT (status = 'analyzed' AND created_at < TIMESTAMP '1998-01-01')"))
def retention(spark, d):
    jobs = evidence(spark, d).select("evidence_id", F.when(F.col("status") == "analyzed", "completed").otherwise("queued").alias("status"), F.col("created_at").alias("completed_at"))
    return relational.retained(jobs, F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).select("evidence_id")


@query("set4_close_cases", sql("cases", "SELECT case_id, CASE WHEN case_id % 5 = 0 THEN 'closed' ELSE status END AS status, case_id % 5 = 0 AS stamped FROM cases"))
def close_cases(spark, d):
    c = cases(spark, d).withColumn("closed_at", F.lit(None).cast("timestamp"))
    x = relational.closed(c, c.filter("case_id % 5 = 0").select("case_id"), F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    return x.select("case_id", "status", F.col("closed_at").isNotNull().alias("stamped"))


@query("set5_versioned_update", sql("evidence", "SELECT 'conflict' AS kind, count(*) AS n FROM evidence WHERE evidence_id % 4 = 0 AND version <> 2 UNION ALL SELECT 'updated', count(*) FROM evidence WHERE evidence_id % 4 = 0 AND version = 2"))
def versioned(spark, d):
    e = evidence(spark, d)
    u = e.filter("evidence_id % 4 = 0").select("evidence_id", F.lit(2).cast("long").alias("version"), F.lit("error").alias("new_status"))
    new, conflicts = relational.versioned_update(e, u)
    return conflicts.select(F.lit("conflict").alias("kind")).unionByName(new.filter("status = 'error'").select(F.lit("updated").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _tracks(spark, d):
    """Turns are the values of events as lengths; segments begin at every third."""
    e = read(spark, d, "events").select((F.col("user_id") % 40).alias("audio_id"), F.col("event_id").alias("idx"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value"), "event_type")
    turns = e.select("audio_id", "idx", (F.col("us") / 1e6).alias("start"), (F.col("us") / 1e6 + F.col("value") * 60).alias("end"), F.col("event_type").alias("speaker"))
    return turns.filter("idx % 3 = 0").drop("speaker"), turns.filter("idx % 3 <> 0")


@query("join4_speakers", """WITH e AS (SELECT user_id % 40 AS audio_id, event_id AS idx, epoch_us(ts) / 1e6::DOUBLE AS s, epoch_us(ts) / 1e6::DOUBLE + value * 60 AS x, event_type FROM events),
m AS (SELECT a.audio_id, a.idx, b.event_type, row_number() OVER (PARTITION BY a.audio_id, a.idx ORDER BY least(a.x, b.x) - greatest(a.s, b.s) DESC, b.idx) AS rn FROM e a JOIN e b ON a.audio_id = b.audio_id AND b.idx % 3 <> 0 AND b.s < a.x AND b.x > a.s WHERE a.idx % 3 = 0)
SELECT e.audio_id, e.idx, coalesce(m.event_type, 'UNKNOWN') AS speaker FROM e LEFT JOIN m ON e.audio_id = m.audio_id AND e.idx = m.idx AND m.rn = 1 WHERE e.idx % 3 = 0""")  # fmt: skip
def speakers(spark, d):
    return media.speakers(*_tracks(spark, d), bucket=3600.0).select("audio_id", "idx", "speaker")


@query("agg12_transcripts", r"""SELECT conv_id AS audio_id, max(turn)::DOUBLE AS duration, sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')))::BIGINT AS words, count(*) AS segments, count(DISTINCT role) AS speakers, round(0.9::DOUBLE * 0.4::DOUBLE + least(1.0, 2.0 / greatest(avg(1 + turn / 4.0::DOUBLE), 0.5)) * 0.6::DOUBLE, 6) AS confidence FROM conversations GROUP BY conv_id""")
def transcripts(spark, d):
    s = read(spark, d, "conversations").select(F.col("conv_id").alias("audio_id"), F.col("turn").alias("idx"), F.col("turn").cast("double").alias("end"), "text", F.col("role").alias("speaker"), (1 + F.col("turn") / F.lit(4.0)).alias("compression_ratio"), F.lit(0.9).alias("lang_prob"))
    return media.transcripts(s).withColumn("confidence", R("confidence")).withColumn("words", F.col("words").cast("long"))


def _frames(spark, d):
    pixels = F.transform("embedding", lambda x: F.floor(F.lit(128) + x.cast("double") * 400).cast("int"))
    return read(spark, d, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_number"), F.lit(2.0).alias("fps"), pixels.alias("pixels"))


FRAMES = "WITH f AS (SELECT label AS video_id, vec_id AS frame_number, list_transform(embedding, lambda x: floor(128 + x::DOUBLE * 400)::INT) AS pixels FROM embeddings)"


@query("win8_scene_changes", FRAMES + """, p AS (SELECT *, lag(pixels) OVER (PARTITION BY video_id ORDER BY frame_number) AS b FROM f), x AS (SELECT video_id, frame_number, list_sum(list_transform(range(1, len(pixels) + 1), lambda i: abs(pixels[i] - b[i])))::DOUBLE / len(pixels) AS diff FROM p WHERE b IS NOT NULL)
SELECT video_id, frame_number, round(diff, 6) AS diff FROM x WHERE diff > 60""")  # fmt: skip
def scenes(spark, d):
    return media.scene_changes(_frames(spark, d), 60.0).select("video_id", "frame_number", R("diff").alias("diff"))


@query("win9_sampled_frames", FRAMES + ", s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n FROM f WHERE frame_number % 2 = 0) SELECT video_id, frame_number, round(list_avg(pixels), 2) AS brightness, round(list_stddev_pop(pixels), 2) AS brightness_std FROM s WHERE n <= 100")
def sampled(spark, d):
    return media.sampled_frames(_frames(spark, d)).select("video_id", "frame_number", "brightness", "brightness_std")


def _words(spark, d):
    w = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("e"), (F.col("turn") % 2).cast("string")).alias("engine"), F.posexplode(F.split("text", " ")).alias("k", "word"), "turn")
    return w.select("doc_id", "engine", (F.col("turn") * 10_000 + F.col("k")).alias("idx"), "word", (F.length("word") * 7 % 100).alias("conf"))


OCR = """WITH w AS (SELECT conv_id AS doc_id, 'e' || turn % 2 AS engine, turn * 10000 + i AS idx, word, length(word) * 7 % 100 AS conf FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, unnest(range(len(string_split(text, ' ')))) AS i FROM conversations)),
o AS (SELECT doc_id, engine, string_agg(word, ' ' ORDER BY idx) AS t, avg(conf) / 100 AS c, count(*) AS n FROM w WHERE conf > 0 AND trim(word) <> '' GROUP BY ALL)"""


@query("agg13_ocr_text", OCR + " SELECT doc_id, engine, md5(t) AS digest, round(c, 6) AS confidence, n AS word_count FROM o")
def ocr(spark, d):
    return media.ocr_text(_words(spark, d)).select("doc_id", "engine", F.md5("text").alias("digest"), R("confidence").alias("confidence"), "word_count")


@query("win12_fused_ocr", OCR + """, r AS (SELECT *, row_number() OVER w AS rn, lead(t) OVER w AS t2, lead(c) OVER w AS c2, lead(n) OVER w AS n2 FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY c DESC, engine)),
x AS (SELECT *, coalesce(c - c2 <= 0.15 AND n2 > n, false) AS second FROM r WHERE rn = 1) SELECT doc_id, md5(CASE WHEN second THEN t2 ELSE t END) AS digest, round(CASE WHEN second THEN (c + c2) / 2 ELSE c END, 6) AS confidence FROM x""")  # fmt: skip
def fused_ocr(spark, d):
    return media.fused_ocr(media.ocr_text(_words(spark, d))).select("doc_id", F.md5("text").alias("digest"), R("confidence").alias("confidence"))


def _pixels(spark, d):
    k = F.col("l_orderkey")
    return read(spark, d, "lineitem").select((k % 50).alias("image_id"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 256).cast("int").alias("g"), (F.col("l_quantity") * 5).cast("int").alias("b"))


PIXELS = "WITH p AS (SELECT l_orderkey % 50 AS image_id, l_partkey % 256 AS r, l_suppkey % 256 AS g, (l_quantity * 5)::INT AS b FROM lineitem)"


@query("agg17_dominant_colors", PIXELS + """, n AS (SELECT image_id, (r // 32 * 32)::INTEGER AS r, (g // 32 * 32)::INTEGER AS g, (b // 32 * 32)::INTEGER AS b, count(*) AS n FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rank, sum(n) OVER (PARTITION BY image_id) AS total FROM n)
SELECT image_id, rank::INTEGER AS rank, r, g, b, round(n / total * 100, 1) AS percentage FROM k WHERE rank <= 5""")  # fmt: skip
def dominant(spark, d):
    return media.dominant_colors(_pixels(spark, d))


@query("agg17_color_stats", PIXELS + " SELECT image_id, round(avg(r), 1) AS mean_r, round(avg(g), 1) AS mean_g, round(avg(b), 1) AS mean_b, round((stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3, 2) AS color_variance FROM p GROUP BY image_id")
def color_stats(spark, d):
    return media.color_stats(_pixels(spark, d))


@query("agg18_noise", "SELECT l_orderkey % 50 AS image_id, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS noise FROM lineitem GROUP BY 1")
def noise(spark, d):
    x = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("image_id"), F.col("l_quantity").alias("variance"))
    return media.noise_inconsistency(x).withColumn("noise", R("noise"))


@query("scr22_image_risk", """SELECT l_returnflag, CASE (l_discount::DOUBLE * 3 > 0.15::DOUBLE)::INT + (l_tax::DOUBLE * 5 > 0.2::DOUBLE)::INT + (l_linenumber = 1)::INT WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk, count(*) AS n FROM lineitem GROUP BY ALL""")
def image_risks(spark, d):
    risk = score.image_risk(F.col("l_discount").cast("double") * 3, F.col("l_tax").cast("double") * 5, F.col("l_linenumber") == 1)
    return read(spark, d, "lineitem").groupBy("l_returnflag", risk.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


@query("scr19_22_file_risks", """SELECT l_returnflag, risk, macro, image, count(*) AS n FROM (SELECT l_returnflag,
 CASE WHEN made > changed OR (l_quantity > 50)::INT + (l_linenumber > 5)::INT + (macro IN ('medium', 'high'))::INT >= 3 THEN 'high' WHEN (l_quantity > 50)::INT + (l_linenumber > 5)::INT + (macro IN ('medium', 'high'))::INT >= 1 THEN 'medium' ELSE 'low' END AS risk, macro,
 CASE (l_discount > 0.05)::INT + (l_tax > 0.04)::INT + (l_linenumber = 1)::INT WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS image
 FROM (SELECT *, l_shipdate AS made, TIMESTAMP '1999-01-01' AS changed, CASE WHEN l_linenumber > 6 OR l_suppkey % 6 > 3 THEN 'high' WHEN l_suppkey % 6 > 0 THEN 'medium' WHEN l_partkey % 2 > 0 THEN 'low' ELSE 'none' END AS macro FROM lineitem)) GROUP BY ALL""")
def file_risks(spark, d):
    x = read(spark, d, "lineitem")
    macro = score.macro_risk(F.col("l_partkey") % 2, F.lit(0), F.col("l_suppkey") % 6, F.greatest(F.lit(0), F.col("l_linenumber") - 6))
    found = score.tamper_warnings({"created": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"), "modified": F.lit("1999-01-01 00:00:00"), "revisions": F.col("l_quantity"), "hidden": F.col("l_linenumber") * 2, "structure": F.lit(False), "author": F.lit("a"), "creator": F.lit(None).cast("string"), "has_metadata": F.lit(True), "macro_risk": macro})
    y = x.select("l_returnflag", score.tamper_risk(found).alias("risk"), macro.alias("macro"), score.risk_of(score.warnings((F.col("l_discount") > 0.05, "e"), (F.col("l_tax") > 0.04, "n"), (F.col("l_linenumber") == 1, "d")), 2).alias("image"))
    return y.groupBy("l_returnflag", "risk", "macro", "image").agg(F.count(F.lit(1)).alias("n"))


@query("scr21_extraction_confidence", """SELECT l_linenumber, kind, round(CASE kind WHEN 'document' THEN 0.95 - CASE WHEN l_linenumber < 3 THEN 0.2 ELSE 0 END WHEN 'email' THEN 0.8 + 0.1 * (l_linenumber % 5) / 4.0 + 0.03 ELSE 0.9 END, 6) AS c, count(*) AS n FROM (SELECT l_linenumber, ['document', 'email', 'image'][l_suppkey % 3 + 1] AS kind FROM lineitem) GROUP BY ALL""")
def confidences(spark, d):
    n = F.col("l_linenumber")
    x = read(spark, d, "lineitem").withColumn("kind", F.get(F.array(F.lit("document"), F.lit("email"), F.lit("image")), (F.col("l_suppkey") % 3).cast("int")))
    no, yes = F.lit(False), F.lit(True)
    f = {"has_text": yes, "has_metadata": yes, "risk": F.when((n < 3) & (F.col("kind") == "document"), "high").otherwise("none"), "failed": no, "headers": n % 5, "spf_pass": yes, "dkim_pass": no, "dmarc_pass": no, "has_exif": yes, "frames": F.lit(1), "transcribed": no, "lang_prob": F.lit(0.5)}
    return x.groupBy("l_linenumber", "kind", R(score.extraction_confidence(F.col("kind"), f)).alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query("scr26_throttling", sql("log", """_t AS (SELECT CASE WHEN ms % 100 < 70 THEN 'normal' WHEN ms % 100 < 80 THEN 'warm' WHEN ms % 100 < 85 THEN 'hot' ELSE 'critical' END AS thermal, user_id % 9 = 0 AS battery, ms * 90 AS vram FROM log)
SELECT thermal, CASE WHEN battery THEN 'battery_power' WHEN vram > 23040 THEN 'vram_critical' WHEN vram > 21504 THEN 'vram_high' WHEN thermal = 'critical' THEN 'thermal_critical' WHEN thermal = 'hot' THEN 'thermal_hot' END AS reason,
 greatest(1, floor(CASE WHEN battery THEN 8 ELSE 16 END * CASE thermal WHEN 'critical' THEN 0.25 WHEN 'hot' THEN 0.5 WHEN 'warm' THEN 0.75 ELSE 1 END))::BIGINT AS workers, count(*) AS n FROM _t GROUP BY ALL"""))  # fmt: skip
def throttling(spark, d):
    x = log(spark, d).withColumns({"thermal": score.thermal_state(F.col("ms") % 100), "power": F.when(F.col("user_id") % 9 == 0, "battery").otherwise("ac")})
    return x.groupBy("thermal", score.throttle_reason(F.col("power"), F.col("ms") * 90, F.col("thermal")).alias("reason"), score.workers(F.lit(16), F.col("power"), F.col("thermal")).alias("workers")).agg(F.count(F.lit(1)).alias("n"))


def _mails(spark, d):
    k, o = F.col("o_orderkey"), read(spark, d, "orders")
    return o.select(
        F.concat(F.lit("<"), k.cast("string"), F.lit("@x>")).alias("message_id"), F.when(k % 7 == 0, "Bank bank@bank.com <a@evil.org>").otherwise(F.concat(F.lit("A <a@d"), (k % 9).cast("string"), F.lit(".org>"))).alias("from"), F.when(k % 5 == 0, "z@other.net").alias("reply_to"),
        F.when(k % 4 == 0, "fail (x)").when(k % 4 == 1, "softfail").otherwise("pass").alias("received_spf"), F.when(k % 3 == 0, "dkim=fail dmarc=fail").otherwise("dkim=pass").alias("authentication_results"), F.array_repeat(F.lit("hop"), (k % 14).cast("int")).alias("received_chain"),
        F.when(k % 6 == 0, "Re: x").when(k % 6 == 1, "FW: y").otherwise("z").alias("subject"), F.when(k % 6 == 0, F.concat(F.lit("<"), (k - 6).cast("string"), F.lit("@x>"))).alias("in_reply_to"), F.when(k % 2 == 0, F.concat(F.lit("<"), (k % 100).cast("string"), F.lit("@x>  <b@x>"))).alias("references"), F.col("o_orderdate").alias("date"),
        F.lit("").alias("body_text"), F.concat(F.lit("<p>Body "), k.cast("string"), F.lit("</p>")).alias("body_html"),
    )


@query("scr13_agg9_spoofing", """WITH m AS (SELECT o_orderkey AS k, (o_orderkey % 7 = 0)::INT + (o_orderkey % 5 = 0)::INT + (o_orderkey % 4 = 0)::INT + (o_orderkey % 4 = 1)::INT + 2 * (o_orderkey % 3 = 0)::INT + (o_orderkey % 14 > 10)::INT AS w, CASE WHEN o_orderkey % 7 = 0 THEN 'evil.org' ELSE 'd' || o_orderkey % 9 || '.org' END AS d FROM orders),
x AS (SELECT k, d, w FROM m)
SELECT d AS domain, count(*) FILTER (w >= 3) AS high, count(*) FILTER (w IN (1, 2)) AS medium, count(*) FILTER (w = 0) AS low, round(avg(w), 6) AS mean_warnings FROM x GROUP BY d""")  # fmt: skip
def spoofing(spark, d):
    return em.risk_by_domain(em.with_spoof_risk(_mails(spark, d))).withColumn("mean_warnings", R("mean_warnings"))


@query("win4_threads", """WITH m AS (SELECT o_orderkey AS k, o_orderdate AS date, '<' || o_orderkey || '@x>' AS message_id, CASE WHEN o_orderkey % 2 = 0 THEN '<' || o_orderkey % 100 || '@x>' END AS thread_id FROM orders)
SELECT message_id, k % 6 = 0 OR k % 2 = 0 AS is_reply, k % 6 = 1 AS is_forward, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END::INTEGER AS depth, coalesce(thread_id, message_id) AS thread_key, row_number() OVER (PARTITION BY coalesce(thread_id, message_id) ORDER BY date, message_id)::INTEGER AS position FROM m""")  # fmt: skip
def threads(spark, d):
    return em.threads(_mails(spark, d)).select("message_id", "is_reply", "is_forward", "depth", "thread_key", "position")


@query("str8_10_mail_text", "SELECT '<' || o_orderkey || '@x>' AS message_id, 'Subject: ' || CASE o_orderkey % 6 WHEN 0 THEN 'Re: x' WHEN 1 THEN 'FW: y' ELSE 'z' END || chr(10) || chr(10) || 'Body ' || o_orderkey AS text, CASE WHEN o_orderkey % 7 = 0 THEN 'bank.com' ELSE 'd' || o_orderkey % 9 || '.org' END AS domain FROM orders")
def mail_text(spark, d):
    return em.mail_texts(_mails(spark, d)).select("message_id", "text", t.domain(t.address("from")).alias("domain"))


RAW = "concat('From: A <a', doc_id, '@x.org>', chr(10), 'To: b@y.org, c@z.org', chr(10), 'Subject: S', doc_id, chr(10), 'Message-ID: <', doc_id, '@x>', chr(10), chr(10), 'Hello ', doc_id, chr(10))"


@query("src2_parsed_mails", "SELECT '<' || doc_id || '@x>' AS message_id, 'a' || doc_id || '@x.org' AS from_address, 'S' || doc_id AS subject, 'Hello ' || doc_id AS body, 'b@y.org|c@z.org' AS to_addresses FROM documents")
def parsed_mails(spark, d):
    i = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("From: A <a"), i, F.lit("@x.org>\nTo: b@y.org, c@z.org\nSubject: S"), i, F.lit("\nMessage-ID: <"), i, F.lit("@x>\n\nHello "), i, F.lit("\n"))
    m = files.parse_mails(read(spark, d, "documents").select(i.alias("path"), F.encode(raw, "utf-8").alias("content")))
    return m.select("message_id", t.address("from").alias("from_address"), "subject", F.trim(F.regexp_replace("body_text", "\n", "")).alias("body"), F.array_join(t.addresses("to"), "|").alias("to_addresses"))


@query("src1_scan_files")
def scan(spark, d):
    """The input's own files, read as binary, with size and hash."""
    return files.scan_files(spark, d, "*.parquet").select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "size_bytes", "sha256", "evidence_type")


@query("src2_mail_texts", r"""SELECT doc_id, 'a' || doc_id || '@example.com' AS sender, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ' ' || source END AS subject, md5(text) AS body, CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(upper(source)) END AS html,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE sha256(lang) END AS attached FROM documents""")
def mail_texts(spark, d):
    """Whole documents as the bodies of messages, encoded as mails are, and read again: one in three has one part only."""
    k, text = F.col("doc_id"), F.col("text")
    base = lambda c: F.base64(F.encode(c, "UTF-8"))
    head = F.concat(F.lit("From: =?utf-8?q?=C3=84nne?= <a"), k.cast("string"), F.lit("@example.com>\r\n"))
    single = F.concat(head, F.lit("Content-Type: text/plain; charset=utf-8\r\nContent-Transfer-Encoding: base64\r\n\r\n"), base(text))
    parts = [("text/plain; charset=utf-8", "", base(text)), ("text/html; charset=utf-8", "", base(F.upper("source"))), ("application/octet-stream", 'Content-Disposition: attachment;\r\n filename="l.bin"\r\n', base(F.col("lang")))]
    body = F.concat(*[F.concat(F.lit(f"--=_b1\r\nContent-Type: {kind}\r\n{more}Content-Transfer-Encoding: base64\r\n\r\n"), data, F.lit("\r\n")) for kind, more, data in parts], F.lit("--=_b1--\r\n"))
    whole = F.concat(head, F.lit("Subject: =?utf-8?b?"), base(F.concat_ws(" ", "lang", "source")), F.lit('?=\r\nContent-Type: multipart/mixed;\r\n boundary="=_b1"\r\n\r\n'), body)
    raw = read(spark, d, "documents").select(k.cast("string").alias("path"), F.encode(F.when(k % 3 == 0, single).otherwise(whole), "UTF-8").alias("content"))
    hashed = lambda c: F.when(F.col(c) == "", "").otherwise(F.md5(c))
    m = mail.parsed(raw, files.MAX_ATTACHMENT)
    return m.select(F.col("path").cast("long").alias("doc_id"), t.sender("from").alias("sender"), F.coalesce("subject", F.lit("")).alias("subject"), F.md5("body_text").alias("body"), hashed("body_html").alias("html"), F.coalesce(F.get("attachments", F.lit(0))["sha256"], F.lit("")).alias("attached"))


@query("src1_scanned_texts", "SELECT source, sum(octet_length(encode(text)) + 1)::BIGINT AS size_bytes, sha256(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS sha256 FROM documents GROUP BY source")
def scanned_texts(spark, d):
    """The texts of each source written as a file, and the files scanned; small ones are read whole, larger ones in pieces."""
    at = f"{scratch(ship(spark))}/texts-{uuid.uuid4().hex}"
    rows = read(spark, d, "documents").select("source", "doc_id", "text").repartition("source").sortWithinPartitions("source", "doc_id")
    rows.select("source", "text").write.partitionBy("source").text(at)
    found = files.scan_files(spark, at, "*.txt", whole=100_000)
    return found.select(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source"), "size_bytes", "sha256")


@query("snk1_package_written", sql("evidence custody", """SELECT e.case_id, count(*)::BIGINT AS items, sum(1 + coalesce(c.n, 0) + coalesce(r.n, 0))::BIGINT AS intact_lines FROM evidence e LEFT JOIN (SELECT evidence_id, count(*) AS n FROM custody GROUP BY 1) c USING (evidence_id) LEFT JOIN (SELECT evidence_id, count(*) AS n FROM results GROUP BY 1) r USING (evidence_id) GROUP BY e.case_id""").replace("WITH ", f"WITH results AS ({TABLES['results']}),\n", 1))
def package_written(spark, d):
    """All cases as one package, written and verified."""
    at = f"{scratch(ship(spark))}/package-{uuid.uuid4().hex}"
    sinks.export_packages(evidence(spark, d).drop("version"), custody(spark, d), results(spark, d), at, 1 << 20)
    checked = packed.verified(spark, at).select(F.split_part("key", F.lit("/"), F.lit(1)).cast("long").alias("case_id"), "key", "lines", "state")
    return checked.groupBy("case_id").agg(F.count_distinct("key").alias("items"), F.sum(F.when(F.col("state") == "OK", F.col("lines"))).alias("intact_lines"))


@query("snk3_custody_packed", sql("custody", "SELECT evidence_id, count(*) AS n, sum(id)::BIGINT AS ids, md5(string_agg(output_hash, '' ORDER BY ts, id)) AS hashes FROM custody GROUP BY evidence_id"))
def custody_packed(spark, d):
    """Custody entries packed into few files and read back in order."""
    at = f"{scratch(ship(spark))}/custody-{uuid.uuid4().hex}"
    sinks.pack_custody(custody(spark, d), at, 1 << 20)
    row = packed.lines(spark, at).select("key", F.struct("file", "offset", "nth").alias("place"), F.from_json("line", "id long, output_hash string").alias("e"))
    whole = row.groupBy(F.col("key").cast("long").alias("evidence_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("e.id").alias("ids"), F.sort_array(F.collect_list(F.struct("place", "e.output_hash"))).alias("all"))
    return whole.select("evidence_id", "n", "ids", F.md5(F.array_join(F.transform("all", lambda x: x["output_hash"]), "")).alias("hashes"))


@query("snk1_2_package", sql("evidence custody", """SELECT CASE WHEN evidence_id % 19 = 0 THEN 'ERROR' WHEN evidence_id % 23 = 0 THEN 'FAIL' ELSE 'OK' END AS state, count(*) AS n FROM evidence GROUP BY 1"""))
def package(spark, d):
    made = sinks.evidence_json(evidence(spark, d).drop("version"), custody(spark, d), results(spark, d))
    listed = sinks.manifest(made)
    k = F.col("evidence_id")
    held = made.filter(k % 19 != 0).withColumn("json", F.when(k % 23 == 0, "x").otherwise(F.col("json")))
    return sinks.check_manifest(listed, held).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_reports", sql("cases evidence", """SELECT c.case_id, md5('# ' || c.title || chr(10) || chr(10) || count(e.evidence_id) || ' items, ' || count(e.evidence_id) FILTER (e.status = 'flagged') || ' flagged' || chr(10) || chr(10) || '| id | type | status | score | class |' || chr(10) || '|-|-|-|-|-|' || chr(10) || coalesce(string_agg('| ' || e.evidence_id || ' | ' || e.evidence_type || ' | ' || e.status || ' | - | - |', chr(10) ORDER BY e.evidence_id), '')) AS digest FROM cases c LEFT JOIN evidence e ON c.case_id = e.case_id GROUP BY c.case_id, c.title"""))
def reports(spark, d):
    e = evidence(spark, d).withColumns({"fused_score": F.lit(None).cast("double"), "fused_class": F.lit(None).cast("string")})
    return sinks.case_reports(cases(spark, d).drop("status"), e).select("case_id", F.md5("report").alias("digest"))


@query("snk4_report_lines", sql("cases evidence", """SELECT form, case_id, part, evidence_id, line FROM (
SELECT 'html' AS form, c.case_id, 0 AS part, NULL::BIGINT AS evidence_id, '<h1>' || title || '</h1><p>' || count(e.evidence_id) || ' items, ' || count(e.evidence_id) FILTER (e.status = 'flagged') || ' flagged</p><table>' AS line FROM cases c LEFT JOIN evidence e ON c.case_id = e.case_id GROUP BY c.case_id, title
UNION ALL SELECT 'html', case_id, 1, evidence_id, '<tr><td>' || evidence_id || '</td><td>' || evidence_type || '</td><td>' || status || '</td><td>-</td><td>-</td></tr>' FROM evidence UNION ALL SELECT 'html', case_id, 2, NULL, '</table>' FROM cases
UNION ALL SELECT 'markdown', c.case_id, 0, NULL, '# ' || title || chr(10) || chr(10) || count(e.evidence_id) || ' items, ' || count(e.evidence_id) FILTER (e.status = 'flagged') || ' flagged' || chr(10) || chr(10) || '| id | type | status | score | class |' || chr(10) || '|-|-|-|-|-|' FROM cases c LEFT JOIN evidence e ON c.case_id = e.case_id GROUP BY c.case_id, title
UNION ALL SELECT 'markdown', case_id, 1, evidence_id, '| ' || evidence_id || ' | ' || evidence_type || ' | ' || status || ' | - | - |' FROM evidence
UNION ALL SELECT 'json', c.case_id, 0, NULL, '{"case_id":' || c.case_id || ',"title":"' || title || '","total":' || count(e.evidence_id) || ',"flagged":' || count(e.evidence_id) FILTER (e.status = 'flagged') || '}' FROM cases c LEFT JOIN evidence e ON c.case_id = e.case_id GROUP BY c.case_id, title
UNION ALL SELECT 'json', case_id, 1, evidence_id, '{"evidence_id":' || evidence_id || ',"evidence_type":"' || evidence_type || '","status":"' || status || '"}' FROM evidence)"""))
def report_lines(spark, d):
    """Reports of all cases in three forms, line by line."""
    e = evidence(spark, d).withColumns({"fused_score": F.lit(None).cast("double"), "fused_class": F.lit(None).cast("string")})
    forms = [sinks.report_lines(cases(spark, d).drop("status"), e, form).select(F.lit(form).alias("form"), "case_id", "part", "evidence_id", "line") for form in sinks.FORMS]
    return forms[0].unionByName(forms[1]).unionByName(forms[2])


@query("snk3_custody_export", sql("custody", "SELECT evidence_id % 20 AS evidence_id, count(*) AS n, sum(id)::BIGINT AS ids, min(action) AS first, md5(string_agg(output_hash, '' ORDER BY id)) AS hashes FROM custody GROUP BY 1"))
def custody_export(spark, d):
    """Written as JSON and as CSV by evidence, and read back."""
    x = custody(spark, d).withColumn("evidence_id", F.col("evidence_id") % 20)
    at = f"{scratch(spark)}/custody-{uuid.uuid4().hex}"
    sinks.export_custody(x, f"{at}/json")
    sinks.export_custody(x, f"{at}/csv", "csv")
    back = spark.read.schema("id long, action string, evidence_id long").json(f"{at}/json").join(spark.read.option("header", True).csv(f"{at}/csv").select(F.col("id").cast("long").alias("id"), "output_hash"), "id")
    return back.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.min("action").alias("first"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "output_hash"))), lambda s: s["output_hash"]), "")).alias("hashes"))


@query("snk5_result_file", sql("texts", text_queries.FUSED + " SELECT 'd' || doc_id || '.txt' AS file, status, fused_class AS class, round(fused_score, 6) AS score FROM _f"))
def result_file(spark, d):
    """Results written as JSON lines and read back."""
    done = text_queries.behavior(score.with_scores(text_queries.texts(spark, d)))
    at = f"{scratch(spark)}/results-{uuid.uuid4().hex}"
    sinks.write_results(done.select(F.concat(F.lit("d"), "doc_id", F.lit(".txt")).alias("file"), "status", F.col("fused_class").alias("class"), R("fused_score").alias("score")), at)
    return spark.read.schema("file string, status string, class string, score double").json(at)


@query("snk6_stage_events", sql("evidence", "SELECT 'stage_gate' AS action, 'evidence' AS resource_type, evidence_id::VARCHAR AS resource_id, '{\"status\":\"' || status || '\"}' AS new_value FROM evidence"))
def stage_events(spark, d):
    return sinks.stage_events(evidence(spark, d), "gate", F.current_timestamp()).select("action", "resource_type", "resource_id", "new_value")


FOLD = """_o AS (SELECT user_id, id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS n FROM log)"""


ACCEPTED = """WITH RECURSIVE o AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, id, t, n, [t] AS held, true AS allowed FROM o WHERE n = 1 UNION ALL
 SELECT o.user_id, o.id, o.t, o.n, CASE WHEN len(list_filter(r.held, lambda x: x > o.t - 86400000000)) < 3 THEN list_append(list_filter(r.held, lambda x: x > o.t - 86400000000), o.t) ELSE list_filter(r.held, lambda x: x > o.t - 86400000000) END, len(list_filter(r.held, lambda x: x > o.t - 86400000000)) < 3 FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id::VARCHAR AS key, id, allowed, greatest(0, 3 - len(held))::INTEGER AS remaining FROM r"""
WINDOWED = """WITH RECURSIVE o AS (SELECT user_id, event_id AS id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, id, t, n, t AS b, 1 AS c FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.id, o.t, o.n, CASE WHEN o.t >= r.b + 86400000000 THEN o.t ELSE r.b END, CASE WHEN o.t >= r.b + 86400000000 THEN 1 ELSE r.c + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id::VARCHAR AS key, id, c <= 3 AS allowed, greatest(0, 3 - c)::INTEGER AS remaining FROM r"""


@query("stm2_accepted_limit", ACCEPTED)
def accepted(spark, d):
    return state.limited_batch(log(spark, d), "user_id", 86_400, 3)


@query("stm3_fixed_window", WINDOWED)
def fixed(spark, d):
    return state.limited_batch(log(spark, d), "user_id", 86_400, 3, fixed=True)


def _stream(spark, d, name="events"):
    """A table's files as a stream. The pattern fits a file as well as a folder of files."""
    s = ship(spark).readStream.schema(read(spark, d, name).schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/{name}.parque[t]")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(out):
    """A stream run to the end of what is there, its rows written in the shared folder."""
    spark = out.sparkSession
    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


def _run_complete(out):
    """A stream of aggregates run to the end of what is there; each batch replaces the rows before."""
    spark = out.sparkSession
    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite").parquet(f"{at}/rows")
    out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/rows")


@query("stm1_stream_first_by_content", "SELECT DISTINCT sha256(props) AS sha256 FROM events")
def stream_first(spark, d):
    s = _stream(spark, d).withColumn("sha256", F.sha2("props", 256)).select("event_id", "ts", "sha256")
    return _run(state.first_by_content(s, "3650 days")).select("sha256")


@query("stm3_stream_fixed_window", WINDOWED)
def stream_window(spark, d):
    return _run(state.limited(_stream(spark, d).withColumn("id", F.col("event_id")), "user_id", 86_400, 3, fixed=True))


@query("stm2_stream_accepted_limit", ACCEPTED)
def stream_limit(spark, d):
    return _run(state.limited(_stream(spark, d).withColumn("id", F.col("event_id")), "user_id", 86_400, 3))


@query("stm6_stream_custody_breaks", "SELECT event_id % 10 AS evidence_id, count(*) AS n FROM events WHERE event_id % 17 = 0 AND event_id >= 10 GROUP BY 1")
def stream_custody(spark, d):
    """Each entry continues the one ten events before; those whose id 17 divides do not."""
    e = F.col("event_id")
    h = lambda c: F.sha2(c.cast("string"), 256)
    chain = _stream(spark, d).select((e % 10).alias("evidence_id"), e.alias("id"), "ts", h(F.when(e % 17 == 0, -1).otherwise(e)).alias("input_hash"), h(e + 10).alias("output_hash"))
    return _run(state.custody_breaks(chain)).groupBy(F.col("evidence_id").cast("long").alias("evidence_id")).agg(F.count(F.lit(1)).alias("n"))


@query("stm4_stream_scores", "WITH texts AS (SELECT doc_id, text FROM documents)," + text_queries.SCORED + " SELECT doc_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in text_queries.SCORES) + " FROM _s")
def stream_scores(spark, d):
    """Arriving documents scored, each batch written once."""
    at = f"{scratch(ship(spark))}/stream-{uuid.uuid4().hex}"
    docs = ship(spark).readStream.schema(read(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
    state.score_arrivals(docs, lambda df, batch: arrivals.write_batch({"rows": df.drop("text")}, at, batch), f"{at}/state").awaitTermination()
    return arrivals.written(spark, at, "rows").select("doc_id", *[R(c).alias(c) for c in text_queries.SCORES])


@query("stm4_stream_evidence", sql("texts", text_queries.FUSED.replace("doc_id % 2 = 0", "false") + """,
_g AS (SELECT doc_id AS evidence_id, fused_score, fused_class, CASE WHEN fused_score > 0.7 THEN 'flagged' ELSE 'analyzed' END AS status, CASE WHEN deception > 0.7 OR fused_score < 0.3 OR length(trim(text)) < 50 OR manipulation > 0.7 THEN 'review' ELSE 'auto_ok' END AS routing, sha256(text) AS original_hash FROM _f)
SELECT evidence_id, status, fused_class, round(fused_score, 6) AS fused_score, routing, original_hash, 2 AS n_results, 4 AS n_custody, true AS chain_valid FROM _g"""))
def stream_evidence(spark, d):
    """Arriving documents through all stages; evidence, results and custody rows of each batch written once and read back."""
    at = f"{scratch(ship(spark))}/stream-{uuid.uuid4().hex}"
    docs = ship(spark).readStream.schema(read(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]")
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % len(PHRASES)).cast("int"))
    rows = docs.select(F.col("doc_id").alias("evidence_id"), F.lit("text").alias("evidence_type"), F.concat("text", F.lit(" "), phrase).alias("text"), F.lit(None).cast("binary").alias("raw"), F.lit("pending").alias("status"))
    arrivals.process_arrivals(rows, at).awaitTermination()
    done, found, chain = (arrivals.written(spark, at, name) for name in ("evidence", "results", "custody"))
    n_results = found.groupBy("evidence_id").agg(F.count(F.lit(1)).cast("int").alias("n_results"))
    checked = cu.verify(chain.withColumn("ts", F.lit(0)), "original_hash").select("evidence_id", F.col("entries").cast("int").alias("n_custody"), F.col("valid").alias("chain_valid"))
    return done.join(n_results, "evidence_id").join(checked, "evidence_id").select("evidence_id", "status", "fused_class", R("fused_score").alias("fused_score"), "routing", "original_hash", "n_results", "n_custody", "chain_valid")


COUNTERS = "SELECT time_bucket(INTERVAL 1 day, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL"
PROGRESS = "SELECT user_id AS evidence_id, arg_max(event_type, struct_pack(a := ts, b := event_id)) AS stage, arg_max(value, struct_pack(a := ts, b := event_id)) AS progress FROM events GROUP BY user_id"


def _counters(events):
    return state.stage_counters(events, "1 day").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", R("mean_value").alias("mean_value"))


def _progress(events):
    return state.job_progress(events.select(F.col("user_id").alias("evidence_id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), "ts", F.col("event_id").alias("id")))


@query("stm5_stage_counters", COUNTERS)
def stage_counters(spark, d):
    return _counters(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("stm5_stream_stage_counters", COUNTERS)
def stream_counters(spark, d):
    return _run_complete(_counters(_stream(spark, d)))


@query("stm7_job_progress", PROGRESS)
def job_progress(spark, d):
    return _progress(read(spark, d, "events"))


@query("stm7_stream_job_progress", PROGRESS)
def stream_progress(spark, d):
    return _run_complete(_progress(_stream(spark, d)))


@query("stm7_stream_status_counts", "SELECT stage, count(*) AS n FROM (" + PROGRESS + ") GROUP BY stage")
def stream_status_counts(spark, d):
    """Items by their latest stage, kept by what each batch changes."""
    at = f"{scratch(ship(spark))}/stream-{uuid.uuid4().hex}"
    rows = _stream(spark, d).select(F.col("user_id").alias("evidence_id"), F.col("event_type").alias("stage"), "ts", F.col("event_id").alias("id"))
    arrivals.run_batches(state.stage_changes(rows), lambda df: {"changes": df.groupBy("stage").agg(F.sum("delta").alias("delta"))}, at, mode="update").awaitTermination()
    return state.stage_counts(arrivals.written(spark, at, "changes"))
