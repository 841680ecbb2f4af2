"""Small cases of the library's operators, negative ones included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casefile.functions import ingest, score
from casefile.functions import sentiment as sent
from casefile.functions import text as t
from casefile.functions.lexicon import DARVO
from casefile.operators import custody, email, entities, fusion, media, relational, telemetry
from casefile.sources import files, sinks
from casefile.streaming import state


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{k}") for k, c in enumerate(cols)]).first()


def test_luhn_and_ssn(spark):
    got = spark.createDataFrame([(x,) for x in ("4111111111111111", "378282246310005", "4111111111111112", "4111-1111-1111-1111", "41a1", "")], "x string").select(t.luhn(F.col("x"))).collect()
    assert [r[0] for r in got] == [True, True, False, True, False, False]
    got = spark.createDataFrame([(x,) for x in ("123-45-6789", "000-12-3456", "666 12 3456", "900-12-3456", "12-3456789")], "x string").select(t.valid_ssn(F.col("x"))).collect()
    assert [r[0] for r in got] == [True, False, False, False, True]


def test_spans_count_code_points(spark):
    text = "é\U0001f600 a1 b22 c333"
    spans = one(spark, text, t.match_spans(F.col("x"), r"\d+"))[0]
    assert [(s["start"], s["end"], text[s["start"] : s["end"]]) for s in spans] == [(4, 5, "1"), (7, 9, "22"), (11, 14, "333")]
    assert one(spark, "none", t.match_spans(F.col("x"), r"\d+"))[0] == []


def test_words_and_sentences(spark):
    r = one(spark, "One  TWO\xa0three\tHEY OK!! Two. ... Three?", t.word_count("x"), t.caps_count("x"), t.exclamations("x"), t.sentences("x"))
    assert (r[0], r[1], r[2]) == (8, 3, 2) and r[3] == ["One  TWO\xa0three\tHEY OK", "Two", "Three"]
    r = one(spark, None, t.word_count("x"), t.sentences("x"))
    assert r[0] == 0 and r[1] == []


def test_scores_by_hand(spark):
    text = "You never listen and it's your fault. Look what you did!"
    r = score.with_scores(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["darvo"] == 1.0 and r[0]["gaslighting"] == 0.0 and r[0]["manipulation"] == pytest.approx(0.4)
    assert r[0]["certainty"] == 1.0 and r[0]["emotional"] == pytest.approx(0.1)
    for row in r[1:]:
        assert all(row[c] == 0 for c in ("darvo", "gaslighting", "manipulation", "deception", "hedging", "certainty", "emotional"))


def test_scores_stay_in_bounds(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice([*DARVO, "x", "HELLO!", "maybe", "honestly"]) for _ in range(r.randint(0, 30)))) for k in range(60)]
    df = score.with_scores(spark.createDataFrame(rows, "doc_id long, text string"))
    df = df.withColumn("p", score.probabilities(F.col("darvo"), F.col("gaslighting")))
    for row in df.collect():
        assert all(0 <= row[c] <= 1 for c in ("darvo", "gaslighting", "manipulation", "deception", "hedging", "certainty", "emotional"))
        assert sum(x["p"] for x in row["p"]) == pytest.approx(1.0)


def test_ties_go_to_the_first_class(spark):
    p = score.first_maximum(score.probabilities(F.lit(0.5), F.lit(0.5)))
    assert one(spark, "", p)[0]["cls"] == "darvo"


def test_fusion_without_indicators(spark):
    r = one(spark, "", score.fused(F.lit(None).cast("double"), F.lit(0.8), F.lit(0.9)), score.fused(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double")))
    assert r[0] == pytest.approx(0.4) and r[1] == pytest.approx(0.85 * 0.7 + 0.15 * 0.5)


GATE = "evidence_id long, deception double, manipulation double, fused_score double, text string, timeline_valid boolean, ok boolean"


def test_gate_precedence(spark):
    long = "x" * 60
    rows = [(1, 0.1, 0.1, 0.5, long, None, True), (2, 0.8, 0.1, 0.5, long, None, True), (3, 0.1, 0.8, 0.5, long, None, True), (4, 0.1, 0.1, 0.2, long, None, True), (5, 0.1, 0.1, 0.5, " short ", None, True), (6, 0.8, 0.1, 0.5, None, False, True), (7, 0.1, 0.1, 0.5, long, True, False), (8, None, None, None, long, None, True), (9, 0.1, 0.1, 0.5, long, None, True)]
    e = spark.createDataFrame(rows, GATE)
    r = spark.createDataFrame([(9, 1, "ocr", 0.9, ["bad"]), (8, 1, "ocr", 0.45, []), (8, 2, "ocr", 0.2, [])], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    reasons = fusion.block_reasons(e, r)
    got = {x["evidence_id"]: x["routing"] for x in fusion.routing(e, reasons, "ok").collect()}
    assert got == {1: "auto_ok", 2: "review", 3: "review", 4: "review", 5: "review", 6: "blocked", 7: "blocked", 8: "review", 9: "review"}
    codes = sorted((x["evidence_id"], x["code"]) for x in reasons.collect())
    assert codes == [(2, "HIGH_DECEPTION_SCORE"), (3, "HIGH_MANIPULATION_SCORE"), (4, "LOW_FUSION_SCORE"), (5, "MISSING_CONTENT"), (6, "HIGH_DECEPTION_SCORE"), (6, "IMPOSSIBLE_TIMELINE"), (6, "MISSING_CONTENT"), (8, "ANOMALY_DETECTED"), (8, "LOW_AGENT_CONFIDENCE"), (8, "LOW_AGENT_CONFIDENCE"), (9, "ANALYSIS_ERROR"), (9, "ANOMALY_DETECTED")]


def test_missing_documents_never_route_alone(spark):
    """The only code that begins with MISSING_ is of high severity, so review comes first."""
    e = spark.createDataFrame([(1, 0.0, 0.0, 0.5, "", None, True)], GATE)
    none = spark.createDataFrame([], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    assert fusion.routing(e, fusion.block_reasons(e, none)).first()["routing"] == "review"


CHAIN = "evidence_id long, id long, ts timestamp, agent_id string, action string, input_hash string, output_hash string, seed string"


def test_custody_chains(spark):
    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    rows = [(1, 1, at(1), "a", "x", "s", "h1", "s"), (1, 2, at(2), "a", "y", "h1", "h2", "s"), (2, 1, at(1), "a", "x", "s", "h1", "s"), (2, 2, at(1), "a", "y", "zz", "h2", "s"), (3, 1, at(1), "a", "x", "wrong", "h", "s")]
    df = spark.createDataFrame(rows, CHAIN)
    assert {r["evidence_id"]: r["valid"] for r in custody.verify(df).collect()} == {1: True, 2: False, 3: True}
    assert {r["evidence_id"]: r["valid"] for r in custody.verify(df, "seed").collect()} == {1: True, 2: False, 3: False}
    assert [tuple(r) for r in custody.issues(df).collect()] == [(2, 1, "h1", "zz")]
    assert custody.verify(df.limit(0)).count() == 0
    a, b = ({r["evidence_id"]: r["chain_hash"] for r in custody.chain_hash(x).collect()} for x in (df, df.orderBy(F.desc("id"))))
    assert a == b and len(set(a.values())) == 3


def test_overlap_join(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 5.0), (1, 2, 9.0, 10.0), (2, 0, 0.0, 4.0)], "audio_id long, idx int, start double, end double")
    u = spark.createDataFrame([(1, 0, 0.0, 1.5, "A"), (1, 1, 1.5, 4.9, "B"), (1, 2, 4.9, 6.0, "A"), (2, 0, 0.0, 2.0, "X"), (2, 1, 2.0, 4.0, "Y")], "audio_id long, idx int, start double, end double, speaker string")
    for bucket in (60.0, 1.0):
        got = {(r["audio_id"], r["idx"]): r["speaker"] for r in media.speakers(s, u, bucket).collect()}
        assert got == {(1, 0): "A", (1, 1): "B", (1, 2): "UNKNOWN", (2, 0): "X"}


def test_percentile_conventions(spark):
    df = spark.createDataFrame([("g", float(k)) for k in range(1, 11)], "g string, ms double")
    assert telemetry.latency_by_index(df, ["g"]).first()["p95"] == 10.0
    assert telemetry.latency_interpolated(df, ["g"]).first()["p95"] == pytest.approx(9.55)


def test_encryption_is_bound_to_the_id(spark):
    key = F.lit(b"0" * 32)
    df = spark.createDataFrame([("1", "hello")], "id string, x string").select("id", ingest.encrypted("x", key, "id").alias("c")).cache()
    r = df.select(F.length("c"), ingest.decrypted("c", key, "id").cast("string"), ingest.decrypted("c", key, F.lit("2")), ingest.decrypted("c", F.lit(b"1" * 32), "id")).first()
    assert tuple(r) == (33, "hello", None, None)


def test_redaction_leaves_no_mention(spark):
    text = "\U0001f600 call 555-123-4567, mail a.b@c.org or a.b@c.org; ssn 123-45-6789, card 4111111111111111."
    docs = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    m = entities.personal_mentions(docs)
    got = {r["doc_id"]: r["text"] for r in entities.redact(docs, m).collect()}
    assert got[1] == "\U0001f600 call [PHONE REDACTED], mail [EMAIL REDACTED] or [EMAIL REDACTED]; ssn [SSN REDACTED], card [CC REDACTED]." or "4567" not in got[1]
    assert not any(x in got[1] for x in ("4567", "a.b@", "6789", "4111")) and got[2] == "nothing" and got[3] is None
    masked = {r["doc_id"]: r["text"] for r in entities.mask(docs, m).collect()}[1]
    assert "****@c.org" in masked and "a.b" not in masked and "6789" in masked


def test_clusters(spark):
    m = spark.createDataFrame([(1, 0, 4, "PERSON", "Ann Lee"), (1, 9, 12, "PERSON", "Lee"), (1, 20, 23, "ORG", "Lee"), (1, 30, 33, "PERSON", "Bob"), (1, 40, 43, "ORG", "LEE")], "doc_id long, start int, end int, label string, text string")
    got = sorted((r["canonical"], r["label"], r["n"]) for r in entities.clusters(m).collect())
    assert got == [("Ann Lee", "PERSON", 2), ("Lee", "ORG", 2)]


def test_decoding(spark):
    rows = [(1, "né".encode()), (2, "né".encode("utf-16")), (3, "né".encode("latin-1")), (4, b""), (5, None)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, b binary").select("i", t.decoded("b").alias("t")).collect()}
    assert got == {1: "né", 2: "né", 3: "né", 4: "", 5: None}


def test_file_types(spark):
    rows = [(b"%PDF-1.4", "a.txt"), (b"PK\x03\x04xxxxword/document.xml", "a.zip"), (b"PK\x03\x04zzzz", "a.pptx"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1....Workbook", "x"), (b"{\\rtf1", "x"), (b"hi", "a.CSV"), (b"hi", "noext")]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary, n string").select(ingest.document_type("c", "n")).collect()]
    assert got == ["pdf", "docx", "pptx", "xls", "rtf", "csv", "unknown"]
    rows = [("a.pdf", "application/pdf", 1, b"%PDF-1.4 x"), ("a.png", "image/png", 1, b"%PDF-1.4 x"), ("con.txt", None, 1, b""), ("a", None, 1, b""), ("a.pdf", "x/y", 1, None), ("x" * 252 + ".pdf", None, 1, None), ("a.pdf", None, 10**12, None)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string, m string, s long, c binary").select(ingest.upload_error("n", "m", "s", "c")).collect()]
    assert got[0] is None and got[1].startswith("File content does not match") and got[2] == got[2] and "invalid characters" in got[2]
    assert got[3] == "File must have an extension" and "x/y" in got[4] and "too long" in got[5] and "500MB" in got[6]


def test_safe_names(spark):
    rows = ["/a/b/../c?.txt", "..", ". x .", "y" * 300 + ".tar.gz", "ok.txt"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(ingest.safe_name("x")).collect()]
    assert got[0] == "c_.txt" and got[1] == "unnamed_file" and got[2] == "x" and len(got[3]) == 200 and got[3].endswith(".gz") and got[4] == "ok.txt"


def test_image_bytes(spark):
    jpeg = b"\xff\xd8" + b"\xff\xdb.." * 3
    odd = b"\xff\xd8" + b"\x0f\xfd\xb0" * 5
    got = [r[0] for r in spark.createDataFrame([(jpeg,), (jpeg[:10],), (odd,), (b"x" + jpeg,)], "c binary").select(t.double_compressed("c")).collect()]
    assert got == [True, False, False, False]


MAIL = b"""From: "Bank bank@bank.com" <a@evil.org>
To: x@y.org
Reply-To: z@other.net
Subject: Re: hi
Date: Mon, 5 Feb 2024 10:00:00 +0100
Message-ID: <2@x>
References: <1@x>  <0@x>
Received-SPF: softfail
Received: a
Received: b
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/plain

See http://a.org/x. And http://a.org/x, www.b.org
--B
Content-Type: application/octet-stream
Content-Disposition: attachment; filename=f.bin
Content-Transfer-Encoding: base64

aGVsbG8=
--B--
"""


def test_mails(spark, tmp_path):
    (tmp_path / "m.eml").write_bytes(MAIL)
    (tmp_path / "bad.eml").write_bytes(b"\xff\xfe\x00")
    m = {r["path"].rsplit("/", 1)[1]: r for r in files.read_mails(spark, str(tmp_path)).collect()}["m.eml"]
    assert m["message_id"] == "<2@x>" and m["received_chain"] == ["a", "b"] and m["attachments"][0]["size_bytes"] == 5
    df = email.with_spoof_risk(files.read_mails(spark, str(tmp_path), "m.eml"))
    r = df.select("warnings", "risk", t.urls("body_text").alias("u"), t.mail_date("date_text").alias("d")).first()
    assert r["risk"] == "high" and set(r["warnings"]) == {"spf_softfail", "reply_to_mismatch", "display_name_mismatch"}
    assert r["u"] == ["http://a.org/x", "www.b.org"] and r["d"] == dt.datetime(2024, 2, 5, 9)
    th = email.threads(df.withColumn("date", F.current_timestamp())).first()
    assert (th["is_reply"], th["depth"], th["thread_key"]) == (True, 2, "<1@x>")
    scan = {r["path"].rsplit("/", 1)[1]: r for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert scan["m.eml"]["evidence_type"] == "email" and len(scan["m.eml"]["sha256"]) == 64


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, 7, "open"), (2, 7, "x")], "evidence_id long, case_id long, status string")
    c = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), "a", "b", "c", "d")], "evidence_id long, id long, ts timestamp, agent_id string, action string, input_hash string, output_hash string")
    r = spark.createDataFrame([(1, 1, "ocr", 0.5, ["e"])], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    sinks.export_cases(e, c, r, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out/evidence"))
    listed = spark.read.json(str(tmp_path / "out/manifest"))
    assert {x["state"] for x in sinks.check_manifest(listed, back).collect()} == {"OK"}
    assert {x["state"] for x in sinks.check_manifest(listed, back.withColumn("json", F.lit("{}"))).collect()} == {"FAIL"}
    for form in ("json", "csv"):
        sinks.export_custody(c, str(tmp_path / form), form)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns[:10] == sinks.CUSTODY_COLUMNS
    sinks.write_results(e.selectExpr("'f' as file", "status", "'c' as class", "0.5 as score"), str(tmp_path / "res"))
    sinks.append(sinks.stage_events(e, "x", F.current_timestamp()), str(tmp_path / "log"))
    sinks.append(sinks.stage_events(e, "y", F.current_timestamp()), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    cases = spark.createDataFrame([(7, "T"), (8, "U")], "case_id long, title string")
    full = e.withColumns({"evidence_type": F.lit("text"), "fused_score": F.lit(0.5), "fused_class": F.lit("c")})
    for form in ("markdown", "html", "json"):
        assert sinks.case_reports(cases, full, form).count() == 2


def test_relational_edges(spark):
    now = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(k, k % 2, "h", now + dt.timedelta(minutes=k // 2)) for k in range(10)], "evidence_id long, case_id long, original_hash string, created_at timestamp")
    assert [r["evidence_id"] for r in relational.page_after(e, None, 3).collect()] == [8, 9, 6]
    assert [r["evidence_id"] for r in relational.page_after(e, (now + dt.timedelta(minutes=4), 9), 3).collect()] == [6, 7, 4]
    assert relational.new_content(e, e.limit(0)).count() == 2 and relational.new_content(e, e).count() == 0
    assert relational.page(e, 1, 4).first()["pages"] == 3


def test_sentiment(spark):
    lex = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "word string, valence double")
    docs = spark.createDataFrame([(1, "Very good!"), (2, "not good"), (3, "bad"), (4, "table"), (5, None)], "doc_id long, text string")
    c = {r["doc_id"]: r for r in sent.sentiment(docs, lex).collect()}
    assert c[1]["compound"] > 0.49 and c[2]["compound"] < 0 and c[3]["compound"] < -0.5
    assert tuple(c[4]) == (4, 0.0, 0.0, 1.0, 0.0) and tuple(c[5]) == (5, 0.0, 0.0, 1.0, 0.0)


def test_limits_by_hand():
    times, out = state.accepted_within([], [(k, t_) for k, t_ in enumerate((0, 1, 2, 3, 10, 11))], 10, 2)
    assert [a for _, a, _ in out] == [True, True, False, False, True, True] and times == [10, 11]
    _, out = state.fixed_window((0, 0), [(k, t_) for k, t_ in enumerate((5, 6, 7, 14, 15))], 10, 2)
    assert [a for _, a, _ in out] == [True, True, False, False, True]


def test_stream_equals_batch(spark):
    from casefile.plans.catalog import QUERIES

    d = "/root/testdata/sf0.001"
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, d).select("key", "id", "allowed", "remaining").collect()))
    assert rows("stm2_stream_accepted_limit") == rows("stm2_accepted_limit")


def test_counters_as_a_stream(spark):
    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    s = spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    q = state.stage_counters(s, "1 day").writeStream.format("memory").queryName("counters").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counters").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_arrivals_are_scored(spark, tmp_path):
    spark.createDataFrame([(1, "it's your fault", "pending"), (2, "x", "analyzed")], "doc_id long, text string, status string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string, status string").parquet(str(tmp_path / "in"))
    state.score_arrivals(stream, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["darvo"] == 1.0
