"""Packed packages and files of any size."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from casefile.sources import files, packed, sinks

HOT = 3_000


@pytest.fixture(scope="module")
def rows(spark):
    data = [("hot", k, f"line {k} é") for k in range(HOT)] + [(f"k{k:03d}", 1, f"only {k}") for k in range(200)] + [(None, 1, "no key"), ("null", 1, None)]
    return spark.createDataFrame(data, "key string, nth long, line string").repartition(6)


def test_a_package_is_few_files_and_whole(spark, rows, tmp_path):
    at = str(tmp_path / "p")
    packed.pack(rows, F.col("key"), F.col("line"), [F.col("nth")], at, 4_000)
    data = os.listdir(f"{at}/data")
    size = sum(os.path.getsize(f"{at}/data/{f}") for f in data)
    assert max(os.path.getsize(f"{at}/data/{f}") for f in data) <= 4_000 and len(data) <= size / 4_000 + spark.sparkContext.defaultParallelism + 8
    back = packed.lines(spark, at).orderBy("key", "file", "offset", "nth").collect()
    assert [r["line"] for r in back if r["key"] == "hot"] == [f"line {k} é" for k in range(HOT)] and len(back) == HOT + 200
    assert len({r["file"] for r in back if r["key"] == "hot"}) > 5
    some = packed.lines(spark, at, spark.createDataFrame([("k007",), ("k199",)], "key string")).collect()
    assert sorted(r["line"] for r in some) == ["only 199", "only 7"]
    assert {r["state"] for r in packed.verified(spark, at).collect()} == {"OK"}


def test_changed_and_missing_files_are_found(spark, rows, tmp_path):
    at = str(tmp_path / "p")
    packed.pack(rows, F.col("key"), F.col("line"), [F.col("nth")], at, 4_000)
    names = sorted(os.listdir(f"{at}/data"))
    os.remove(f"{at}/data/{names[0]}")
    with open(f"{at}/data/{names[-1]}", "r+b") as f:
        f.write(b"#")
    states = {}
    for r in packed.verified(spark, at).collect():
        states.setdefault(r["file"].split("/")[1], []).append(r["state"])
    assert set(states[names[0]]) == {"ERROR"} and states[names[-1]].count("FAIL") == 1 and all(set(s) == {"OK"} for n, s in states.items() if n not in (names[0], names[-1]))


def test_a_failed_package_is_none(spark, rows, tmp_path):
    at = str(tmp_path / "p")
    spark.dataSource.register(packed.PackedSource)
    broken = rows.filter("key is not null and line is not null").withColumn("line", F.when(F.col("key") == "k150", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        broken.select("key", "line").write.format("casefile_packed").option("path", at).mode("append").save()
    assert not os.path.exists(f"{at}/manifest.json")
    with pytest.raises(FileNotFoundError):
        packed.index(spark, at)
    packed.pack(rows, F.col("key"), F.col("line"), [F.col("nth")], at)
    assert packed.lines(spark, at).count() == HOT + 200
    listed = {r["file"] for r in packed.index(spark, at).collect()}
    assert {f"data/{f}" for f in os.listdir(f"{at}/data")} == listed


def test_a_package_is_not_written_over(spark, rows, tmp_path):
    at = str(tmp_path / "p")
    packed.pack(rows, F.col("key"), F.col("line"), [], at)
    with pytest.raises(Exception, match="already"):
        packed.pack(rows, F.col("key"), F.col("line"), [], at)


def test_an_empty_package(spark, rows, tmp_path):
    at = str(tmp_path / "p")
    packed.pack(rows.limit(0), F.col("key"), F.col("line"), [], at)
    assert packed.lines(spark, at).count() == 0 and packed.verified(spark, at).count() == 0


def test_cases_are_packed_with_custody_and_results(spark, tmp_path):
    evidence = spark.createDataFrame([(1, 10, "text"), (2, 10, None), (3, 11, "x")], "evidence_id long, case_id long, text string")
    custody = spark.createDataFrame([(1, 1, 5, "a", "b", "c", "d")], "evidence_id long, id long, ts long, agent_id string, action string, input_hash string, output_hash string")
    results = spark.createDataFrame([(1, 0, "ocr", 0.5, [])], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    at = str(tmp_path / "p")
    sinks.export_packages(evidence, custody, results, at)
    got = {}
    for r in packed.lines(spark, at).orderBy("key", "file", "offset", "nth").collect():
        got.setdefault(r["key"], []).append(json.loads(r["line"]))
    assert set(got) == {"10/evidence/1.json", "10/evidence/2.json", "11/evidence/3.json"}
    assert [x["kind"] for x in got["10/evidence/1.json"]] == ["evidence", "custody", "result"] and got["10/evidence/1.json"][2]["agent_type"] == "ocr" and len(got["11/evidence/3.json"]) == 1


def test_a_chain_of_one_item_is_many_lines_in_order(spark, tmp_path):
    evidence = spark.createDataFrame([(1, 10)], "evidence_id long, case_id long")
    custody = spark.createDataFrame([(1, k, k // 2, "a", "b", "c", f"d{k}") for k in range(2_000)], "evidence_id long, id long, ts long, agent_id string, action string, input_hash string, output_hash string").repartition(5)
    results = spark.createDataFrame([], "evidence_id long, seq int, agent_type string, confidence double, errors array<string>")
    at = str(tmp_path / "p")
    sinks.export_packages(evidence, custody, results, at, 20_000)
    back = [json.loads(r["line"]) for r in packed.lines(spark, at).orderBy("file", "offset", "nth").collect()]
    assert [x.get("output_hash") for x in back] == [None] + [f"d{k}" for k in range(2_000)] and len(os.listdir(f"{at}/data")) > 5


def test_reports_in_three_forms(spark, tmp_path):
    cases = spark.createDataFrame([(1, "A < B"), (2, "none")], "case_id long, title string")
    evidence = spark.createDataFrame([(5, 1, "text", "flagged", 0.12345, "x"), (4, 1, None, None, None, None), (6, 9, "text", "flagged", 0.5, "y")], "evidence_id long, case_id long, evidence_type string, status string, fused_score double, fused_class string")
    text = {}
    for form in sinks.FORMS:
        at = str(tmp_path / form)
        sinks.export_reports(cases, evidence, at, form)
        for r in packed.lines(spark, at).orderBy("key", "file", "offset", "nth").collect():
            text[form, r["key"]] = text.get((form, r["key"]), "") + r["line"] + "\n"
    assert text["markdown", "1"].endswith("|-|-|-|-|-|\n| 4 |  |  | - | - |\n| 5 | text | flagged | 0.123 | x |\n") and text["markdown", "2"].startswith("# none\n\n0 items, 0 flagged")
    assert text["html", "1"] == "<h1>A &lt; B</h1><p>2 items, 1 flagged</p><table>\n<tr><td>4</td><td></td><td></td><td>-</td><td>-</td></tr>\n<tr><td>5</td><td>text</td><td>flagged</td><td>0.123</td><td>x</td></tr>\n</table>\n"
    assert [json.loads(x) for x in text["json", "1"].splitlines()] == [{"case_id": 1, "title": "A < B", "total": 2, "flagged": 1}, {"evidence_id": 4}, {"evidence_id": 5, "evidence_type": "text", "status": "flagged", "fused_score": 0.123, "fused_class": "x"}]


def test_a_file_of_three_gigabytes_is_hashed(spark, tmp_path):
    size = 3 * (1 << 30) + 5
    with open(tmp_path / "large.mp4", "wb") as f:
        f.truncate(size)
    (tmp_path / "small.txt").write_bytes(b"abc")
    got = {os.path.basename(r["path"]): r for r in files.scan_files(spark, str(tmp_path)).collect()}
    hash_, block = hashlib.sha256(), b"\0" * (1 << 20)
    for _ in range(size >> 20):
        hash_.update(block)
    hash_.update(b"\0" * (size & 0xFFFFF))
    assert got["large.mp4"]["sha256"] == hash_.hexdigest() and got["large.mp4"]["size_bytes"] == size
    assert got["small.txt"]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    both = files.scan_files(spark, str(tmp_path), keep_content=True).orderBy("path").collect()
    assert both[0]["content"] is None and bytes(both[1]["content"]) == b"abc"
