"""Sinks: case packages with a manifest, custody exports, reports, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.sources import packed


def evidence_json(evidence: DataFrame, custody: DataFrame, results: DataFrame) -> DataFrame:
    """SNK1: case_id, evidence_id, path, json: one document for each item with its custody and results."""
    chain = custody.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("ts", "id", "agent_id", "action", "input_hash", "output_hash"))).alias("custody"))
    found = results.groupBy("evidence_id").agg(F.sort_array(F.collect_list(F.struct("seq", "agent_type", "confidence", "errors"))).alias("results"))
    whole = evidence.join(chain, "evidence_id", "left").join(found, "evidence_id", "left")
    return whole.select("case_id", "evidence_id", F.concat(F.lit("evidence/"), F.col("evidence_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct(*[c for c in whole.columns if c != "case_id"])).alias("json"))


def manifest(files: DataFrame) -> DataFrame:
    """SNK1: path, type, size and SHA-256 of each file of a package."""
    return files.select("case_id", "path", F.lit("evidence_data").alias("type"), F.octet_length("json").alias("size_bytes"), F.sha2("json", 256).alias("sha256"))


def export_cases(evidence: DataFrame, custody: DataFrame, results: DataFrame, path: str) -> None:
    """SNK1: packages below ``path``, by case: evidence files and the manifest."""
    files = evidence_json(evidence, custody, results)
    files.write.mode("overwrite").partitionBy("case_id").json(f"{path}/evidence")
    manifest(files).write.mode("overwrite").partitionBy("case_id").json(f"{path}/manifest")


def package_lines(evidence: DataFrame, custody: DataFrame, results: DataFrame) -> DataFrame:
    """SNK1, JOIN3: an item, its custody and its results as JSON lines in order: case_id, evidence_id, part (0 the item, 1 custody,
    2 results), at and nth (the order inside a part), json. No item's children are gathered, however many they are."""
    of = evidence.select("evidence_id", "case_id")
    line = lambda df, part, at, nth, names: df.select("case_id", "evidence_id", F.lit(part).alias("part"), at.alias("at"), F.col(nth).cast("long").alias("nth") if nth else F.lit(0).cast("long").alias("nth"), F.to_json(F.struct(F.lit(("evidence", "custody", "result")[part]).alias("kind"), *names)).alias("json"))
    none = F.lit(None).cast(custody.schema["ts"].dataType)
    own = line(evidence, 0, none, None, [c for c in evidence.columns if c != "case_id"])
    chain = line(custody.join(of, "evidence_id"), 1, F.col("ts"), "id", ["ts", "id", "agent_id", "action", "input_hash", "output_hash"])
    found = line(results.join(of, "evidence_id"), 2, none, "seq", ["seq", "agent_type", "confidence", "errors"])
    return own.unionByName(chain).unionByName(found)


def export_packages(evidence: DataFrame, custody: DataFrame, results: DataFrame, path: str, file_bytes: int = packed.FILE_BYTES) -> None:
    """SNK1: the items of all cases as one package of files of bounded size, by case and item, with index and manifest; nothing
    of it is there unless all of it is."""
    rows = package_lines(evidence, custody, results)
    key = F.concat(F.coalesce(F.col("case_id").cast("string"), F.lit("")), F.lit("/evidence/"), F.col("evidence_id").cast("string"), F.lit(".json"))
    packed.pack(rows, key, F.col("json"), [F.col("part"), F.col("at"), F.col("nth")], path, file_bytes)


def pack_custody(custody: DataFrame, path: str, file_bytes: int = packed.FILE_BYTES) -> None:
    """SNK3: custody entries as JSON lines by evidence, in order, in files of bounded size with an index."""
    named = [F.col(c) if c in custody.columns else F.lit(None).cast("string").alias(c) for c in CUSTODY_COLUMNS]
    packed.pack(custody, F.col("evidence_id"), F.to_json(F.struct(*named)), [F.col("ts"), F.col("id")], path, file_bytes)


def check_manifest(listed: DataFrame, files: DataFrame) -> DataFrame:
    """SNK2: OK, FAIL or ERROR (missing) for each listed file; ``files`` has case_id, path and json."""
    found = files.select("case_id", "path", F.sha2("json", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "ERROR").when(F.col("found") == F.col("sha256"), "OK").otherwise("FAIL")
    return listed.join(found, ["case_id", "path"], "left").select("case_id", "path", state.alias("state"))


CUSTODY_COLUMNS = ["id", "ts", "agent_id", "agent_type", "action", "input_hash", "output_hash", "processing_time_ms", "success", "error_message"]


def export_custody(custody: DataFrame, path: str, form: str = "json") -> None:
    """SNK3: the ten columns of custody entries as JSON or CSV, by evidence."""
    out = custody.select("evidence_id", *[F.col(c) if c in custody.columns else F.lit(None).cast("string").alias(c) for c in CUSTODY_COLUMNS])
    writer = out.write.mode("overwrite").partitionBy("evidence_id")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def case_reports(cases: DataFrame, evidence: DataFrame, form: str = "markdown") -> DataFrame:
    """SNK4: case_id and report: its title, counts and items, as JSON, Markdown or HTML text."""
    item = F.struct("evidence_id", "evidence_type", "status", F.round("fused_score", 3).alias("fused_score"), "fused_class")
    by = evidence.groupBy("case_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "flagged").alias("flagged"))
    x = cases.join(by, "case_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "flagged": F.coalesce("flagged", F.lit(0)), "items": F.coalesce("items", F.array())})
    line = lambda sep, pre, post: F.transform("items", lambda i: F.concat(F.lit(pre), F.concat_ws(sep, i["evidence_id"].cast("string"), F.coalesce(i["evidence_type"], F.lit("")), F.coalesce(i["status"], F.lit("")), F.coalesce(i["fused_score"].cast("string"), F.lit("-")), F.coalesce(i["fused_class"], F.lit("-"))), F.lit(post)))
    if form == "json":
        report: Column = F.to_json(F.struct("case_id", "title", "total", "flagged", "items"))
    elif form == "html":
        report = F.concat(F.lit("<h1>"), F.col("title"), F.lit("</h1><p>"), F.col("total").cast("string"), F.lit(" items, "), F.col("flagged").cast("string"), F.lit(" flagged</p><table>"), F.concat_ws("", line("</td><td>", "<tr><td>", "</td></tr>")), F.lit("</table>"))
    else:
        report = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("total").cast("string"), F.lit(" items, "), F.col("flagged").cast("string"), F.lit(" flagged\n\n| id | type | status | score | class |\n|-|-|-|-|-|\n"), F.concat_ws("\n", line(" | ", "| ", " |")))
    return x.select("case_id", report.alias("report"))


FORMS = ("markdown", "html", "json")


def report_lines(cases: DataFrame, evidence: DataFrame, form: str = "markdown") -> DataFrame:
    """SNK4: reports as lines in order: case_id, part (0 head, 1 items, 2 end), evidence_id (null but for items), line. Reports of
    any length; ``packed.pack`` writes them by case."""
    by = evidence.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "flagged").alias("flagged"))
    x = cases.join(by, "case_id", "left").withColumns({"total": F.coalesce("total", F.lit(0).cast("long")), "flagged": F.coalesce("flagged", F.lit(0).cast("long"))})
    total, flagged = F.col("total").cast("string"), F.col("flagged").cast("string")
    cells = [F.col("evidence_id").cast("string"), F.coalesce("evidence_type", F.lit("")), F.coalesce("status", F.lit("")), F.when(F.col("fused_score").isNotNull(), F.format_string("%.3f", "fused_score")).otherwise("-"), F.coalesce("fused_class", F.lit("-"))]
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head, item, end = {
        "markdown": (F.concat(F.lit("# "), "title", F.lit("\n\n"), total, F.lit(" items, "), flagged, F.lit(" flagged\n\n| id | type | status | score | class |\n|-|-|-|-|-|")), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), None),
        "html": (F.concat(F.lit("<h1>"), safe(F.col("title")), F.lit("</h1><p>"), total, F.lit(" items, "), flagged, F.lit(" flagged</p><table>")), F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", *[safe(c) for c in cells]), F.lit("</td></tr>")), F.lit("</table>")),
        "json": (F.to_json(F.struct("case_id", "title", "total", "flagged")), F.to_json(F.struct("evidence_id", "evidence_type", "status", F.round("fused_score", 3).alias("fused_score"), "fused_class")), None),
    }[form]
    none = F.lit(None).cast(evidence.schema["evidence_id"].dataType).alias("evidence_id")
    out = x.select("case_id", F.lit(0).alias("part"), none, head.alias("line"))
    out = out.unionByName(evidence.join(cases.select("case_id"), "case_id", "left_semi").select("case_id", F.lit(1).alias("part"), "evidence_id", item.alias("line")))
    return out if end is None else out.unionByName(x.select("case_id", F.lit(2).alias("part"), none, end.alias("line")))


def export_reports(cases: DataFrame, evidence: DataFrame, path: str, form: str = "markdown", file_bytes: int = packed.FILE_BYTES) -> None:
    """SNK4: all cases' reports as one package, by case."""
    packed.pack(report_lines(cases, evidence, form), F.col("case_id"), F.col("line"), [F.col("part"), F.col("evidence_id")], path, file_bytes)


def write_results(results: DataFrame, path: str) -> None:
    """SNK5: file, status, class and score of each item, as JSON lines."""
    results.select("file", "status", "class", "score").write.mode("overwrite").json(path)


def stage_events(evidence: DataFrame, stage: str, now: Column) -> DataFrame:
    """SNK6: audit rows for a stage that items have passed."""
    return evidence.select(now.alias("ts"), F.lit("system").alias("user_id"), F.lit(f"stage_{stage}").alias("action"), F.lit("evidence").alias("resource_type"), F.col("evidence_id").cast("string").alias("resource_id"), F.to_json(F.struct("status")).alias("new_value"))


def append(df: DataFrame, path: str) -> None:
    """SNK6: rows added to a log table; in streams this is the body of foreachBatch."""
    df.write.mode("append").parquet(path)
