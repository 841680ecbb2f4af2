"""The registry of queries, and tables that stand in for evidence tables.

Each query reads the given tables whole. Stand-ins are derived from them the same way in Spark and
in SQL: cases are customers, evidence orders, results line items, logs and custody entries events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Appended to documents, one to each, since their invented words hold no phrase of the lexicon.
PHRASES = [
    "You always do this and it's your fault!", "That's not what happened, you're being paranoid.", "Honestly, I think that person might be lying.", "If you loved me you would. You owe me!!", "I did not do it. Trust me, they say someone did.",
    "Maybe, perhaps, I guess it could be so.", "You must definitely stop. I HATE this horrible MESS!", "I'm the victim. You made me do it, look what you did.", "You're too sensitive; i never said that. You're imagining things up.", "No one else thinks so, you never remember.",
    "Call (555) 123-4567 or mail a.b@example.com by 12/31/2024.", "SSN 123-45-6789 and 666-12-3456, card 4111111111111111 or 4111111111111112.", "Paid $1,234.50 and 20 dollars, see 18 U.S.C. 1030 at 10:30 PM.", "Server 10.0.0.1 via https://example.org/x?y=1 on 2024-05-06.", "plain words only",
]


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, d):
    """Documents, each with a phrase."""
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    return read(spark, d, "documents").select("doc_id", F.concat("text", F.lit(" "), F.get(phrases, (F.col("doc_id") % len(PHRASES)).cast("int"))).alias("text"), "source")


def phrases(spark, d):
    """Whole documents behind a phrase each."""
    p = F.array(*[F.lit(x) for x in PHRASES])
    return spread(read(spark, d, "documents")).select("doc_id", F.concat(F.get(p, (F.col("doc_id") % len(PHRASES)).cast("int")), F.lit(" "), "text").alias("text"))


def cases(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("title"), F.concat(F.lit("CN-"), F.col("c_custkey").cast("string")).alias("case_number"), F.when(F.col("c_nationkey") % 3 == 0, "open").otherwise("active").alias("status"))


def evidence(spark, d):
    s = F.col("o_orderstatus")
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        k.alias("evidence_id"), F.col("o_custkey").alias("case_id"), F.when(s == "O", "pending").when(s == "F", "analyzed").when(k % 5 == 0, "verified").otherwise("flagged").alias("status"), F.element_at(F.split("o_orderpriority", "-"), 2).alias("evidence_type"),
        F.col("o_orderdate").alias("created_at"), F.sha2((k % 4000).cast("string"), 256).alias("original_hash"), F.round(F.col("o_totalprice") / F.lit(499979.0), 6).alias("fused_score"), (k % 7).alias("version"),
    )


AGENTS = ["behavioral", "fusion", "ocr", "email", "entity"]


def results(spark, d):
    agents = F.array(*[F.lit(a) for a in AGENTS])
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("evidence_id"), F.col("l_linenumber").alias("seq"), F.get(agents, (F.col("l_suppkey") % 5).cast("int")).alias("agent_type"), F.round(F.col("l_discount") * 10, 6).alias("confidence"),
        F.when(failed, F.array(F.lit("failed"))).otherwise(F.array().cast("array<string>")).alias("errors"), F.round(F.col("l_quantity") * 10, 2).alias("processing_time_ms"),
    )


def log(spark, d):
    return read(spark, d, "events").select(F.col("event_id").alias("id"), "ts", "user_id", "event_type", F.round(F.col("value") * 10, 4).alias("ms"), (F.col("event_type") != "error").alias("success"), (F.col("user_id") % 20).alias("grp"))


def custody(spark, d):
    """Chains by user; the entries whose id 17 divides do not link."""
    e = read(spark, d, "events")
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    h = lambda c: F.sha2(c.cast("string"), 256)
    x = e.select(F.col("user_id").alias("evidence_id"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("action"), before.alias("b"))
    return x.select("evidence_id", "id", "ts", F.lit("agent").alias("agent_id"), "action", h(F.when(F.col("id") % 17 == 0, F.lit("broken")).otherwise(F.coalesce(F.col("b"), F.col("evidence_id")).cast("string"))).alias("input_hash"), h(F.col("id")).alias("output_hash"), h(F.col("evidence_id")).alias("original_hash"))


def _lit(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


TABLES = {
    "texts": f"SELECT doc_id, text || ' ' || {_lit(PHRASES)}[doc_id % {len(PHRASES)} + 1] AS text, source FROM documents",
    "phrases": f"SELECT doc_id, {_lit(PHRASES)}[doc_id % {len(PHRASES)} + 1] || ' ' || text AS text FROM documents",
    "cases": "SELECT c_custkey AS case_id, c_name AS title, 'CN-' || c_custkey AS case_number, CASE WHEN c_nationkey % 3 = 0 THEN 'open' ELSE 'active' END AS status FROM customer",
    "evidence": "SELECT o_orderkey AS evidence_id, o_custkey AS case_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'analyzed' WHEN o_orderkey % 5 = 0 THEN 'verified' ELSE 'flagged' END AS status, split_part(o_orderpriority, '-', 2) AS evidence_type, o_orderdate AS created_at, sha256((o_orderkey % 4000)::VARCHAR) AS original_hash, round(o_totalprice / 499979.0::DOUBLE, 6) AS fused_score, o_orderkey % 7 AS version FROM orders",
    "results": f"SELECT l_orderkey AS evidence_id, l_linenumber AS seq, {_lit(AGENTS)}[l_suppkey % 5 + 1] AS agent_type, round(l_discount * 10, 6) AS confidence, (l_returnflag = 'R' AND l_linenumber = 1) AS failed, round(l_quantity * 10, 2) AS processing_time_ms FROM lineitem",
    "log": "SELECT event_id AS id, ts, user_id, event_type, round(value * 10, 4) AS ms, event_type <> 'error' AS success, user_id % 20 AS grp FROM events",
    "custody": "SELECT user_id AS evidence_id, event_id AS id, ts, 'agent' AS agent_id, event_type AS action, sha256(CASE WHEN event_id % 17 = 0 THEN 'broken' ELSE coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), user_id)::VARCHAR END) AS input_hash, sha256(event_id::VARCHAR) AS output_hash, sha256(user_id::VARCHAR) AS original_hash FROM events",
}


def sql(tables: str, body: str) -> str:
    """SQL over stand-ins; the body may begin with further common tables."""
    names = tables.split()
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in names) + (",\n" if body.lstrip().startswith("_") else "\n") + body
