"""Mail tables: threads, spoofing risk by sender's domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.functions import score as s
from casefile.functions import text as t


def thread_columns(subject: Column, in_reply_to: Column, references: Column) -> dict[str, Column]:
    """WIN4: flags, depth and thread of one mail. Message ids don't hold white space."""
    ids = F.filter(F.split(F.coalesce(references, F.lit("")), t.SPACES), lambda x: x != "")
    said = F.coalesce(subject, F.lit(""))
    answer = (F.coalesce(in_reply_to, F.lit("")) != "") | (F.coalesce(references, F.lit("")) != "") | F.regexp_like(said, F.lit(r"(?i)^re:"))
    return {"is_reply": answer, "is_forward": F.regexp_like(said, F.lit(r"(?i)^(fwd|fw):")), "depth": F.size(ids), "thread_id": F.get(ids, F.lit(0))}


def threads(mails: DataFrame) -> DataFrame:
    """WIN4: mails with thread columns, the thread's key and the mail's place in it by date."""
    x = mails.withColumns(thread_columns(F.col("subject"), F.col("in_reply_to"), F.col("references")))
    x = x.withColumn("thread_key", F.coalesce("thread_id", "message_id"))
    return x.withColumn("position", F.row_number().over(Window.partitionBy("thread_key").orderBy("date", "message_id")))


def with_spoof_risk(mails: DataFrame) -> DataFrame:
    """SCR13: warnings and risk of each mail."""
    found = s.spoof_warnings(F.col("received_spf"), F.col("authentication_results"), F.col("from"), F.col("reply_to"), F.size("received_chain"))
    return mails.withColumn("warnings", found).withColumn("risk", s.risk_of(F.col("warnings")))


def risk_by_domain(scored: DataFrame) -> DataFrame:
    """AGG9."""
    n = scored.groupBy(t.domain(t.sender("from")).alias("domain")).agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("high", "medium", "low")], F.avg(F.size("warnings")).alias("mean_warnings"))
    return n


def mail_texts(mails: DataFrame) -> DataFrame:
    """STR9, STR10: what is scored of each mail: subject and body, the HTML body where there is no text."""
    body = F.coalesce(F.nullif(F.col("body_text"), F.lit("")), t.html_to_text("body_html"))
    return mails.withColumn("text", t.mail_text("subject", body))
