"""Arriving evidence from scores to the gate, and tables that take each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.operators.analysis import Stages, evidence_stages, result_rows, standard_analysers

DONE = "_done"


def write_batch(tables: dict[str, DataFrame], at: str, batch_id: int) -> None:
    """Each table's rows of one batch, in a folder of the batch's own, then a sign that all are there. A batch that comes
    again after a failure replaces what it has written, so every batch counts once."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{at}/{name}/batch={batch_id}")
    session = next(iter(tables.values())).sparkSession
    session.range(1).select(F.lit(batch_id).cast("long").alias("id")).write.mode("overwrite").parquet(f"{at}/{DONE}/batch={batch_id}")


def written(spark: SparkSession, at: str, name: str) -> DataFrame:
    """A table's rows of all batches that are complete."""
    done = spark.read.parquet(f"{at}/{DONE}").select("batch")
    return spark.read.parquet(f"{at}/{name}").join(done, "batch", "left_semi")


def run_batches(stream: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]], at: str, available_now: bool = True, mode: str = "append"):
    """A started query that makes tables of each batch and writes them below ``at``; its checkpoint is there, too."""

    def sink(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            write_batch(make(df), at, batch_id)
        finally:
            df.unpersist()

    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{at}/_state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def analysed(evidence: DataFrame, stages: Stages | None = None) -> dict[str, DataFrame]:
    """STM4: the tables that one pass over evidence makes (evidence_id, evidence_type, text, raw, ts): evidence with its scores, status
    and routing; a result for each analyser, with its critique of itself; and a custody entry for each step, which links to the
    one before, the first to the content."""
    done = (stages or evidence_stages()).run(evidence)
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    scores = F.to_json(F.struct("darvo", "gaslighting", "manipulation", "deception", "primary_class"))
    fused = F.to_json(F.struct("fused_score", "fused_class", "tier"))
    hashes = [content, content, F.sha2(scores, 256), F.sha2(fused, 256), F.sha2(F.concat_ws("|", F.sha2(fused, 256), "routing"), 256)]
    steps = [("intake", "uploaded"), ("behavioral", "analyzed"), ("fusion", "fused"), ("gate", "routed")]
    entries = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(a).alias("agent_id"), F.lit(v).alias("action"), hashes[k].alias("input_hash"), hashes[k + 1].alias("output_hash")) for k, (a, v) in enumerate(steps)])
    state = F.when(F.col("error").isNotNull(), "error").otherwise(F.col("status"))
    kept = [c for c in ("case_id", "ts") if c in done.columns]
    return {
        "evidence": done.select("evidence_id", *kept, "evidence_type", state.alias("status"), "fused_score", "fused_class", "tier", "routing", content.alias("original_hash")),
        "results": result_rows(done, standard_analysers()),
        "custody": done.select("evidence_id", *[c for c in ("ts",) if c in done.columns], content.alias("original_hash"), F.explode(entries).alias("e")).select("*", "e.*").drop("e"),
    }


def process_arrivals(stream: DataFrame, at: str, stages: Stages | None = None, available_now: bool = True):
    """STM4: pending evidence through all stages as it comes, its evidence, results and custody rows below ``at``."""
    pending = stream.filter(F.col("status") == "pending").drop("status") if "status" in stream.columns else stream
    return run_batches(pending, lambda df: analysed(df, stages), at, available_now)
