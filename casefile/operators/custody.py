"""Custody logs: one row for each entry (evidence_id, id, ts, agent_id, action, input_hash,
output_hash), ordered by (ts, id). A chain may hold any share of all entries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile.operators.ordered import previous


def linked(custody: DataFrame, seed: str | None = None) -> DataFrame:
    """WIN1, WIN2: each entry with what its input hash must be (null for the first of an unseeded
    chain) and whether it is. ``seed`` names a column with the evidence's original hash."""
    before = F.col("_before")["output_hash"]
    expected = before if seed is None else F.when(F.col("_idx") == 0, F.col(seed)).otherwise(before)
    out = previous(custody, ["evidence_id"], ["ts", "id"], ["output_hash"]).withColumns({"idx": F.col("_idx").cast("int"), "expected": expected})
    return out.drop("_idx", "_before").withColumn("linked", F.col("expected").isNull() | F.col("expected").eqNullSafe(F.col("input_hash")))


def verify(custody: DataFrame, seed: str | None = None) -> DataFrame:
    """evidence_id, entries, valid, breaks, first_ts, last_ts."""
    return linked(custody, seed).groupBy("evidence_id").agg(
        F.count(F.lit(1)).alias("entries"), F.bool_and("linked").alias("valid"), F.count_if(~F.col("linked")).alias("breaks"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def issues(custody: DataFrame, seed: str | None = None) -> DataFrame:
    """Where chains break: evidence_id, idx, expected, found."""
    return linked(custody, seed).filter(~F.col("linked")).select("evidence_id", "idx", "expected", F.col("input_hash").alias("found"))


def _hashed(batches):
    """SHA-256 of each chain's lines, which come together and in order; only the hash's state is held."""
    chain, state = None, None
    for batch in batches:
        names, out = batch.schema.names[:1], []
        ids, lines = batch.column(0), batch.column(batch.num_columns - 1).to_pylist()
        for id_, line in zip(ids.to_pylist(), lines):
            if state is None or id_ != chain:
                if state is not None:
                    out.append((chain, state.hexdigest()))
                chain, state = id_, hashlib.sha256(line.encode())
            else:
                state.update(b"|" + line.encode())
        kind = ids.type
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([h for _, h in out])], names=[*names, "chain_hash"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([chain], kind), pa.array([state.hexdigest()])], names=[*names, "chain_hash"])


def chain_hash(custody: DataFrame) -> DataFrame:
    """WIN3: SHA-256 over all entries in order. Entries are sorted by Spark and read one by one, so a chain of any length takes
    no more memory than one entry; a hash has to be taken in order, so one task reads a chain."""
    line = F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "agent_id", "action", "input_hash", "output_hash").alias("line")
    lines = custody.select("evidence_id", "ts", "id", line)
    kind = lines.schema["evidence_id"].dataType.simpleString()
    return lines.repartition("evidence_id").sortWithinPartitions("evidence_id", "ts", "id", "line").select("evidence_id", "line").mapInArrow(_hashed, f"evidence_id {kind}, chain_hash string")


def first_entries(evidence: DataFrame, agent: str = "intake", action: str = "uploaded") -> DataFrame:
    """SRC13: the custody entry of new evidence, whose input and output are the content's hash."""
    return evidence.select("evidence_id", F.col("created_at").alias("ts"), F.lit(agent).alias("agent_id"), F.lit(action).alias("action"), F.col("original_hash").alias("input_hash"), F.col("original_hash").alias("output_hash"))


def verify_content(evidence: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET6: compare stored hashes with those of a scan (path, sha256); evidence with new statuses,
    and the custody entries of verified items. Only analyzed items change."""
    both = evidence.join(files.select(F.col("path").alias("storage_path"), F.col("sha256").alias("found")), "storage_path", "left")
    can = F.col("status") == "analyzed"
    same = F.col("found") == F.col("original_hash")
    out = both.withColumn("new_status", F.when(can & same, "verified").when(can, "flagged").otherwise(F.col("status")))
    entries = out.filter(can & same).select("evidence_id", F.lit("verify").alias("agent_id"), F.lit("verified").alias("action"), F.col("original_hash").alias("input_hash"), F.col("found").alias("output_hash"))
    return out, entries
