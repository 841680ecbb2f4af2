"""Sources: evidence files, mails."""

from __future__ import annotations

import email
import email.policy
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.functions import ingest, mail
from casefile.sources import packed

MAX_ATTACHMENT = 50 * 1024 * 1024
MAILS = (
    "path string, message_id string, `from` string, `to` string, cc string, bcc string, subject string, date_text string, in_reply_to string, references string, reply_to string, received_spf string, authentication_results string, "
    "received_chain array<string>, body_text string, body_html string, attachments array<struct<filename:string,content_type:string,size_bytes:bigint,sha256:string>>, error string"
)


#: Larger files are hashed in pieces; smaller ones are read whole, by any of Spark's readers.
WHOLE, PIECE = 256 << 20, 4 << 20


def _hashed(batches):
    schema = pa.schema([("path", pa.string()), ("sha256", pa.string())])
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            fs, at = packed.store(path)
            hash_ = hashlib.sha256()
            with fs.open_input_stream(at) as f:
                while data := f.read(PIECE):
                    hash_.update(data)
            out.append(hash_.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(out, pa.string())], schema=schema)


def scan_files(spark: SparkSession, path: str, pattern: str | None = None, keep_content: bool = False, whole: int = WHOLE) -> DataFrame:
    """SRC1: path, size_bytes, modified, sha256 and evidence type of every file below ``path``; a file may be of any size. Files of over
    ``whole`` bytes are streamed by pyarrow's file systems, one a task at a time, and have no ``content`` (null)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    small = files.filter(F.col("length") <= whole).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"), "content")
    large = files.filter(F.col("length") > whole).select("path", "length", "modificationTime")
    hashed = large.select("path").repartition("path").mapInArrow(_hashed, "path string, sha256 string")
    both = small.unionByName(large.join(hashed, "path").withColumn("content", F.lit(None).cast("binary")))
    out = both.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "sha256", ingest.type_of_extension("path").alias("evidence_type"), "content")
    return out if keep_content else out.drop("content")


def _text(message: email.message.EmailMessage, kind: str) -> str:
    part = message.get_body((kind,))
    if part is None:
        return ""
    try:
        return part.get_content()
    except (LookupError, UnicodeError):
        return (part.get_payload(decode=True) or b"").decode("latin-1")


def parsed_mail(path: str, data: bytes | None, most: int = MAX_ATTACHMENT) -> dict:
    """One message as a row; whatever cannot be read leaves an error and the row goes on."""
    row: dict = {"path": path, "received_chain": [], "attachments": [], "body_text": "", "body_html": "", "error": None}
    try:
        m = email.message_from_bytes(data or b"", policy=email.policy.default)
        get = lambda name: None if m.get(name) is None else str(m.get(name))
        for field, name in (("message_id", "Message-ID"), ("from", "From"), ("to", "To"), ("cc", "Cc"), ("bcc", "Bcc"), ("subject", "Subject"), ("date_text", "Date"), ("in_reply_to", "In-Reply-To"), ("references", "References"), ("reply_to", "Reply-To"), ("received_spf", "Received-SPF"), ("authentication_results", "Authentication-Results")):
            row[field] = get(name)
        row["received_chain"] = [str(r) for r in m.get_all("Received", [])]
        row["body_text"], row["body_html"] = _text(m, "plain"), _text(m, "html")
        for part in m.walk():
            if part.get_content_disposition() in ("attachment", "inline") and (name := part.get_filename()) and (body := part.get_payload(decode=True)):
                digest = hashlib.sha256(body).hexdigest() if len(body) <= most else "size_exceeded"
                row["attachments"].append({"filename": name, "content_type": part.get_content_type(), "size_bytes": len(body), "sha256": digest})
    except Exception as e:  # noqa: BLE001 - one damaged message must not fail a job over millions
        row["error"] = f"{type(e).__name__}: {e}"
    return row


def parse_mails(files: DataFrame) -> DataFrame:
    """SRC2: messages (path, content) as rows of headers, bodies and hashed attachments."""
    names = [x.strip().split(" ")[0].strip("`") for x in MAILS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parsed_mail(p, c) for p, c in zip(pdf["path"], pdf["content"])], columns=names)

    return files.select("path", "content").mapInPandas(run, MAILS)


def read_mails(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """SRC2 over a folder."""
    return parse_mails(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def read_messages(spark: SparkSession, path: str, pattern: str = "*.eml", most: int = MAX_ATTACHMENT) -> DataFrame:
    """SRC2 over a folder, by column expressions only."""
    return mail.parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path), most)
