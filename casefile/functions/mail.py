"""Messages as column expressions: headers, parts, transfer encodings and character sets.

Bytes are looked at as Latin-1 text, in which every byte is a character of its own, so that Spark's string functions cut them
without loss; what is cut out becomes bytes again and then text of its own character set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casefile.functions import text as t

LATIN = "ISO-8859-1"
#: Multiparts inside multiparts are opened so many times.
NESTED = 3
_WORD = r"=\?[^?\s]+\?[bBqQ]\?[^?]*\?="
HEADERS = {"message_id": "Message-ID", "from": "From", "to": "To", "cc": "Cc", "bcc": "Bcc", "subject": "Subject", "date_text": "Date", "in_reply_to": "In-Reply-To", "references": "References", "reply_to": "Reply-To", "received_spf": "Received-SPF", "authentication_results": "Authentication-Results"}


def as_bytes(latin: Column) -> Column:
    return F.encode(latin, LATIN)


def in_charset(data: Column, charset: Column) -> Column:
    """Bytes as text of a named character set; as UTF-8 if they are, else as Latin-1, where it has no or another name."""
    name = F.lower(charset)
    wide = name.isin("utf-16", "utf-16be", "utf-16le")
    return F.when(name.isin("iso-8859-1", "latin-1", "latin1"), F.decode(data, LATIN)).when(wide, F.decode(F.when(wide, data), "UTF-16")).otherwise(t.decoded(data))


def unquoted(latin: Column, spaces: bool = False) -> Column:
    """The bytes (as Latin-1 text) of quoted-printable text; with ``spaces`` that of header words, in which _ is a blank."""
    joined = F.regexp_replace(F.replace(latin, F.lit("_"), F.lit(" ")) if spaces else latin, r"=[ \t]*\n", "")
    pieces = F.split(joined, "=")
    digit = lambda p: F.regexp_like(p, F.lit(r"^[0-9A-Fa-f]{2}"))
    one = lambda p: F.when(digit(p), F.concat(F.decode(F.unhex(F.substring(p, 1, 2)), LATIN), F.substr(p, F.lit(3)))).otherwise(F.concat(F.lit("="), p))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))


def words(latin: Column) -> Column:
    """A header's text, its encoded words decoded; blanks between two of these are no text."""
    close = F.regexp_replace(latin, r"(\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)", "$1")
    tokens = F.regexp_extract_all(close, F.lit(f"(?s){_WORD}|(?:(?!{_WORD}).)+"), F.lit(0))

    def one(x: Column) -> Column:
        charset, way, body = (F.regexp_extract(x, r"(?s)^=\?([^?\s*]+)[^?]*\?([bBqQ])\?([^?]*)\?=$", k) for k in (1, 2, 3))
        data = F.when(F.lower(way) == "b", F.try_to_binary(body, F.lit("base64"))).otherwise(as_bytes(unquoted(body, True)))
        return F.when(charset == "", t.decoded(as_bytes(x))).otherwise(F.coalesce(in_charset(data, charset), x))

    return F.array_join(F.transform(tokens, one), "")


def header(head: Column, name: str) -> Column:
    """The first header of a name in unfolded lines; null if there is none."""
    pattern = rf"(?im)^{name}:[ \t]*(.*)$"
    return F.when(F.regexp_like(head, F.lit(pattern)), words(F.regexp_extract(head, pattern, 1)))


def split_message(latin: Column) -> Column:
    """head (unfolded) and body of a message or part."""
    whole = F.concat(F.lit("\n"), latin)
    head = F.substring_index(whole, "\n\n", 1)
    return F.struct(F.regexp_replace(head, r"\n[ \t]+", " ").alias("head"), F.substr(whole, F.length(head) + 3).alias("body"))


def parameter(head: Column, field: str, name: str) -> Column:
    """A parameter of a header, as of Content-Type: charset."""
    found = F.regexp_extract(head, rf'(?im)^{field}:.*?;[ \t]*{name}="([^"]*)"', 1)
    return F.when(found != "", found).otherwise(F.regexp_extract(head, rf'(?im)^{field}:.*?;[ \t]*{name}=([^";\s]+)', 1))


def content_type(head: Column) -> Column:
    found = F.lower(F.regexp_extract(head, r"(?im)^Content-Type:[ \t]*([^;\s]+)", 1))
    return F.when(found == "", "text/plain").otherwise(found)


def opened(part: Column) -> Column:
    """A part as the array of its own parts, or of itself."""
    boundary = parameter(part["head"], "Content-Type", "boundary")
    inner = F.get(F.split(F.concat(F.lit("\n"), part["body"]), F.concat(F.lit(r"\n--\Q"), boundary, F.lit(r"\E--"))), F.lit(0))
    pieces = F.split(inner, F.concat(F.lit(r"\n--\Q"), boundary, F.lit(r"\E[ \t]*(?=\n|$)")))
    own = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: split_message(F.regexp_replace(p, r"^\n", "")))
    return F.when(F.startswith(content_type(part["head"]), F.lit("multipart/")) & (boundary != ""), own).otherwise(F.array(part))


def leaf(part: Column) -> Column:
    """type, charset, disposition, filename and data (bytes) of a part."""
    head, body = part["head"], part["body"]
    way = F.lower(F.regexp_extract(head, r"(?im)^Content-Transfer-Encoding:[ \t]*(\S+)", 1))
    data = F.when(way == "base64", F.coalesce(F.try_to_binary(F.regexp_replace(body, r"\s", ""), F.lit("base64")), as_bytes(body))).when(way == "quoted-printable", as_bytes(unquoted(body))).otherwise(as_bytes(body))
    name = parameter(head, "Content-Disposition", "filename")
    name = F.when(name != "", name).otherwise(parameter(head, "Content-Type", "name"))
    return F.struct(
        content_type(head).alias("type"), parameter(head, "Content-Type", "charset").alias("charset"), F.lower(F.regexp_extract(head, r"(?im)^Content-Disposition:[ \t]*([^;\s]+)", 1)).alias("disposition"),
        words(name).alias("filename"), data.alias("data"),
    )


def parsed(messages: DataFrame, most: int, path: str = "path", content: str = "content") -> DataFrame:
    """SRC2: a row for each message (path, content): headers, the first plain and HTML texts, and attachments with their hashes
    (``size_exceeded`` beyond ``most`` bytes). What no message is has empty headers; nothing fails."""
    latin = F.regexp_replace(F.decode(F.coalesce(F.col(content), F.lit(b"")), LATIN), r"\r\n?", "\n")
    x = messages.select(F.col(path).alias("path"), split_message(latin).alias("m"))
    parts = F.array("m")
    for _ in range(NESTED):
        parts = F.flatten(F.transform(parts, opened))
    x = x.withColumn("leaves", F.transform(parts, leaf))
    attached = F.filter("leaves", lambda p: p["disposition"].isin("attachment", "inline") & (p["filename"] != ""))
    whole: Callable[[str], Column] = lambda kind: F.get(F.filter("leaves", lambda p: (p["type"] == kind) & (p["disposition"] != "attachment")), F.lit(0))
    text = lambda kind: F.coalesce(in_charset(whole(kind)["data"], whole(kind)["charset"]), F.lit(""))
    hash_ = lambda p: F.when(F.octet_length(p["data"]) <= most, F.sha2(p["data"], 256)).otherwise("size_exceeded")
    shown = F.transform(attached, lambda p: F.struct(p["filename"].alias("filename"), p["type"].alias("content_type"), F.octet_length(p["data"]).cast("long").alias("size_bytes"), hash_(p).alias("sha256")))
    received = F.transform(F.regexp_extract_all("m.head", F.lit(r"(?im)^Received:[ \t]*(.*)$"), F.lit(1)), lambda r: t.decoded(as_bytes(r)))
    return x.select("path", *[header(F.col("m.head"), name).alias(c) for c, name in HEADERS.items()], received.alias("received_chain"), text("text/plain").alias("body_text"), text("text/html").alias("body_html"), shown.alias("attachments"))
