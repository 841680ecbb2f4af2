"""Text expressions: all are native column functions. Those that look into arrays (F.filter,
F.transform) are evaluated beside generated code; scores use none of these.

Regular expressions use Unicode classes by default ((?U), (?u)), as texts are multilingual.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casefile.functions.lexicon import Lexicon

SPACES = r"(?U)\s+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def phrases_found(lowered: Column, phrases: list[str]) -> Column:
    """STR1: which phrases occur in lower-cased text, each once, in the list's order."""
    return F.filter(strings([p.lower() for p in phrases]), lambda p: F.contains(lowered, p))


def patterns_found(lowered: Column, patterns: list[str]) -> Column:
    """STR2: which patterns occur."""
    return F.filter(strings(patterns), lambda p: F.regexp_like(lowered, p))


def tokens(text: Column | str, spaces: str = SPACES) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(col(text), F.lit("")), spaces), lambda w: w != "")


def word_count(text: Column | str) -> Column:
    """STR3: number of words."""
    return F.regexp_count(F.coalesce(col(text), F.lit("")), F.lit(r"(?U)\S+"))


def caps_count(text: Column | str) -> Column:
    """STR3: words of over 2 characters in capitals."""
    return F.size(F.filter(tokens(text), lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 2)))


def exclamations(text: Column | str) -> Column:
    """STR3: exclamation marks."""
    t = F.coalesce(col(text), F.lit(""))
    return F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))


def sentences(text: Column | str) -> Column:
    """STR4: pieces between . ! ?, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(col(text), F.lit("")), r"[.!?]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def match_spans(text: Column, pattern: str) -> Column:
    """STR5: matches of a pattern as structs of start, end (code points) and text, for texts of some
    hundred matches; ``entities.spans`` gives the same as rows, however many they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("size"), m.alias("text")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["text"].alias("text"))
        return F.struct((start + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(sizes, first, add, lambda acc: acc["out"])


def luhn(number: Column) -> Column:
    """STR6: card check digit; false unless there are digits only (dashes and spaces apart)."""
    clean = F.regexp_replace(number, r"[-\s]", "")
    digits = F.transform(F.split(F.reverse(clean), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    weighed = F.transform(F.filter(digits, lambda d: d.isNotNull()), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.regexp_like(clean, F.lit(r"^\d+$")) & (F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0)


def valid_ssn(number: Column) -> Column:
    """STR6: nine digits whose area is not 000, 666 or from 900."""
    clean = F.regexp_replace(number, r"[-\s]", "")
    area = F.substring(clean, 1, 3)
    return F.regexp_like(clean, F.lit(r"^\d{9}$")) & ~area.isin("000", "666") & (area < "900")


def urls(text: Column | str, pattern: str = r"(?i)https?://[^\s<>\"']+|www\.[^\s<>\"']+") -> Column:
    """STR7: links in order of their first occurrence, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", "")))


ADDRESS = r"[\w\.-]+@[\w\.-]+\.\w+"


def address(header: Column | str) -> Column:
    """STR8: the first address of a header, or the header itself."""
    found = F.regexp_extract(col(header), ADDRESS, 0)
    return F.when(found != "", found).otherwise(col(header))


def sender(header: Column | str) -> Column:
    """The address in angle brackets, else the first one: what a mail claims to come from."""
    bracketed = F.regexp_extract(col(header), r"<[^>]*?(" + ADDRESS + r")[^>]*>", 1)
    return F.when(bracketed != "", bracketed).otherwise(address(header))


def addresses(header: Column | str) -> Column:
    """STR8: addresses of a list."""
    return F.filter(F.transform(F.split(F.coalesce(col(header), F.lit("")), ","), lambda a: address(F.trim(a))), lambda a: a != "")


def domain(addr: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(addr), "@"), -1))


def html_to_text(html: Column | str) -> Column:
    """STR9: script and style dropped, four entities, tags to spaces, white space to one space."""
    t = col(html)
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
        t = F.regexp_replace(t, pattern, "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"\s+", " "))


def mail_text(subject: Column | str, body: Column | str) -> Column:
    """STR10: what is scored of a mail."""
    s, b = col(subject), col(body)
    return F.concat_ws("\n\n", F.when(F.coalesce(s, F.lit("")) != "", F.concat(F.lit("Subject: "), s)), F.nullif(b, F.lit("")))


def content_hash(content: Column | str, text: Column | str) -> Column:
    """STR13: SHA-256 of the bytes, else of the text, else of 'empty'."""
    return F.sha2(F.coalesce(col(content), F.nullif(col(text), F.lit("")).cast("binary"), F.lit("empty").cast("binary")), 256)


def mail_date(value: Column | str) -> Column:
    """STR14: an RFC 2822 date; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(col(value)), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def decimal_degrees(dms: Column | str, ref: Column | str) -> Column:
    """STR15: degrees, minutes, seconds and N/S/E/W as signed degrees, 6 places."""
    d = col(dms)
    value = F.get(d, F.lit(0)) + F.get(d, F.lit(1)) / F.lit(60.0) + F.get(d, F.lit(2)) / F.lit(3600.0)
    return F.round(F.when(F.upper(col(ref)).isin("S", "W"), -value).otherwise(value), 6)


def mean_hash(gray: Column | str, cells: int = 64) -> Column:
    """STR16: bits of the first cells over the mean of all, as hexadecimal digits.

    Cells and their mean are bound to names, each once: the work grows with the cells, not with powers of their number."""
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    mean = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g)
    bits = lambda g, m, i: F.aggregate(F.slice(g, i * 4 + 1, F.lit(4)), F.lit(0), lambda a, x: a * 2 + F.when(x > m, 1).otherwise(0))
    digit = lambda g, m, i: F.when(i * 4 < F.size(g), F.substring(F.lit("0123456789abcdef"), bits(g, m, i) + 1, F.lit(1)))
    digits = lambda g, m: F.transform(F.sequence(F.lit(0), F.lit(cells // 4 - 1)), lambda i: digit(g, m, i))
    return once(col(gray), lambda g: once(mean(g), lambda m: F.array_join(digits(g, m), "")))


def double_compressed(content: Column | str) -> Column:
    """STR17: a JPEG with more than two quantisation tables. Byte pairs are looked at whole."""
    joined = F.array_join(F.regexp_extract_all(F.hex(col(content)), F.lit(".."), F.lit(0)), " ")
    return F.startswith(F.hex(col(content)), F.lit("FFD8")) & (F.regexp_count(joined, F.lit("FF DB")) > 2)


def best_text(extracted: Column | str, raw: Column | str) -> Column:
    """FIL7: extracted text, else the bytes as UTF-8 if they are, else empty."""
    return F.coalesce(F.nullif(col(extracted), F.lit("")), F.try_validate_utf8(col(raw).cast("string")), F.lit(""))


def decoded(content: Column | str) -> Column:
    """SRC3: bytes as UTF-8; as UTF-16 if a byte-order mark says so; else as Latin-1."""
    b = col(content)
    mark = F.hex(F.substring(b, 1, 2)).isin("FFFE", "FEFF")
    return F.when(mark, F.decode(F.when(mark, b), "utf-16")).otherwise(F.coalesce(F.try_validate_utf8(F.when(~mark, b).cast("string")), F.decode(F.when(~mark, b), "iso-8859-1")))


def csv_shape(text: Column | str) -> tuple[Column, Column]:
    """SRC4: lines, and commas of the first line plus one."""
    lines = F.split(col(text), "\n")
    return F.size(lines), F.size(F.split(F.get(lines, F.lit(0)), ","))


def all_hits(text: Column, lexicon: Lexicon) -> Column:
    """The phrases behind every score, for reviewers."""
    low = F.lower(text)
    return F.struct(*[phrases_found(low, getattr(lexicon, k)).alias(k) for k in ("darvo", "gaslighting", "manipulation", "qualifiers", "distancing", "hedges", "certainty", "emotions")])
