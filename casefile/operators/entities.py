"""Mentions of entities and personal data in texts, their redaction, relations and clusters."""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.functions import text as t
from casefile.operators.components import components, kept

# They must be these for results to agree.
PATTERNS = {
    "PHONE": [r"\+?1?[-.\s]?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}", r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}"],
    "EMAIL": [r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"],
    "SSN": [r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"],
    "CREDIT_CARD": [r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9][0-9])[0-9]{12})\b"],
    "MONEY": [r"\$[\d,]+(?:\.\d{2})?", r"(?:USD|EUR|GBP|CAD)\s*[\d,]+(?:\.\d{2})?", r"[\d,]+(?:\.\d{2})?\s*(?:dollars?|euros?|pounds?)"],
    "CASE_NUMBER": [r"(?:Case|Docket|No\.?|#)\s*:?\s*\d{1,2}[-:]\d{2,4}[-:][A-Z]{2,3}[-:]?\d{1,6}", r"\d{1,2}:\d{2}-[a-z]{2}-\d{5}", r"[A-Z]{2,3}-\d{4,}-\d{4,}"],
    "LEGAL_CITATION": [r"\d+\s+U\.?S\.?C\.?\s+§?\s*\d+", r"\d+\s+C\.?F\.?R\.?\s+§?\s*\d+(?:\.\d+)?", r"[A-Z][a-z]+\s+v\.?\s+[A-Z][a-z]+,?\s*\d+\s+[A-Z]\.\s*\d+d?\s*\d*"],
    "DATE": [r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}", r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}"],
    "TIME": [r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?"],
    "IP_ADDRESS": [r"\b(?:\d{1,3}\.){3}\d{1,3}\b"],
    "URL": [r"https?://[^\s<>\"]+", r"www\.[^\s<>\"]+"],
}
PERSONAL = ["PHONE", "EMAIL", "SSN", "CREDIT_CARD"]
RELATIONS = [
    ("PERSON", ["called", "contacted", "emailed", "texted", "messaged"], "PERSON"),
    ("PERSON", ["paid", "transferred", "wired", "sent money to"], "PERSON"),
    ("PERSON", ["works for", "employed by", "works at"], "ORG"),
    ("PERSON", ["met with", "met", "visited"], "PERSON"),
    ("ORG", ["acquired", "purchased", "bought"], "ORG"),
    ("PERSON", ["lives at", "resides at", "located at"], "GPE"),
]
REDACTED = {"PII_PHONE": "[PHONE REDACTED]", "PII_EMAIL": "[EMAIL REDACTED]", "PII_SSN": "[SSN REDACTED]", "PII_CREDIT_CARD": "[CC REDACTED]", "PERSON": "[NAME REDACTED]"}
UNICODE = "(?iu)"


#: Marks before and after a match; a text's own ones are taken for another private sign while it is searched.
BEGIN, END, OTHER = "\ue000", "\ue001", "\ue002"


def _like(pattern: str):
    return lambda c, low: F.regexp_like(c, F.lit(pattern))


def _holds(words: list[str]):
    """Words in lower case. Other letters than their own stand for i, k and s if case is ignored, so these are given, too."""
    return lambda c, low: _any(F.contains(low, F.lit(w)) for w in words)


def _any(conditions) -> Column:
    out = None
    for x in conditions:
        out = x if out is None else out | x
    return out


def _likes(label: str, *patterns: str) -> dict:
    return dict(zip(PATTERNS[label], map(_like, patterns)))


#: What a text must hold for a pattern to occur in it, beside a digit for those of NUMBERS: parts that are found faster than the
#: pattern. Patterns that are not here are always searched for.
NEEDS = {
    **_likes("PHONE", *[r"[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", r"\([0-9]{3}\)", r"[0-9]{3}[-.\s][0-9]{3}[-.\s][0-9]{4}"]), **_likes("SSN", r"[0-9]{3}[-\s]?[0-9]{2}[-\s]?[0-9]{4}"), **_likes("CREDIT_CARD", "[0-9]{13}"),
    **_likes("CASE_NUMBER", "[0-9][-:][0-9]{2,4}[-:]", "[0-9]:[0-9]{2}-", "-[0-9]{4,}-[0-9]{4}"), **_likes("LEGAL_CITATION", r"[0-9]\s+[uU]", r"[0-9]\s+[cC]", r"\s[vV]\.?\s"), **_likes("DATE", "[0-9]/[0-9]", "[0-9]{4}-[0-9]{2}-", r"\s[0-9]{1,2},?\s+[0-9]{4}"),
    **_likes("TIME", "[0-9]:[0-9]{2}"), **_likes("IP_ADDRESS", r"[0-9]\.[0-9]"), **dict(zip(PATTERNS["EMAIL"] + PATTERNS["MONEY"] + PATTERNS["URL"], map(_holds, (["@"], ["$"], ["usd", "u\u017fd", "eur", "gbp", "cad"], ["dollar", "euro", "pound"], ["http"], ["www."])))),
}
NUMBERS = [p for label in ("PHONE", "SSN", "CREDIT_CARD", "CASE_NUMBER", "LEGAL_CITATION", "DATE", "TIME", "IP_ADDRESS") for p in PATTERNS[label]]


#: Patterns with the same matches that are found faster: a mail's local part begins where its run of letters does, or where the
#: match before it ends, so that other places of the run need no try.
FASTER = {PATTERNS["EMAIL"][0]: r"(?:(?<![a-zA-Z0-9._%+-])|\G)[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"}


def spans(docs: DataFrame, text: str, groups: dict[str, list[str]], flags: str = "") -> DataFrame:
    """doc_id, label, pattern (its number), nth, start, end and text of every match.

    A text that holds what a pattern needs is searched once: matches are put between marks, and the text is cut at them. A match
    begins after all gaps and matches before it, a running sum over the pieces of one text and pattern, so that the
    work stays in proportion to the text. Only lengths and matches are shuffled."""
    all_ = [(label, k, p) for label, patterns in groups.items() for k, p in enumerate(patterns)]
    c = F.col("_text")
    marks = F.contains(text, F.lit(BEGIN)) | F.contains(text, F.lit(END))
    own = docs.filter(F.col(text).isNotNull()).select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_own"), F.when(marks, F.translate(text, BEGIN + END, OTHER * 2)).otherwise(F.col(text)).alias("_text"))
    own = own.select("*", F.lower("_text").alias("_low"), F.regexp_like(c, F.lit("[0-9]")).alias("_digit"))

    def needed(i: int, p: str) -> Column:
        if p not in NEEDS or "U" in flags:  # (?U) takes other digits for digits, too
            return F.lit(i)
        need = NEEDS[p](c, F.col("_low"))
        return F.when(F.col("_digit") & need if p in NUMBERS else need, F.lit(i))

    todo = F.filter(F.array(*[needed(i, p) for i, (_, _, p) in enumerate(all_)]), lambda x: x.isNotNull())
    each = own.select("doc_id", "_row", "_own", "_text", todo.alias("_todo")).select("doc_id", "_row", "_own", "_text", F.explode("_todo").alias("_p"))
    marked = None
    for i, (_, _, p) in enumerate(all_):
        put = F.regexp_replace(c, flags + FASTER.get(p, p), f"{BEGIN}$0{END}")
        marked = F.when(F.col("_p") == i, put) if marked is None else marked.when(F.col("_p") == i, put)
    # A generator's output is not put into the filter above it, so that each text is searched once.
    found = each.select("doc_id", "_row", "_p", "_own", F.col("_own").eqNullSafe(c).alias("_same"), F.explode(F.array(marked)).alias("_m")).filter(F.contains("_m", F.lit(BEGIN)))
    pieces = found.select("doc_id", "_row", "_p", F.when(~F.col("_same"), F.col("_own")).alias("_own"), F.posexplode(F.split("_m", BEGIN)).alias("_nth", "_piece"))
    match = F.when(F.col("_nth") > 0, F.substring_index("_piece", END, 1))
    sized = pieces.select("doc_id", "_row", "_p", "_own", "_nth", match.alias("_match"), (F.length("_piece") - (F.col("_nth") > 0).cast("int")).alias("_size"))
    before = Window.partitionBy("_row", "_p").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("start", F.sum("_size").over(before).cast("int")).filter("_nth > 0").withColumn("_length", F.length("_match"))
    label, number = (F.get(F.array(*[F.lit(x[j]) for x in all_]), F.col("_p")) for j in (0, 1))
    taken = F.when(F.col("_own").isNull(), F.col("_match")).otherwise(F.substr("_own", F.col("start") + 1, F.col("_length")))
    return placed.select("doc_id", label.alias("label"), number.alias("pattern"), (F.col("_nth") - 1).alias("nth"), "start", (F.col("start") + F.col("_length")).alias("end"), taken.alias("text"))


def pattern_mentions(docs: DataFrame, text: str = "text", patterns: dict[str, list[str]] | None = None, flags: str = UNICODE) -> DataFrame:
    """STR5: mentions(doc_id, start, end, label, text, pattern, confidence, source)."""
    found = spans(docs, text, patterns or PATTERNS, flags)
    return found.select("doc_id", "start", "end", "label", "text", "pattern", F.lit(0.95).alias("confidence"), F.lit("pattern").alias("source"))


def personal_mentions(docs: DataFrame, text: str = "text", flags: str = UNICODE) -> DataFrame:
    """STR6: personal data, numbers checked; labels begin with PII_. Equal spans found by several
    patterns are one mention."""
    found = pattern_mentions(docs, text, {k: PATTERNS[k] for k in PERSONAL}, flags)
    good = F.when(F.col("label") == "SSN", t.valid_ssn(F.col("text"))).when(F.col("label") == "CREDIT_CARD", t.luhn(F.col("text"))).otherwise(True)
    named = found.filter(good).withColumns({"label": F.concat(F.lit("PII_"), "label"), "confidence": F.lit(0.9), "source": F.lit("pii_pattern")})
    return named.groupBy("doc_id", "start", "end", "label", "text").agg(F.min("pattern").alias("pattern"), F.first("confidence").alias("confidence"), F.first("source").alias("source"))


def deduplicated(mentions: DataFrame) -> DataFrame:
    """SET1: one mention for each text (lower case) and label of a document: the most confident,
    then the first by source, pattern and place."""
    w = Window.partitionBy("doc_id", F.lower("text"), "label").orderBy(F.desc("confidence"), "source", "pattern", "start", "end")
    return mentions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def merged_spans(mentions: DataFrame) -> DataFrame:
    """Overlapping mentions of a document as one span each; the label is that of the first."""
    w = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), "label")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = mentions.withColumn("_new", F.coalesce((F.col("start") >= reach).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("label", F.struct("start", -F.col("end"), "label")).alias("label")).drop("_g")


#: Code points of the pieces in which a text is cut up to be rewritten.
PIECE = 128


def _cut(pieces: Column, begin: Column, end: Column) -> Column:
    """The code points from begin to end of a text that is cut into pieces of PIECE each: looking a place up takes
    no more than a piece."""
    first, last = F.floor(begin / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    head = F.substr(F.get(pieces, first), begin % PIECE + 1, end - begin)
    between = F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), lambda k: F.get(pieces, k)), ""))
    tail = F.when(last > first, F.substr(F.get(pieces, last), F.lit(1), end % PIECE))
    return F.concat(*[F.coalesce(x, F.lit("")) for x in (head, between, tail)])


def _replaced(docs: DataFrame, mentions: DataFrame, text: str, by) -> DataFrame:
    """Gaps and replacements in order, joined once, so that the time is in proportion to the text and its mentions."""
    spans = merged_spans(mentions).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("_spans"))
    cut = docs.join(spans, "doc_id", "left").withColumn("_pieces", F.when(F.col("_spans").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    pieces = F.col("_pieces")

    def put(s: Column, i: Column) -> Column:
        gap = _cut(pieces, F.when(i > 0, F.get("_spans", i - 1)["end"]).otherwise(0), s["start"])
        return F.concat(gap, by(s["label"], _cut(pieces, s["start"], s["end"])))

    changed = F.concat(F.array_join(F.transform("_spans", put), ""), _cut(pieces, F.element_at("_spans", -1)["end"], F.length(text)))
    return cut.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(changed)).drop("_spans", "_pieces")


def redact(docs: DataFrame, mentions: DataFrame, text: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """STR11: every mention replaced by its label's sign; overlapping ones as one."""
    signs = F.create_map(*[F.lit(x) for kv in (names or REDACTED).items() for x in kv])
    return _replaced(docs, mentions, text, lambda label, _: F.coalesce(F.element_at(signs, label), F.lit("[REDACTED]")))


def masked(label: Column, original: Column) -> Column:
    """STR12: what is left to see of a mention."""
    tail = lambda sign: F.when(F.length(original) >= 4, F.concat(F.lit(sign), F.right(original, F.lit(4)))).otherwise("****")
    parts = F.split(original, "@")
    mail = F.when(F.size(parts) == 2, F.concat(F.lit("****@"), F.get(parts, F.lit(1)))).otherwise("****")
    return F.when(label == "PII_PHONE", tail("***-***-")).when(label == "PII_EMAIL", mail).when(label == "PII_SSN", tail("***-**-")).when(label == "PII_CREDIT_CARD", tail("****-****-****-")).otherwise(F.repeat(F.lit("*"), F.length(original)))


def mask(docs: DataFrame, mentions: DataFrame, text: str = "text") -> DataFrame:
    """STR12: mentions masked, but for last digits or the mail domain."""
    return _replaced(docs, mentions, text, masked)


def counts(mentions: DataFrame) -> DataFrame:
    """AGG10: mentions by document and label."""
    return mentions.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"))


def names(mentions: DataFrame, label: str, most: int = 20) -> DataFrame:
    """AGG10, WIN5: the first texts of a label in each document."""
    w = Window.partitionBy("doc_id").orderBy("start", "end", "pattern")
    top = mentions.filter(F.col("label") == label).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return top.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]).alias("names"))


def extraction_confidence(mentions: DataFrame) -> DataFrame:
    """AGG11; documents without mentions have 0.5, which the caller fills in."""
    return mentions.groupBy("doc_id").agg(F.least(F.lit(1.0), F.avg("confidence") + F.least(F.lit(0.2), F.count_distinct("label") * 0.02)).alias("confidence"))


def sentence_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentences with offsets: runs of other characters than . ! ? with the signs that end them."""
    found = spans(docs, text, {"": [r"[^.!?]+[.!?]*"]})
    return found.select("doc_id", F.col("nth").alias("sentence"), "start", "end", F.col("text").alias("sentence_text"))


def relations(docs: DataFrame, mentions: DataFrame, text: str = "text", rules: list | None = None) -> DataFrame:
    """JOIN5: pairs of mentions in one sentence whose labels and verb a rule names. Each mention gets
    the last sentence that begins before it, by a window over the places of a document; then mentions
    are paired by sentence. The pairs of a sentence are the result itself, so a text without full
    stops gives as many as the rules name."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(k, a, v, b) for k, (a, vs, b) in enumerate(rules or RELATIONS) for v in vs], "rule int, src_label string, verb string, tgt_label string")
    s = sentence_spans(docs, text).select("doc_id", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("sentence", "end", "sentence_text").alias("s"))
    m = mentions.select("doc_id", F.col("start").alias("at"), F.lit(1).alias("kind"), F.struct(F.col("start").alias("m_start"), F.col("end").alias("m_end"), "label", F.col("text").alias("m_text")).alias("m"))
    so_far = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    placed = s.unionByName(m, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(so_far))
    inside = placed.filter("kind = 1 and m.m_end <= s.end").select("doc_id", "s.sentence", "s.sentence_text", "m.*")
    a = inside.select("doc_id", "sentence", "sentence_text", F.struct("m_start", "m_end", "label", "m_text").alias("src"), F.col("label").alias("src_label"))
    b = inside.select("doc_id", "sentence", F.struct("m_start", "m_end", "label", "m_text").alias("tgt"), F.col("label").alias("tgt_label"))
    ruled = a.join(F.broadcast(table), "src_label").filter(F.contains(F.lower("sentence_text"), F.col("verb")))
    pairs = ruled.join(b, ["doc_id", "sentence", "tgt_label"]).filter("src <> tgt")
    return pairs.select("doc_id", "rule", "verb", F.col("src.m_text").alias("source"), F.col("src.m_start").alias("source_start"), F.col("tgt.m_text").alias("target"), F.col("tgt.m_start").alias("target_start"), F.lit(0.7).alias("confidence"), F.substring("sentence_text", 1, 200).alias("context"))


_PLACED = "doc_id long, start int, end int, label string, text string, cluster long"


def _clustered(batches):
    """Mentions, which come by document and in order, with the number of their cluster. Held are one document's words."""
    doc, first, count = None, {}, 0
    for batch in batches:
        out = []
        for doc_id, start, end, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "end", "label", "text"))):
            if doc_id != doc:
                doc, first, count = doc_id, {}, 0
            low = (text or "").lower()
            keys = {(label, low)} | ({(label, w, "word") for w in low.split()} if label == "PERSON" else set())
            at = min((first[k] for k in keys if k in first), default=count)
            count += at == count
            for k in keys:
                first[k] = min(first.get(k, at), at)
            out.append(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, "cluster"])


def clusters(mentions: DataFrame) -> DataFrame:
    """SCR27: mentions of a document that likely mean the same: equal texts of a label; persons who share a word. A mention
    joins the first cluster that it matches, in the mentions' order, so documents are read in order, row by row."""
    rows = mentions.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "text")
    placed = rows.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "label", "text").mapInArrow(_clustered, _PLACED)
    found = placed.groupBy("doc_id", "cluster").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text"))).alias("m")).filter(F.size("m") > 1)
    return found.select("doc_id", F.get("m", F.lit(0))["text"].alias("canonical"), F.get("m", F.lit(0))["label"].alias("label"), F.transform("m", lambda x: x["text"]).alias("mentions"), F.size("m").cast("long").alias("n"))


#: A word's names are dealt out so many ways, so that a word which most persons share is not one task's.
WAYS = 64


def linked_names(mentions: DataFrame) -> DataFrame:
    """SCR27 across documents: label, name (a mention's text in lower case) and cluster, the smallest name that
    it is linked to. Persons are linked if they share a word, in any documents, and by others between them; other labels by equal names only.

    A name is linked to the smallest of its way among the names with a word, and these to the smallest of the word's: as many links
    as words, never a pair of all that share one."""
    names = mentions.select("label", F.lower("text").alias("name")).filter("name is not null and label is not null").distinct()
    persons = names.filter("label = 'PERSON'")
    words = persons.select("name", F.explode(F.array_distinct(F.filter(F.split("name", t.SPACES), lambda w: w != ""))).alias("word"))
    words = words.withColumn("way", F.pmod(F.xxhash64("name"), F.lit(WAYS)))
    ways = words.groupBy("word", "way").agg(F.min("name").alias("low"))
    links = words.join(ways, ["word", "way"]).select(F.col("name").alias("a"), F.col("low").alias("b"))
    over = ways.join(ways.groupBy("word").agg(F.min("low").alias("least")), "word").select(F.col("low").alias("a"), F.col("least").alias("b"))
    found = components(links.union(over)).select(F.lit("PERSON").alias("label"), F.col("node").alias("name"), "component")
    return names.join(found, ["label", "name"], "left").select("label", "name", F.coalesce("component", "name").alias("cluster"))


def linked_mentions(mentions: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Mentions, each with the cluster of its name."""
    names = linked_names(mentions) if names is None else names
    return mentions.withColumn("_name", F.lower("text")).join(names.withColumnRenamed("name", "_name"), ["label", "_name"]).drop("_name")


def linked_clusters(mentions: DataFrame) -> DataFrame:
    """SCR27 across documents: label, cluster, canonical (the first mention's text), n mentions, n_docs, n_names, of
    clusters with several mentions."""
    mentions = kept(mentions.select("doc_id", "start", "end", "label", "text"))
    found = kept(linked_names(mentions))
    one = linked_mentions(mentions, found).groupBy("label", "cluster", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "end", "text")).alias("first"))
    names = found.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n_names"))
    whole = one.groupBy("label", "cluster").agg(F.min("first")["text"].alias("canonical"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs")).filter("n > 1")
    return whole.join(names, ["label", "cluster"])
