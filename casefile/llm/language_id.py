"""Language identification by compression: the language whose dictionary compresses a text best.

Each language has a zstandard raw-content dictionary and a short context, both of slices of a
bounded, hashed sample of its labelled texts. A whole text, reduced to lower-case words without
ASCII digits and signs, is compressed in blocks with every dictionary; a short one after the
context, whose own size is taken off, so that single bytes still tell. The smallest total wins; a
narrow margin over the second is a rejection.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casefile.llm.common import lean, pieces

#: The sample's bounds: slices for each language, and characters of a slice; languages.
SLICES, SLICE = 160, 250
LANGUAGES = 500
CONTEXT = 8
LEVEL, BLOCK, SHORT = 5, 4096, 500
#: A smaller margin (1 - best / second) is a rejection.
MARGIN = 0.01
LETTER = regex.compile(r"\p{L}")
SPACES = bytes.maketrans(b"\t\n\v\f\r", b"     ")
SIGNS = bytes(c for c in range(128) if not (97 <= c <= 122 or 9 <= c <= 13 or c == 32))
UNKNOWN = "und"


def reduced(text: str) -> bytes:
    return text.lower().encode().translate(SPACES, delete=SIGNS)


@dataclass
class Model:
    """Of each language in the order of preference at ties: its dictionary and context."""

    languages: list[tuple[str, bytes, bytes]]

    def coders(self) -> list[tuple[str, zstandard.ZstdCompressor, bytes, int]]:
        out = []
        for lang, words, context in self.languages:
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            c = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            out.append((lang, c, context, len(c.compress(context))))
        return out


def predict(text: str | None, coders: list) -> tuple[str, float]:
    """Language and margin (0 to 1) of a whole text."""
    if not text or not coders or not LETTER.search(text):
        return UNKNOWN, 0.0
    data = reduced(text)
    if len(data) < SHORT:
        sizes = [max(0, len(c.compress(context + data)) - alone) for _, c, context, alone in coders]
    else:
        sizes = [sum(len(c.compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK)) for _, c, _, _ in coders]
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    if len(order) == 1:
        return coders[0][0], 1.0
    best, second = sizes[order[0]], sizes[order[1]]
    return coders[order[0]][0], 1 - best / second if second else 0.0


def fit(labelled: DataFrame) -> Model:
    """Learn from rows with text and lang (null in either: left out).

    At most SLICES slices of SLICE characters for each of the LANGUAGES most frequent languages reach
    the driver (ties: the first by name): a language's texts fall into that many hash bins, and the text with the smallest hash of each bin gives a slice. At a
    tie in size the language with more rows is preferred.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select("lang")
    usable = usable.join(F.broadcast(common), "lang")
    begin = 1 + F.pmod(F.shiftright("h", 16), F.greatest(F.length("text") - SLICE, F.lit(1)))
    cut = F.substring("text", begin.cast("int"), F.lit(SLICE))
    bins = usable.groupBy("lang", F.pmod("h", F.lit(SLICES)).alias("bin")).agg(F.min(F.struct("h", cut.alias("cut"))).alias("s"), F.count(F.lit(1)).alias("n"))
    found: dict[str, list] = {}
    for r in bins.select("lang", "bin", "s.cut", "n").collect():
        found.setdefault(r["lang"], []).append((r["bin"], r["cut"], r["n"]))
    languages = []
    for lang in sorted(found, key=lambda x: (-sum(n for *_, n in found[x]), x)):
        slices = [reduced(c) for _, c, _ in sorted(found[lang])]
        languages.append((lang, b" ".join(slices[CONTEXT:]) or b" ".join(slices), b" ".join(slices[:CONTEXT]) + b" "))
    return Model([(a, b.ljust(16), c) for a, b, c in languages])


def held_out(column: str = "doc_id", folds: int = 5):
    """crc32 of the number as text is divisible by ``folds``; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string")) % folds == 0, F.lit(False))


def identify_language(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced).

    The prediction uses the whole text and nothing else. score is the margin: how much smaller, as a
    share, the best language's size is than the second's. Null texts and texts without a letter get
    ``und``, score 0 and are rejected; without any learned language all do.
    """
    df = docs.drop("lang_pred", "score", "rejected")
    fields = df.schema.names
    schema = T.StructType(list(df.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    text = fields.index("text")

    def run(batches):
        coders = model.coders()
        for batch in batches:
            for part in pieces(batch, "text"):
                got = [predict(t.as_py(), coders) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64()), pa.array([x == UNKNOWN or s < margin for x, s in got])], names=[*fields, "lang_pred", "score", "rejected"])

    return df.mapInArrow(lean(run), schema)
