"""Transcripts, frames, OCR words and pixels, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casefile.operators.overlap import most_overlapping

#: The finest cells of time are 2^FINEST seconds long.
FINEST = -6


def _level(d: DataFrame) -> DataFrame:
    """_level: the smallest power of two of seconds that holds an interval."""
    size = F.abs(F.col("end") - F.col("start"))
    return d.withColumn("_level", F.when(size <= 2.0**FINEST, F.lit(FINEST)).otherwise(F.ceil(F.log2(size)).cast("int")))


def _cells(d: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each cell, two at most, that an interval meets at its own level and at each coarser one of ``levels``."""
    all_ = F.array_distinct(F.concat(F.array("_level"), F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col("_level"))))
    length = F.pow(F.lit(2.0), F.col("_at"))
    low, high = (F.floor(f("start", "end") / length) for f in (F.least, F.greatest))
    return d.withColumn("_at", F.explode(all_)).withColumn("_cell", F.explode(F.sequence(low, high)))


def overlapping(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Pairs of intervals (start, end) of one ``by`` that overlap: left's columns, and right's with ``r_`` before their names.

    An interval is held by one or two cells of its own length; two intervals meet in a cell of the longer one's level. So an
    interval is copied to two cells for each coarser level of the other side, whatever its length, and a long recording is
    many keys. A pair that meets in two cells comes once: in the cell of the later of both begins, or the first of both."""
    a, b = _level(left), _level(right)
    levels = [[r[0] for r in d.select("_level").distinct().collect()] for d in (a, b)]  # powers of two of seconds: at most some tens
    names = [c for c in right.columns if c != by]
    x = _cells(a, levels[1]).withColumnRenamed("_level", "_l")
    y = _cells(b, levels[0]).select(by, "_at", "_cell", F.col("_level").alias("_r"), *[F.col(c).alias(f"r_{c}") for c in names])
    met = x.join(y, [by, "_at", "_cell"]).filter("_at = greatest(_l, _r) and r_start < end and r_end > start")
    once = F.floor(F.greatest(F.least("start", "end"), F.least("r_start", "r_end")) / F.pow(F.lit(2.0), F.col("_at")))
    return met.filter(F.col("_cell") == once).select(*left.columns, *[f"r_{c}" for c in names])


def speakers(segments: DataFrame, turns: DataFrame, bucket: float | None = None) -> DataFrame:
    """JOIN4: each segment (audio_id, idx, start, end) gets the speaker of the turn that overlaps it
    most, the first at ties, else UNKNOWN. ``bucket`` is of no effect: stretches follow from the rows. Pairs of segments and turns
    that overlap are never made, since a busy recording has as many as the square of its rows."""
    best = most_overlapping(segments, turns, "audio_id", "idx", "speaker").withColumnRenamed("r_what", "speaker")
    return segments.join(best, ["audio_id", "idx"], "left").withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))


def transcripts(segments: DataFrame, lang_prob: str = "lang_prob") -> DataFrame:
    """AGG12: over segments with text, speaker (null without diarization), compression_ratio."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    x = segments.groupBy("audio_id").agg(F.max_by("end", "idx").alias("duration"), F.sum(words).alias("words"), F.count(F.lit(1)).alias("segments"), F.greatest(F.count_distinct("speaker"), F.lit(1)).alias("speakers"), F.avg("compression_ratio").alias("c"), F.max(lang_prob).alias("p"))
    return x.select("audio_id", "duration", "words", "segments", "speakers", transcript_confidence(F.col("p"), F.col("c")).alias("confidence"))


def transcript_confidence(lang_prob: Column, compression: Column) -> Column:
    """0.5 for the second part where there are no segments."""
    return lang_prob * 0.4 + F.coalesce(F.least(F.lit(1.0), 2.0 / F.greatest(compression, F.lit(0.5))), F.lit(0.5)) * 0.6


def frame_difference(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d) / F.size(a)


def scene_changes(frames: DataFrame, threshold: float = 30.0, by: str = "video_id", order: str = "frame_number", pixels: str = "pixels") -> DataFrame:
    """WIN8: frames whose pixels differ from the frame before by more than the threshold on average."""
    before = F.lag(pixels).over(Window.partitionBy(by).orderBy(order))
    return frames.withColumn("diff", frame_difference(F.col(pixels), before)).filter(F.col("diff") > threshold)


def sampled_frames(frames: DataFrame, every_s: float = 1.0, most: int = 100) -> DataFrame:
    """WIN9: every k-th frame of a video, 100 at most, with mean and deviation of brightness."""
    k = F.greatest(F.lit(1), F.floor(F.col("fps") * every_s).cast("int"))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number"))
    x = frames.filter(F.col("frame_number") % k == 0).withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v) / F.size("pixels")
    x = x.withColumn("_m", mean)
    var = F.aggregate("pixels", F.lit(0.0), lambda a, v: a + (v - F.col("_m")) * (v - F.col("_m"))) / F.size("pixels")
    return x.withColumns({"brightness": F.round("_m", 2), "brightness_std": F.round(F.sqrt(var), 2)}).drop("_m")


def ocr_text(words: DataFrame) -> DataFrame:
    """AGG13: words (doc_id, engine, idx, word, conf) joined by engine; those of no confidence or
    no text left out; mean confidence as a share."""
    good = words.filter((F.col("conf") > 0) & (F.trim("word") != ""))
    return good.groupBy("doc_id", "engine").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"])).alias("text"), (F.avg("conf") / 100).alias("confidence"), F.count(F.lit(1)).alias("word_count"))


def fused_ocr(by_engine: DataFrame, lead: float = 0.15) -> DataFrame:
    """WIN12: the most confident engine's text; if the second is close and has more words, its text
    with the mean confidence."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("confidence"), "engine")
    x = by_engine.withColumns({"n": F.row_number().over(w), "t2": F.lead("text").over(w), "c2": F.lead("confidence").over(w), "w2": F.lead("word_count").over(w)}).filter("n = 1")
    second = F.coalesce((F.col("confidence") - F.col("c2") <= lead) & (F.col("w2") > F.col("word_count")), F.lit(False))
    return x.select("doc_id", F.when(second, F.col("t2")).otherwise(F.col("text")).alias("text"), F.when(second, (F.col("confidence") + F.col("c2")) / 2).otherwise(F.col("confidence")).alias("confidence"))


def dominant_colors(pixels: DataFrame, k: int = 5, step: int = 32) -> DataFrame:
    """AGG17: of pixels (image_id, r, g, b) the k most frequent quantised colours, in percent."""
    q = lambda c: (F.floor(F.col(c) / step) * step).cast("int").alias(c)
    n = pixels.groupBy("image_id", q("r"), q("g"), q("b")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("image_id")
    x = n.withColumns({"rank": F.row_number().over(w.orderBy(F.desc("n"), "r", "g", "b")), "total": F.sum("n").over(w)}).filter(F.col("rank") <= k)
    return x.select("image_id", "rank", "r", "g", "b", F.round(F.col("n") / F.col("total") * 100, 1).alias("percentage"))


def color_stats(pixels: DataFrame) -> DataFrame:
    """AGG17: mean colour, and the mean deviation of channels."""
    return pixels.groupBy("image_id").agg(*[F.round(F.avg(c), 1).alias(f"mean_{c}") for c in "rgb"], F.round((F.stddev_pop("r") + F.stddev_pop("g") + F.stddev_pop("b")) / 3, 2).alias("color_variance"))


def noise_inconsistency(blocks: DataFrame) -> DataFrame:
    """AGG18: deviation over mean of the blocks' variances (0 if the mean is)."""
    mean = F.avg("variance")
    return blocks.groupBy("image_id").agg(F.coalesce(F.stddev_pop("variance") / F.nullif(mean, F.lit(0.0)), F.lit(0.0)).alias("noise"))
