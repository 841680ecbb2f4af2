"""The pipeline's stages, each against what its operator is to do, on a small table."""

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from casefile.llm import queries


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lib = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = spark.createDataFrame(stage(spark, now, "/root/testdata/sf0.001").toPandas(), None if name == "pieces" else docs.schema)
        if name != "pieces":
            assert now.columns == docs.columns
        seen[name] = now.toPandas()
    assert len(seen["language"]) >= 0.95 * docs.count()
    assert seen["near_dedup"]["text"].is_unique and set(seen["near_dedup"]["doc_id"]) <= set(seen["language"]["doc_id"])
    texts = seen["repeats"]["text"].tolist()
    windows = [tuple(t.split(" ")[i : i + 35]) for t in texts for i in range(0, len(t.split(" ")) - 34, 35)]
    assert len(windows) == len(set(windows)) and all(texts)
    assert set(seen["mixture"]["doc_id"]) <= set(seen["repeats"]["doc_id"])
    for text, ids, back in seen["pieces"][["text", "ids", "decoded"]].itertuples(index=False):
        assert list(ids) == lib.encode(text) + [2] and back == text
    assert now.filter(F.col("ids").isNull()).count() == 0


def test_odd_rows_through_all_stages(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"palabra{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    prose = "the quick brown fox jumps over the lazy dog and runs into the old forest where nobody lives any more "
    rows = [(1, prose, "en", "a"), (1, prose, "en", "a"), (None, prose + "but not tonight", "en", None), (2, None, "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \n\t", "en", "b"), (None, None, None, None)]
    rows += [(5, " ".join(words), "es", "b"), (6, " ".join(words[:150] + ["otra"] * 40 + words[150:]), "es", "b"), (5, "casa perro gato " * 3, "es", None), (7, "x" * 50_000, "en", "a"), (8, (prose + "and ") * 300, "en", "a")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            got = stage(spark, table, "")
            out = got.collect()
            assert name == "pieces" or got.columns == docs.columns
            assert table is docs or not out
            if table is docs:
                kept = out
        texts = [r["text"] for r in kept]
        if name == "near_dedup":
            assert sum(not (t or "").strip() for t in texts) == 1 and len([t for t in texts if t == prose]) == 1 and len(kept) == 6  # two pairs are at 15 of 18 and 292 of 301 shingles
        if name == "repeats":
            assert sum(not (t or "").strip() for t in texts) == 5 and all(not set(words) & set(t.split()) for t in texts if t)
        if name == "mixture":
            assert all(t.strip() for t in texts) and {r["source"] for r in kept} == {"a", "b", None}
        if name == "pieces":
            assert len(kept) == len(rows) and all(r["decoded"] == (r["text"] or "") for r in kept)
