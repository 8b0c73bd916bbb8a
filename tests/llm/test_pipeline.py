"""The pipeline against a plain version of each stage."""

import hashlib
import random
import re

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, mixing, quality
from cairn.llm.queries import quality_model, tokenizer
from tests.llm.test_near import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, tmp_path):
    rng = random.Random(8)
    words = ["tree", "river", "house", "the", "of", "and", "stone", "paper", "light"] + [f"w{i}" for i in range(60)]
    texts = []
    for i in range(160):
        t = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        texts.append(" ".join(w + "%%%" for w in t) if i % 4 == 0 else " ".join(t))
    texts += [texts[1], texts[2].replace(" ", "  "), texts[5] + " tail", texts[6] + " end", None, ""]
    docs = [(i, t, "en", "ab"[i % 3 == 0] if i % 11 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i % 4 != 0), int(i % 9 == 1)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return docs


def test_stages(spark, tmp_path):
    docs = make(spark, tmp_path)
    sf = str(tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "source mixing", "BPE encoding"]
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_model(table, spark.read.parquet(f"{sf}/labels.parquet"))
    (w, cuts), known = model, quality.Tokens()

    def good(text):
        ids, values = quality.features(text, known)
        return float((w[ids] * values).sum(dtype="float64")) >= cuts[0]

    left = [(i, t) for i, t, *_ in docs if good(t)]
    assert sum(i % 4 == 0 for i, _ in left if i < 160) <= 2 and sum(i % 4 != 0 for i, _ in left if i < 160) >= 118
    first = {}
    for i, t in left:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    left = [(i, t) for i, t in left if i in first.values()]
    near = brute(left)
    left = [(i, t) for i, t in left if near[i][1] == i]

    library = tiktoken.Encoding("own", pat_str=tokenizer()[1], mergeable_ranks=bpe.read_ranks(tokenizer()[0]), special_tokens={})
    want = {}
    for i, t in left:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want

    mixed = corpus_pipeline.mix(spark, table, sf)
    assert mixed.columns == table.columns and mixed.count() == len(docs)
    order = [r.source for r in mixed.filter(F.col("source").isNotNull()).collect()]
    assert sorted(order) != order


def test_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_reaches_the_result(spark, tmp_path, monkeypatch):
    make(spark, tmp_path)
    same = lambda s, docs, d: docs
    stages = [("none", same), ("source mixing", corpus_pipeline.mix), ("BPE encoding", corpus_pipeline.encode)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").repartition(3)
    docs.write.parquet(str(tmp_path / "many" / "documents.parquet"))
    want = {r.doc_id: r.mix_position for r in mixing.mix_sources(docs).collect()}

    def positions():
        rows = corpus_pipeline.run(spark, str(tmp_path / "many")).collect()
        assert len(rows) == len(want)
        return {r.doc_id: r.mix_position for r in rows}

    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    # several files, which the scan packs by size
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert positions() == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert positions() == want
    stages[1] = ("source mixing", same)
    assert positions() != want
