"""Toxicity and quality on held-out rows of a small planted corpus."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import linear, quality, toxicity

WORDS = ["tree", "river", "house", "light", "paper", "stone", "window", "garden", "letter", "music", "the", "of", "and"]
RUDE = ["grumblefoot", "grumblehead", "grumblish"]


def corpus(n=600):
    rng, rows = random.Random(4), []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "."]) for _ in range(rng.randint(20, 80))]
        toxic, quality_ = int(i % 5 == 0), int(i % 3 != 0)
        if toxic:
            words[3:3] = [rng.choice(RUDE)]
        if not quality_:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        rows.append((i, " ".join(words), toxic, quality_))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "id long, text string, toxic int, quality int").cache()


def test_toxicity_held_out(spark, docs):
    train = docs.filter("id % 4 <> 0")
    model = toxicity.train(train.select("id", "text"), train.select("id", "toxic"))
    out = toxicity.score(docs.select("id", "text"), model, "id").join(docs, "id").filter("id % 4 = 0").collect()
    assert sum((r.score >= 0.5) == r.toxic for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_toxicity_edges(spark, docs):
    model = toxicity.train(docs.select("id", "text"), docs.select("id", "toxic"))
    odd = spark.createDataFrame([(None, None, "c"), (1, "", "c"), (1, "", "c"), (2, "grumblish " * 50_000, "c"), (3, "!!!", "c")], "id long, text string, score string")
    got = [(r.id, round(r.score, 9), r.predicted) for r in toxicity.score(odd, model, "id").collect()]
    empty = {s for i, s, _ in got if i != 2}
    assert len(got) == 5 and len(empty) == 1 and [p for i, _, p in got if i == 2] == [1]
    assert toxicity.score(odd.limit(0), model, "id").count() == 0
    none = toxicity.train(docs.select("id", "text"), docs.select("id", F.lit(None).cast("int").alias("toxic")))
    assert {r.predicted for r in toxicity.score(odd, none, "id").collect()} == {0}


def test_quality_held_out(spark, docs):
    rated = docs.withColumn("grade", quality.grade_of(F.col("quality"), F.col("toxic")))
    train = rated.filter("id % 4 <> 0")
    model = quality.train(train.select("id", "text"), train.select("id", "grade"))
    out = quality.score(docs.select("id", "text"), model, "id").join(docs, "id").filter("id % 4 = 0").collect()
    assert sum(r.kept == bool(r.quality) for r in out) >= 0.98 * len(out)
    assert all(r.tails == sorted(r.tails, reverse=True) and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in out)
    kept = quality.filter_docs(docs, model)
    assert kept.columns == docs.columns and {r.id for r in kept.collect()} == {r.id for r in quality.score(docs, model, "id").filter("kept").collect()}


def test_quality_edges(spark, docs):
    rated = docs.select("id", F.when(F.col("id") % 2 == 0, F.col("quality")).alias("grade"))
    model = quality.train(docs.select("id", "text"), rated, grades=2)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 200_000), (3, "\n\n\t")], "id long, text string")
    assert quality.score(odd, model, "id").count() == 5
    assert quality.score(odd.limit(0), model, "id").count() == 0
    blank = quality.train(docs.limit(0).select("id", "text"), rated.limit(0))
    assert quality.score(odd, blank, "id").filter("kept").count() == 5


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    latent = x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=3000)
    grade = np.digitize(latent, [-1.0, 1.5])
    rows = linear.Rows.of([(np.arange(3), v) for v in x])
    w, cuts = linear.fit(rows, grade, np.ones(3000), 3, 3, 1e-6)
    assert np.allclose(w, [2, -1, 0], atol=0.25) and np.allclose(cuts, [-1, 1.5], atol=0.25)


def plain_grams(text):
    """Buckets of the n-grams of a text's words, from the definition."""
    out = set()
    for word in set(re.findall(r"[^\W_]+", (text or "").lower())):
        raw = f"<{word}>".encode()
        for n in toxicity.GRAMS:
            out |= {zlib.crc32(raw[i : i + n]) % toxicity.BUCKETS for i in range(max(1, len(raw) - n + 1))}
    return out


def test_toxicity_by_brute_force(spark):
    """Ratios from plain counts, weights as the minimum of the loss, scores as
    plain sums."""
    rows = [(i, t, y) for i, t, y, _ in corpus(240)] + [(1000, None, 1), (1001, "", 0), (1002, "Ünïcode grumblish_foot 漢字", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    weights, cut = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "id long, toxic int"), l2=1e-3)
    grams = [plain_grams(t) for _, t, _ in rows]
    n = Counter(y for *_, y in rows)
    pos, neg = Counter(), Counter()
    for g, (_, _, y) in zip(grams, rows, strict=True):
        (pos if y else neg).update(g)
    ratio = {}
    for b in pos.keys() | neg.keys():
        r = math.log((pos[b] + 1) / (n[1] + 2)) - math.log((neg[b] + 1) / (n[0] + 2))
        if pos[b] + neg[b] >= 3 and abs(r) >= 2 * math.sqrt(1 / (pos[b] + 1) + 1 / (neg[b] + 1)):
            ratio[b] = r
    assert set(np.flatnonzero(weights)) <= ratio.keys() and len(ratio) > 20
    w = {b: float(weights[b]) / r for b, r in ratio.items()}
    slope, lead = {b: 1e-3 * x for b, x in w.items()}, 0.0
    for g, (_, _, y) in zip(grams, rows, strict=True):  # every row stands for itself
        off = (1 / (1 + math.exp(cut - sum(w[b] * ratio[b] for b in g if b in ratio))) - y) / len(rows)
        lead += off
        for b in g & ratio.keys():
            slope[b] += off * ratio[b]
    assert max(map(abs, slope.values())) < 2e-3 and abs(lead) < 2e-3
    got = {r.id: r.score for r in toxicity.score(docs, (weights, cut), "id").collect()}
    for g, (i, *_) in zip(grams, rows, strict=True):
        assert math.isclose(got[i], 1 / (1 + math.exp(cut - sum(float(weights[b]) for b in g))), abs_tol=1e-6)


def plain_features(text):
    """Feature values of a text from the definition: shapes and pairs of
    shapes by their share, 4-grams of letters, bins of eight ratios."""
    text, out = text or "", Counter()
    tokens = text.split()

    def shape(token):
        if token[:-1].isalpha() and not token[-1].isalpha():  # one last character stays as it is
            return ("A" if token[:-1].isupper() else "Aa" if token[0].isupper() else "a") + token[-1]
        s = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a", token)
        return re.sub(r"(\W)\1{2,}", r"\1\1\1", re.sub(r"\d+", "0", s))

    shapes = [zlib.crc32(shape(t).encode()) for t in tokens]
    for s, k in Counter(shapes).items():
        out[s % quality.BUCKETS] += math.sqrt(k / len(tokens))
    for (a, b), k in Counter(zip(shapes, shapes[1:])).items():
        out[(a * 1_000_003 + b + 1) % quality.BUCKETS] += math.sqrt(k / len(tokens))
    grams = set()
    for t in set(tokens):
        raw = f"<{''.join(filter(str.isalpha, t)).lower()}>".encode()
        grams |= {zlib.crc32(raw[k : k + 4], 1) % quality.BUCKETS for k in range(max(1, len(raw) - 3))}
    for g in grams:
        out[g] += 0.2
    lines, raw = [x for x in text.split("\n") if x.strip()], text.encode()
    dark = max(1, sum(not (c < 128 and chr(c).isspace()) for c in raw))
    letters = sum(c >= 128 or chr(c).isalpha() for c in raw)
    n, pairs = len(tokens), list(zip(tokens, tokens[1:]))
    ratios = [
        math.log2(1 + n) / 16, len(set(tokens)) / max(1, n), len(set(pairs)) / max(1, n - 1), len(set(lines)) / max(1, len(lines)),
        dark / max(1, len(raw)), min(1, dark / max(1, n) / 20), min(1, math.log2(1 + n / max(1, len(lines))) / 12), letters / dark,
    ]
    for name, r in zip(quality.RATIOS, ratios, strict=True):
        out[(zlib.crc32(f"r{name}".encode()) % quality.BUCKETS + 7919 * min(9, int(r * 10))) % quality.BUCKETS] += 1
    out[zlib.crc32(b"bias") % quality.BUCKETS] += 1
    return out


def test_quality_by_brute_force(spark):
    """Features, tails and the expected grade from plain definitions."""
    texts = [t for _, t, _, _ in corpus(60)] + [None, "", "one", "The  Tree-house?\n\nthe TREE!!!! 12 a1 ... Ünï\t42%\nThe  Tree-house?", "x" * 3000, "a b a b a b\n" * 50]
    known = quality.Tokens()
    for t in texts:
        ids, values = quality.features(t, known)
        got = Counter()
        for i, v in zip(ids.tolist(), values.tolist(), strict=True):
            got[i] += v
        want = plain_features(t)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in want), t
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    w, cuts = quality.train(docs, spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, grade int"))
    assert list(cuts) == sorted(cuts)
    for r in quality.score(docs, (w, cuts), "id", least=2, tail=0.4).collect():
        s = sum(float(w[k]) * v for k, v in plain_features(texts[r.id]).items())
        tails = [1 / (1 + math.exp(t - s)) for t in cuts]
        assert np.allclose(r.tails, tails, atol=1e-5) and math.isclose(r.expected_grade, sum(tails), abs_tol=1e-5)
        assert r.kept == (tails[1] >= 0.4) or abs(tails[1] - 0.4) < 1e-5
