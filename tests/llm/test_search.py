"""Lexical and vector search, and the Merkle manifest, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import lexical, merkle
from cairn.llm import vector_search as vs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def brute_search(docs, items, top):
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        asked, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, b in bags:
            m = 100 - 50 + 50 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in asked if w in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def test_terms():
    text = "Ünder_score, don't ÀB c3 x naïve 中文。ok\x7fendİ"
    assert [t.decode() for t in lexical.terms(text.encode())] == TERM.findall(text.translate(LOWER))
    assert lexical.terms(None) == lexical.terms(b"") == lexical.terms(b" ,.\n") == []


def test_lexical_search_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(900)]
    docs += [(1000 + i, "w3 W5 w300 w301") for i in range(90)]  # ties that go beyond the last place
    docs += [(7, docs[7][1]), (None, "w3 w5 w300 w301"), (None, None), (2000, ""), (2001, None), (2002, "w1 w350 " * 20_000), (2003, " .,;")]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(25)]
    items += [(50, "w300 w301"), (51, None), (52, ""), (53, "nowhere"), (54, "W0 w0 w1 w2 w3 w4"), (None, "w9 w10"), (3, "w11 w200 w201")]
    frame = lambda rows, name: spark.createDataFrame([(*r, "x", 1) for r in rows], f"{name} long, text string, score string, n int").repartition(3)
    got = lexical.search(frame(docs, "doc_id"), frame(items, "item_id"), 50)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items, 50)


def test_lexical_batches_and_empty_tables(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 11} c{i}") for i in range(200)]
    items = [(k, f"a{k} b{k} c{k} c{k + 1}") for k in range(9)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BATCH_TERMS", 10)
    assert sorted(map(tuple, lexical.search(d, q, 5).collect()), key=str) == brute_search(docs, items, 5)
    assert lexical.search(d.limit(0), q).count() == lexical.search(d, q.limit(0)).count() == 0


def test_blocks_bound_their_documents_and_are_skipped():
    """Summaries are at least every document's score, and a search that skips
    blocks finds what all scores have."""
    rng = np.random.default_rng(1)
    v, n = 300, 3000
    topics = [rng.choice(v, 40, replace=False) for _ in range(20)]
    vectors = []
    for _ in range(n):
        own = np.unique(np.concatenate([rng.choice(topics[rng.integers(20)], 12), rng.integers(0, 12, 4)]))
        vectors.append((own, rng.integers(1, 5, len(own))))
    sizes = np.array([len(t) for t, _ in vectors])
    t, tf = (np.concatenate([x[k] for x in vectors]).astype(np.int64) for k in (0, 1))
    df = np.bincount(t, minlength=v)
    items = [(k, k, np.sort(rng.choice(topics[k % 20], 10, replace=False))) for k in range(40)]
    plan = lexical.Plan(items, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df]), n, int(tf.sum()), 10)
    segment = lexical.Segment(np.arange(n), sizes, t, lexical.impacts(tf, np.add.reduceat(tf, np.cumsum(sizes) - sizes), sizes, plan), plan)
    opened = 0
    for _, _, ts in items:
        asked = np.zeros(v, np.int64)
        asked[ts] = plan.weight[ts]
        scores = np.add.reduceat(segment.c * asked[t], np.cumsum(sizes) - sizes)
        for one in ts.tolist():
            docs, starts, coordinates, summary = segment.blocks(one)
            assert sorted(docs.tolist()) == sorted(np.flatnonzero(np.bincount(np.repeat(np.arange(n), sizes)[t == one], minlength=n)).tolist())
            bound = summary[:, np.searchsorted(coordinates, ts)] @ plan.weight[ts]
            assert all(bound[b] >= scores[docs[starts[b] : starts[b + 1]]].max() for b in range(len(bound)))
        best, offered = lexical.Best(10), []
        offer = best.offer
        best.offer = lambda s, i, offer=offer, offered=offered: (offered.append(len(s)), offer(s, i))
        segment.search(ts, best)
        order = np.lexsort((np.arange(n), -scores))[:10]
        assert best.ids.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()
        opened += sum(offered) / max(1, (scores > 0).sum())
    assert opened / len(items) < 0.8  # the rest was never scored


def brute_near(vectors, queries, top):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for q, (i, u) in queries:
        if ok(u):
            near = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), j is None, j or 0, j) for k, (j, v) in enumerate(vectors) if ok(v) and len(v) == len(u) and k != q)
            out += [(i, k, j, -s) for k, (s, _, _, j) in enumerate(near[:top], 1)]
    return out


def test_vector_search_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.standard_normal((700, 16)) * rng.uniform(0.2, 3, (700, 1)), 3).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[20]) for i in range(300)]  # copies of a query's vector, more than places
    rows += [(40, x[40]), (60, x[61]), (None, x[60]), (None, None), (2000, None), (2020, [0.0] * 16), (2040, [math.inf] * 16), (2060, [None] * 16), (2080, []), (2100, [1.0, 2.0]), (2101, [3.0, -1.0])]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, cell string, far double").repartition(3)
    got = vs.search(vs.build_index(docs, 20), docs.filter("vec_id % 20 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute_near(rows, [(k, r) for k, r in enumerate(rows) if r[0] is not None and r[0] % 20 == 0], 20)
    shown = lambda out: Counter((q, round(s, 9), j) for q, _, j, s in out)
    missed = shown(want) - shown(map(tuple, got.collect()))
    assert sum(missed.values()) <= 0.01 * len(want)
    assert {r["query_id"] for r in got.collect()} == {q for q, *_ in want}
    empty = docs.limit(0)
    assert vs.search(vs.build_index(empty, 20), docs).count() == vs.search(vs.build_index(docs, 20), empty).count() == 0


def test_vector_search_recall_over_levels(spark, monkeypatch):
    """Several levels and cells, tight clusters among noise."""
    monkeypatch.setattr(vs, "SAMPLE", 128)
    monkeypatch.setattr(vs, "CELL_ROWS", 128)
    rng = np.random.default_rng(8)
    noise = rng.standard_normal((2500, 32))
    tight = rng.standard_normal(32) + 0.05 * rng.standard_normal((1500, 32))
    x = np.concatenate([noise, tight])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(np.float64)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    index = vs.build_index(docs, 20)
    assert index.levels == 3 and len(index.centroids[32]) > 20
    got = vs.search(index, docs.filter("vec_id % 20 = 0")).toPandas()
    near, hits = x[::20] @ x.T, 0
    for k, q in enumerate(range(0, len(x), 20)):
        near[k, q] = -9
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and mine["score"].is_monotonic_decreasing
        assert np.allclose(mine["score"], near[k, mine["vec_id"]], atol=1e-12)
        hits += len(set(mine["vec_id"]) & set(np.argsort(-near[k], kind="stable")[:20].tolist()))
    assert hits / (20 * len(near)) >= 0.99


def test_codes_estimate_within_their_bounds():
    rng = np.random.default_rng(2)
    x, q, c = rng.standard_normal((2000, 48)), rng.standard_normal((60, 48)), rng.standard_normal(48) * 0.3
    r = x - c
    far = np.linalg.norm(r, axis=1)
    turned = (r / far[:, None]) @ vs.rotation(48).T
    a = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
    code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
    guess, error = vs.estimates(q, c, code, far, a, x @ c)
    off = guess - q @ x.T
    assert (np.abs(off) <= error).mean() > 0.995 and abs(off.mean()) < 0.02 * np.abs(q @ x.T).mean()


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    f = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: h(f(r[0]), f(r[3]), f(r[2]), f(r[4]), f(text))

    def grow(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
        return levels

    def sides(levels, k):
        for own in levels[:-1]:
            first = k // 16 * 16
            yield own[first:k], own[k + 1 : first + 16]
            k //= 16

    groups = {}
    for r in rows:
        groups.setdefault("" if r[3] is None else f"={r[3]}", []).append(r)
    names = sorted(groups, key=str.encode)
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[name] = own, grow([leaf(r, r[1]) for r in own])
    top = grow([trees[n][1][-1][0] for n in names])
    out = []
    for place, name in enumerate(names):
        own, levels = trees[name]
        for k, r in enumerate(own):
            path = [*sides(levels, k), *sides(top, place)]
            again = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            now = leaf(r, r[1].translate(LOWER) if again and r[1] is not None else r[1])
            for left, right in path:
                now = h(*left, now, *right)
            out.append((r[0], levels[0][k], levels[-1][0], top[-1][0], h(*(x for left, right in path for x in (*left, *right))), now, now == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sources", [1, 3, 40])
def test_manifest_by_brute_force(spark, sources):
    rows = [(i * 3, f"Text É {i}" if i % 4 else "plain", "en", f"s{i % sources}", i) for i in range(350)]
    rows += [(9000 + i, "One hot Source", None, "hot", 1) for i in range(300)] if sources > 1 else []
    if sources == 3:
        rows += [(5, "Same Row", "en", "twin", 3)] * 70 + [(None, None, None, None, None), (None, "", None, None, 0), (None, "B", "x", "s0", 1), (77, "Long " * 30_000, "en", "long", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("tree", F.lit("x")).withColumn("_id", F.lit("y")).repartition(5)
    got = merkle.verify_documents(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_manifest(rows)


def test_manifest_small_and_shuffled_joins(spark, monkeypatch):
    one = spark.createDataFrame([(5, "A", "en", "s", 1)], DOCS)
    assert list(map(tuple, merkle.verify_documents(one).collect())) == brute_manifest([(5, "A", "en", "s", 1)])
    assert merkle.verify_documents(one.limit(0)).count() == 0
    monkeypatch.setattr(merkle, "BROADCAST_RECORDS", 0)
    rows = [(i, f"T{i}", "en", "ab"[i % 3 == 0], i) for i in range(600)]
    assert sorted(map(tuple, merkle.verify_documents(spark.createDataFrame(rows, DOCS)).collect()), key=str) == brute_manifest(rows)


def test_a_few_requests_are_proven(spark):
    """Requests of some leaves, repeated ones and one of no leaf."""
    leaves = spark.range(1000).select(F.lit("t").alias("tree"), F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    manifest = merkle.build(leaves, ["id"])
    asks = spark.createDataFrame([("t", 3), ("t", 999), ("t", 3), ("t", 1000), ("u", 0)], "tree string, rank long").withColumn("ask", F.struct("rank"))
    got = merkle.prove(manifest, asks).select("ask.rank", "leaf", merkle.fold(F.col("leaf"), F.col("path")).alias("root")).collect()
    assert sorted(r["rank"] for r in got) == [3, 3, 999]
    assert all(r["leaf"] == h(str(r["rank"])) and r["root"] == manifest.root for r in got)
    records = {r["digest"]: r["children"] for r in manifest.records().collect()}
    assert len(records) == 63 + 4 + 1 and all(h(*v) == k for k, v in records.items())
