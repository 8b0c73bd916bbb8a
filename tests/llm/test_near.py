"""Near-duplicate operators against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from cairn.llm import embedding_dedup, near_dedup
from cairn.llm.common import components, salted_join, stored


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def near_texts():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 100
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
            i += 1
    common = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(60):  # share most of a passage, link or not
        rows.append((i, " ".join(common + [rng.choice(vocabulary) for _ in range(rng.randint(2, 40))])))
        i += 1
    rows += [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three four five"), (7, rows[0][1].upper()), (8, "x " * 20_000)]
    return rows


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in union_find(ids, links).items()}


def test_near_components(spark):
    rows = near_texts()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string")
    for p in (near_dedup.Params(), near_dedup.Params(block=4, rounds=2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(df, p=p).collect()}
        assert got == brute(rows)


def test_near_ids_repeated_and_null(spark):
    text = " ".join(f"q{i}" for i in range(50))
    rows = [(5, text), (5, text), (5, "another text altogether of some words"), (None, text), (None, "lone words without any id here"), (9, text + " tail")]
    got = sorted(((str(r.doc_id), r.component_id, r.kept) for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([("5", 5, True), ("5", 5, True), ("5", 5, True), ("None", 5, False), ("None", None, True), ("9", 5, False)], key=str)
    assert near_dedup.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketch_estimates(spark):
    p = near_dedup.Params()
    a, b = near_dedup._multipliers(p)
    rng = np.random.default_rng(2)
    for share in (0.75, 0.9):
        n = 2000
        base = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        k = int(n * 2 * share / (1 + share))
        x, y = base[:n], np.concatenate([base[:k], base[n : 2 * n - k]])
        sk = [near_dedup.odd_sketch(near_dedup.min_samples(near_dedup.mix64(s), a, b), p.bits) for s in (x, y)]
        assert int(np.bitwise_count(sk[0] ^ sk[1]).sum()) <= p.most_bits
    far = [near_dedup.odd_sketch(near_dedup.min_samples(rng.integers(0, 1 << 63, 500, dtype=np.uint64), a, b), p.bits) for _ in range(2)]
    assert int(np.bitwise_count(far[0] ^ far[1]).sum()) > p.most_bits


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = union_find({x for l in links for x in l}, links)
    assert {k: v for k, v in got.items()} == {k: want[k] for k in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(7)
    rows, i = [], 10
    for label in (0, 1, 1, 2):
        for _ in range(25):
            c = rng.normal(size=16)
            for _ in range(int(rng.integers(1, 5))):
                rows.append((i, (c + rng.normal(size=16) * 0.12).tolist(), label))
                i += 1
    rows += [(1, None, 0), (2, [0.0] * 16, 0), (3, [float("nan")] * 16, 0), (4, [None] * 16, 0), (5, rows[0][1], None), (6, rows[0][1], rows[0][2]), (7, rows[0][1][:8], rows[0][2]), (8, [float("inf")] * 16, 1), (9, [], 1)]
    return rows


def test_near_vectors(spark):
    rows = vectors()
    ok = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (label, np.array(v, np.float64))
    links, n = [], defaultdict(int)
    for a in ok:
        for b in ok:
            if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]):
                x, y = ok[a][1], ok[b][1]
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((a, b))
                    n[a] += 1
                    n[b] += 1
    want = {i: (n[i], c) for i, c in union_find([r[0] for r in rows], links).items()}
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    for block in (1024, 4):  # many pivots and blocks
        got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df, block=block).collect()}
        assert got == want
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_pivots_of_each_label(spark):
    """By size, labels of less than two blocks none, all within the bound."""
    rows = [(f"{i:04}".encode(), "8:a" if i % 3 else "4:b" if i % 2 else "8:c", bytes(8)) for i in range(900)] + [(b"x", "8:d", bytes(8))]
    nodes = spark.createDataFrame(rows, "node binary, part string, unit binary")
    few = embedding_dedup.pivots_of(nodes, 25)
    assert {k for k, v in few.items() if v} == {"8:a", "4:b", "8:c"}
    assert 2 <= len(few["8:a"]) <= 12 and len(few["4:b"]) <= 3
    assert sum(map(len, embedding_dedup.pivots_of(nodes, 1).values())) <= embedding_dedup.MOST_PIVOTS
    assert embedding_dedup.pivots_of(nodes, 1000) == {} == embedding_dedup.pivots_of(nodes.limit(0), 1)


def test_drop_near_copies_keeps_one_row_of_each_text(spark):
    a, b = "one two three four five six seven", "red green blue black white brown"
    rows = [(1, a), (2, a), (2, b), (None, b), (None, "alone here now"), (3, None), (3, None), (4, ""), (4, a)]
    out = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (2, b), (None, "alone here now"), (3, None), (3, None), (4, "")], key=str)


def test_recall_on_given_documents(spark):
    """All pairs of sf0.01 that share a shingle, against the operator's classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, holders = {}, defaultdict(list)
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r.text or ""))
        k = min(5, len(words))
        sets[r.doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()
        for s in sets[r.doc_id]:
            holders[s].append(r.doc_id)
    common = Counter(pair for own in holders.values() for pair in combinations(sorted(own), 2))
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    want = union_find(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs).collect()}
    assert links and got == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_salted_join(spark):
    rows = [("hub", i) for i in range(700)] + [(f"k{i % 50}", i) for i in range(300)] + [("none", 1), (None, 2)]
    left = stored(spark.createDataFrame(rows, "a string, b long"))
    right = spark.createDataFrame([("hub", "h")] + [(f"k{i}", str(i)) for i in range(60)], "a string, v string")
    found = sorted(tuple(r) for r in salted_join(left, right, "a", "b").select("a", "b", "v").collect())
    names = dict(tuple(r) for r in right.collect())
    assert found == sorted((a, b, names[a]) for a, b in rows if a in names)
    assert salted_join(left.limit(0), right, "a", "b").isEmpty()
