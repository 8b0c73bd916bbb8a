"""Exact deduplication, sharding and mixing against plain Python."""

import hashlib
import math
import re
import zlib
from fractions import Fraction
from itertools import islice

import pytest
from pyspark.sql import functions as F

from cairn.llm import exact_dedup as exact
from cairn.llm import mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (5, "a  b", "en", "x", 4),
    (3, "a b", "en", "x", 3),
    (3, "a b", "en", "x", 3),
    (9, "a\tb", None, None, None),
    (4, None, "en", "y", None),
    (6, "", "en", "y", 0),
    (7, " ", "en", "y", 1),
    (None, "a b", "en", "x", 3),
    (None, "lone", "en", "x", 4),
    (8, "a b", "en", "z", 3),
    (10, "long " * 20_000 + "x", "en", "z", 100_001),
    (11, "long " * 20_000 + "y", "en", "z", 100_001),
    (12, "long  " * 20_000 + "y", "en", "z", 120_001),
]


def test_exact_dedup_by_hand(spark):
    got = {}
    for r in exact.exact_dedup(spark.createDataFrame(ROWS, DOCS).withColumn("keep_id", F.lit("clash"))).collect():
        got.setdefault(r.doc_id, []).append((r.keep_id, r.group_size, r.kept))
    assert got[5] == [(3, 5, False)] and got[9] == [(3, 5, False)]
    assert got[3] == [(3, 5, True)] * 2
    assert sorted(got[None], key=str) == [(3, 5, False), (None, 1, True)]
    assert got[4] == [(4, 2, True)] and got[6] == [(4, 2, False)] and got[7] == [(7, 1, True)]
    assert got[8] == [(8, 1, True)] and got[10] == [(10, 1, True)]
    assert got[11] == [(11, 2, True)] and got[12] == [(11, 2, False)]


def test_drop_copies_keeps_columns_and_null_ids(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = exact.drop_copies(docs)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted(["3", "4", "7", "8", "10", "11", "None"])
    twice = docs.filter("doc_id < 5 OR doc_id > 8").unionByName(docs.filter("doc_id < 5 OR doc_id > 8"))
    assert sorted(r.doc_id for r in exact.drop_copies(twice).collect()) == [3, 4, 10, 11]


def test_no_row_of_an_exploded_or_unioned_scan_is_lost(spark, tmp_path):
    from cairn.llm import near_dedup

    tail = " ".join(f"w{k}" for k in range(40))
    rows = [(2, ["x " + tail, "y"]), (1, ["x " + tail]), (3, ["z", "z", "q " + tail]), (4, [None, ""])]
    spark.createDataFrame(rows, "doc_id long, texts array<string>").coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    exploded = scan.select("doc_id", F.explode("texts").alias("text"))
    shown = lambda df: sorted((r.doc_id, (r.text or "")[:1]) for r in df.select("doc_id", "text").collect())
    assert shown(exact.drop_copies(exploded)) == [(1, "x"), (2, "y"), (3, "q"), (3, "z"), (4, "")]
    assert shown(near_dedup.drop_near_copies(exploded)) == [(1, "x"), (2, "y"), (3, "z"), (4, ""), (4, "")]
    both = exploded.unionByName(exploded.withColumn("text", F.concat(F.col("text"), F.lit("!"))))
    kept = shown(exact.drop_copies(both))
    assert kept == sorted([(1, "x"), (2, "y"), (3, "q"), (3, "z"), (4, ""), (1, "x"), (2, "y"), (3, "q"), (3, "z"), (4, "!")])
    plain = spark.read.parquet(str(tmp_path / "t")).select("doc_id", F.element_at("texts", 1).alias("text"))
    assert shown(exact.drop_copies(plain, scanned=True)) == [(1, "x"), (3, "z"), (4, "")]


NAMES = ["_h", "_digest", "phases", "_source", "_index", "_p", "_s", "_block", "_rank", "_part", "_b", "_offset", "_row", "_key", "_text", "_id", "_n", "_len", "_pre", "_scores", "keep_id", "slot", "node", "component"]


def test_names_that_clash(spark):
    """Columns named like those that operators work with come back as they were."""
    from cairn.llm import near_dedup

    docs = spark.createDataFrame([(i, f"one two three four five {i % 7}", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in NAMES])
    for out, n in ((exact.drop_copies(docs), 7), (near_dedup.drop_near_copies(docs), 7), (mixing.mix_sources(docs), 40), (sharding.rendezvous(docs, F.col("doc_id"), [1.0, 2.0]), 40)):
        rows = out.collect()
        assert len(rows) == n and out.columns[: len(docs.columns)] == docs.columns
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in NAMES)
    assert sharding.shard_records(docs, 4).count() == exact.exact_dedup(docs, digests=True).count() == 40


def test_spread_join(spark):
    from cairn.llm import common

    rows = spark.range(20_050).select(F.when(F.col("id") < 20_000, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    rows = common.stored(rows)
    groups = common.stored(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m")))
    got = common.spread_join(rows, groups, ["k"], "n")
    assert sorted(got.columns) == ["id", "k", "m", "n"]
    assert got.count() == 20_050 and got.filter("k <> 'hot' AND n = 1 AND m = id").count() == 50 and got.filter("k = 'hot' AND m = 19999").count() == 20_000


def test_exact_dedup_empty(spark):
    assert exact.exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_shard(key, n):
    def h(s):
        return int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:15], 16)

    return max(range(n), key=lambda s: (h(s), -s))


def test_sharding_brute_force(spark):
    rows = [(i, "é" * (i % 7), "en", "s", i) for i in range(3000)] + [(None, None, None, None, None), (5, "é" * 5, "en", "s", 5)]
    out = sharding.shard_records(spark.createDataFrame(rows, DOCS), 40).collect()
    assert len(out) == len(rows)
    slots = {}
    for r in out:
        key = "" if r.doc_id is None else str(r.doc_id)
        text = "" if r.doc_id is None else "é" * (r.doc_id % 7)
        assert r.shard == brute_shard(key, 40) and r.grown_shard == brute_shard(key, 41)
        assert r.size == len(text.encode()) + 16 and r.text_crc32 == zlib.crc32(text.encode())
        assert r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_weights_and_empty(spark):
    df = spark.range(8000).withColumn("shard", F.lit("clash"))
    got = dict(sharding.rendezvous(df.select("id"), F.col("id"), [1.0, 3.0]).groupBy("shard").count().collect())
    assert abs(got[1] / 8000 - 0.75) < 0.02
    assert sharding.shard_records(spark.createDataFrame([], DOCS), 4).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(df, F.col("id"), [0.0])


def test_gapless_many_blocks(spark):
    from cairn.llm.common import gapless, hash60

    df = spark.range(5000).select((F.col("id") % 3).alias("p"), "id").withColumn("h", hash60(F.col("id")))
    out = gapless(df, "p", ["h", "id"], "n", rows_per_block=100).collect()
    for p in range(3):
        own = sorted((r.h, r.id, r.n) for r in out if r.p == p)
        assert [n for _, _, n in own] == list(range(len(own)))


def test_one_period_is_fair():
    quota = mixing.quotas({"a": 0.61, "b": 0.3, "c": 0.05, "d": 0.04, "zero": 0}, 100)
    assert sum(quota.values()) == 100 and "zero" not in quota
    done = dict.fromkeys(quota, 0)
    for t, s in enumerate(mixing.one_period(quota), 1):
        done[s] += 1
        assert all(abs(done[x] - t * a / 100) < 1 for x, a in quota.items())
    assert done == quota


def brute_mix(quota, blocks):
    """Earliest deadline first, slot by slot, each phase on its own clock."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    while left:
        live = sorted(left)
        period, done, t = sum(quota[s] for s in live), dict.fromkeys(live, 0), 0
        while True:
            ready = [s for s in live if math.floor(done[s] * period / quota[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((done[s] + 1) * period / quota[s]), s))
            if not left[s]:
                break
            done[s] += 1
            left[s] -= 1
            t += 1
            order.append(s)
        left = {s: n for s, n in left.items() if n}
    return order


def test_mixing_brute_force(spark):
    sizes = {"big": 700, "mid": 90, "small": 35, "tiny": 1}
    rows = [(i, s, 1) for s, n in sizes.items() for i in range(n)] + [(1, None, 1), (None, "rest", 1)]
    weights = {"big": 4, "mid": 3, "small": 2, "tiny": 1, "absent": 5, "rest": 0}
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot int")
    out = mixing.mix_sources(df, weights, block_rows=8).collect()
    assert sorted(r.mix_position for r in out) == list(range(len(rows)))
    quota = mixing.quotas({s: w for s, w in weights.items() if s in sizes})
    order = brute_mix(quota, {s: -(-n // 8) for s, n in sizes.items()})
    by_slot = {r.mix_slot: r.source for r in out if r.mix_phase is not None}
    assert [by_slot[t] for t in range(len(order))] == order
    assert {r.source for r in out if r.mix_phase is None} == {None, "rest"}
    for s in sizes:
        own = sorted((r.mix_position, r.mix_block) for r in out if r.source == s)
        assert [b for _, b in own] == sorted(b for _, b in own)


def test_mixing_defaults(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0], "x") for i in range(400)], "doc_id long, source string, text string")
    out = mixing.mix_sources(df)
    assert out.columns == ["doc_id", "source", "text", "mix_block", "mix_phase", "mix_slot", "mix_position"]
    assert sorted(r.mix_position for r in out.collect()) == list(range(400))
    assert mixing.mix_sources(df.limit(0)).count() == 0


def fair(order, weights):
    """Whether after every slot each source has its share of the given
    weights, give or take less than one."""
    total, done = sum(Fraction(str(w)) for w in weights.values()), dict.fromkeys(weights, 0)
    share = {s: Fraction(str(w)) / total for s, w in weights.items()}
    for t, s in enumerate(order, 1):
        done[s] += 1
        if t % 7 == 0 or t < 300:
            assert all(abs(done[x] - t * w) < 1 for x, w in share.items()), t
    return True


HOT = {"hot": 1 / 3} | {f"s{k:02}": 2 / 57 for k in range(19)}


def test_mix_is_fair_to_the_given_weights():
    assert fair(islice(mixing.dealt(mixing.quotas(HOT)), 60_000), HOT)
    rare = {"a": 0.61, "b": 0.3, "c": 0.05, "d": 0.04, "rare": 1e-6}
    assert fair(islice(mixing.dealt(mixing.quotas(rare)), 20_000), rare)
    assert mixing.quotas({"a": 0.61, "b": 0.3, "c": 0.05, "d": 0.04}) == {"a": 61, "b": 30, "c": 5, "d": 4}
    with pytest.raises(ValueError):
        mixing.quotas({"a": 1, "b": 2}, 100)


@pytest.mark.parametrize("broadcast", [True, False])
def test_mixed_rows_are_fair_to_the_given_weights(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SLOTS", 0)
    short = {"a": 0.61, "b": 0.3, "c": 0.09}
    for weights, sizes in [(HOT, {s: 2000 if s == "hot" else 150 for s in HOT}), (short, {"a": 1300, "b": 600, "c": 500}), (None, {"a": 3000, "b": 500, "c": 77})]:
        rows = [(i, s) for s, n in sizes.items() for i in range(n)] + [(1, None)]
        out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), weights, block_rows=1).collect()
        assert sorted(r.mix_position for r in out) == list(range(len(rows)))
        mixed = sorted((r.mix_slot, r.source) for r in out if r.mix_phase is not None)
        assert [t for t, _ in mixed] == list(range(len(rows) - 1))
        first = [r.mix_slot for r in out if r.mix_phase == 0]
        assert fair([s for _, s in mixed[: len(first)]], weights or mixing.tempered(sizes, 0.5))


def test_white_space_is_ascii_only():
    assert re.fullmatch(exact.WHITE, "\x0b\x0c\r\n\t ") and not re.fullmatch(exact.WHITE, " ")
