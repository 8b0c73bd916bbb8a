"""Closed forms, contracts and gates on small frames."""

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cairn.functions import mutations as X
from cairn.functions.tails import fisher_two_sided
from cairn.operators import cohort as C
from cairn.operators import derive as D
from cairn.operators import evaluate as E
from cairn.operators import grading as G
from cairn.operators import integrity as V
from cairn.operators import mart as M
from cairn.operators import models, ranks
from cairn.operators import serve as R
from cairn.operators import stats as S
from cairn.operators import steps as P
from cairn.sources import deposit, release


def test_anti_join_is_not_not_in(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    assert [r.k for r in V.orphans(child, parent, ["k"]).collect()] == [2]
    assert V.ri_check("a.b", child, parent, ["k"]).first().n_null_keys == 1


def test_keys_and_gates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    with pytest.raises(ValueError):
        V.assert_unique(df, ["k"])
    V.assert_unique(df.filter("v = 'a'"), ["k"])
    summary = spark.createDataFrame([("mutations.part", 3, 0), ("images.plates", 9, 0)], "check_name string, n_orphans long, n_null_keys long")
    with pytest.raises(ValueError):
        V.require_gate(summary, ["mutations"])
    V.require_gate(summary, ["other"])
    with pytest.raises(ValueError):
        V.require_gate(summary, ["other"], strict=True)
    half = spark.createDataFrame([(1.0,)] * 49 + [(None,)] * 51, "x double")
    with pytest.raises(ValueError):
        V.coverage_guard(half, "x")
    with pytest.raises(ValueError):
        C.require_rows(df.limit(0))


def test_two_by_two(spark):
    t = spark.createDataFrame([(10, 5, 20, 65), (0, 0, 3, 4)], "a int, b int, c int, d int").withColumns({"x": S.chi2(), "m": S.mutual_information(), "r": S.phi(), "o": S.odds_ratio()}).collect()
    n, a, b, c, d = 100, 10, 5, 20, 65
    chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    mi = sum(x / n * math.log(x * n / (r * k)) for x, r, k in ((a, 15, 30), (b, 15, 70), (c, 85, 30), (d, 85, 70)))
    assert math.isclose(t[0].x, chi) and math.isclose(t[0].m, mi) and math.isclose(t[0].r, math.sqrt(chi / n)) and math.isclose(t[0].o, 6.5)
    assert t[1].x == 0 and t[1].m == 0 and t[1].r is None


def test_auc_ties_and_one_class(spark):
    rows = [("a", 0.1, 0), ("a", 0.4, 1), ("a", 0.4, 0), ("a", 0.9, 1), ("b", 0.5, 1), ("b", 0.5, 1), ("c", 0.5, 1), ("c", 0.5, 0)]
    got = {r.g: r.auc for r in S.auc(spark.createDataFrame(rows, "g string, score double, y int"), "score", F.col("y") == 1, ["g"]).collect()}
    assert got == {"a": 0.875, "b": None, "c": 0.5}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.04, 0.5])], "i int, p double")
    q = [r.q for r in S.benjamini_hochberg(df, "p", (), ["i"]).orderBy("i").collect()]
    assert [round(x, 6) for x in q] == [0.04, round(0.16 / 3, 6), round(0.16 / 3, 6), 0.5]


def test_rank_graded(spark):
    graded = spark.createDataFrame([("D", f"u{i}", float(v)) for i, v in enumerate([1, 2, 3, 4, 5, 6])] + [("D", "u9", None)], "drug string, uid string, value double")
    carried = spark.createDataFrame([(f"u{i}", "g", "m") for i in (3, 4, 5, 9)], "uid string, gene string, mutation string")
    r = S.rank_graded(graded, carried, 1).first()
    assert (r.n1, r.n2, r.u, r.effect) == (3, 3, 9.0, 1.0)


def test_fisher():
    assert math.isclose(fisher_two_sided(3, 1, 1, 3), 0.4857142857, rel_tol=1e-6)
    assert fisher_two_sided(0, 0, 0, 0) == 1.0


def test_names(spark):
    rows = ["K5E", "F5F", "a-15c", "10_del_a", "R5!", "5_minorindel", "S3X!", "K5Z"]
    got = [r.c for r in spark.createDataFrame([(m,) for m in rows], "m string").select(X.mut_class(F.col("m")).alias("c")).collect()]
    assert got == ["nonsynonymous", "synonymous", "promoter_nt", "indel", "nonsense_Z", "minor_indel", "other", "nonsense_Z"]
    g = spark.createDataFrame([("PE5",), ("PPE_3",), ("esxA",), ("IS6110",), ("rpoB",)], "g string").select(X.region(F.col("g")).alias("r")).collect()
    assert [r.r for r in g] == ["PE", "PPE", "ESX", "IS", "core"]
    r = spark.range(1).select(X.radicalness(F.lit("R5H")).alias("x"), X.radicalness(F.lit("a-5c")).alias("z")).first()
    assert math.isclose(r.x, abs(-4.5 + 3.2) + 2 * 0.5 + abs(173.4 - 153.2) / 50) and r.z == 0


def test_origins_by_hand(spark):
    iso = spark.createDataFrame([(f"u{i}", x) for i, x in enumerate(["1.1.1", "1.1.2", "1.2.1", "1.2.2", "2.1.1", "2.1.2"])], "uid string, sublineage string")
    carried = spark.createDataFrame([("u0", "g", "one"), ("u0", "g", "three"), ("u2", "g", "three"), ("u4", "g", "three"), ("u0", "g", "clade"), ("u1", "g", "clade")], "uid string, gene string, mutation string")
    got = {r.mutation: r.n_origins for r in D.origins(carried, iso).collect()}
    assert got == {"one": 1, "three": 3, "clade": 1}


def test_support_is_cleaned(spark):
    rows = [("u", "g", "m", float("inf"), True), ("u", "g", "m", None, False), ("u", "g", "n", float("nan"), True)]
    got = {r.mutation: (r.support, r.only_minor) for r in D.quality_values(spark.createDataFrame(rows, "uid string, gene string, mutation string, frs double, is_minor boolean")).collect()}
    assert got == {"m": (1.0, False), "n": (0.0, True)}


def test_step_registry(spark):
    with pytest.raises(ValueError):
        P.Chain([("rank_association", {})], "label_free")
    with pytest.raises(ValueError):
        P.Chain([("nothing", {})], "train_fold")
    with pytest.raises(ValueError):
        P.register_step("class_filter", True)(lambda f: f)
    chain = P.Chain([("class_filter", {"keep": ["indel"]})], "label_free")
    df = spark.createDataFrame([("g", "1_del_a", "indel"), ("PE1", "K5E", "nonsynonymous")], "gene string, mutation string, mut_class string")
    assert chain.run(df).count() == 1 and chain.label_safe and len(chain.notes) == 1
    assert P.region_filter(df).count() == 1


def test_leave_one_out_is_recomputation(spark):
    rows = spark.createDataFrame([("D", "m", g, n) for g, n in (("a", 3), ("b", 4), ("c", 5))], "drug string, f string, g string, n long")
    got = {r.held_out: r.n for r in P.leave_one_out(rows, "g", ["n"], ["drug", "f"], rows).collect()}
    assert got == {"a": 9, "b": 8, "c": 7}


def test_folds_do_not_split(spark):
    c = spark.createDataFrame([(f"u{i % 40}", f"D{i % 3}", "RS"[i % 2]) for i in range(240)], "uid string, drug string, phenotype string").distinct()
    M.assert_no_split(M.stratified_group_folds(c, 4, 1))
    with pytest.raises(ValueError):
        M.assert_no_split(c.select("uid", F.col("drug").alias("fold")))
    names = spark.createDataFrame([(x,) for x in ("raw__a", "cat__r", "cov__coresist_D2", "cov__lineage_L1", "y__b", "cov__country")], "c string")
    kept = lambda name, held: [r.c for r in names.filter(M.in_feature_set(F.col("c"), name, held)).collect()]
    assert kept("de_novo", True) == ["raw__a"] and kept("models", False) == ["raw__a", "cat__r", "cov__lineage_L1"] and len(kept("all", False)) == 4


def test_missing_anchors(spark):
    ids = lambda *x: spark.createDataFrame([(v,) for v in x], "uid string")
    got = {r.uid: (r.in_wgs, r.in_dst, r.has_m) for r in V.sample_coverage({"wgs": ids("a", "b", "b"), "dst": ids("b", "c")}, {"m": ids("a", "z")}).collect()}
    assert got == {"a": (True, False, True), "b": (True, True, False), "c": (False, True, False)}


def test_phenotypes_in_conflict(spark):
    df = spark.createDataFrame([("u", "D", "R"), ("u", "D", "S"), ("v", "D", "R"), ("w", "D", None)], "uid string, drug string, phenotype string")
    assert {r.uid: r.phenotype for r in C.resolve_phenotype(df).collect()} == {"u": None, "v": "R"}
    with pytest.raises(ValueError):
        C.phenotype_source("x", dst=df)


def test_grading_to_fixpoint(spark):
    s = [(f"s{i}", "S", "neutral") for i in range(80)] + [(f"r{i}", "R", "cause") for i in range(20)] + [(f"r{i}", "R", "neutral") for i in range(20)]
    samples = spark.createDataFrame([("D", u, p) for u, p in {(u, p) for u, p, _ in s}], "drug string, uid string, phenotype string")
    mutations = spark.createDataFrame([("D", u, m) for u, _, m in s], "drug string, uid string, mutation string")
    got = {r.mutation: (r.prediction, r.round) for r in G.grade(samples, mutations).collect()}
    assert got["neutral"][0] == "S" and got["cause"] == ("R", 1)


def test_documents(spark, tmp_path):
    docs = [{"uid": "a", "covariates": {"lineage": "lineage1", "tb_depth": 50.0}, "variants": [{"gene": "B1", "mutation": "K1E"}, {"gene": "B1", "mutation": "K2X"}]},
            {"uid": "b", "covariates": {"lineage": "lineage9"}, "variants": []}, {"uid": "c", "variants": [{"gene": "B1"}]}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, docs)))
    raw = spark.read.text(str(tmp_path / "d.json"))
    inst = R.read_instances(raw)
    assert {(r.uid, r.rule) for r in R.validate(inst).collect()} == {("b", "unknown lineage"), ("c", "covariates missing"), ("c", "variant without mutation")}
    f = spark.createDataFrame([("D", "B1", "K1E"), ("D", "B1", "K2X")], "drug string, gene string, mutation string")
    schema = R.feature_schema(f, f, 40.0)
    with pytest.raises(ValueError):
        R.feature_schema(f, f.limit(1), 40.0)
    model = schema.select("*", F.lit(1.0).alias("coef"), F.lit(0.25).alias("mean"), F.lit(1.0).alias("scale"))
    v = {(r.uid, r.feature): r.value for r in R.vectorize(inst, model).collect()}
    assert v == {("a", "B1@K1E"): 1, ("a", "lineage1"): 1, ("a", "tb_depth"): 50, ("b", "tb_depth"): 40, ("c", "tb_depth"): 40}
    batch = {r.uid: (r.logit, r.is_valid) for r in R.predict(inst, model).collect()}
    assert batch == {"a": (52.0 - 7 * 0.25, True), "b": (40.0 - 7 * 0.25, True), "c": (None, False)}
    scores = {r.uid: round(r.logit, 5) for r in R.score(R.vectorize(inst, model), inst, model).collect()}
    assert scores["a"] == batch["a"][0] and scores["b"] == batch["b"][0]

    from cairn.streaming import predict as stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "d.json").write_text("\n".join(map(json.dumps, docs)))
    model.write.parquet(str(tmp_path / "model"))
    run = lambda: stream.start(stream.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "model"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    run()
    shown = lambda: {r.uid: (r.logit, r.is_valid) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert shown() == batch
    (tmp_path / "in" / "e.json").write_text(json.dumps(docs[0] | {"uid": "e"}))
    run()  # only what has arrived since
    assert shown() == batch | {"e": batch["a"]} and spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_a_large_model_is_joined(spark, monkeypatch):
    """Ten thousand terms of two drugs, broadcast or shuffled; repeated documents
    stay rows of their own."""
    n = 10_000
    terms = spark.range(n).select(F.explode(F.array(F.lit("D"), F.lit("E"))).alias("drug"), F.concat(F.lit("g@m"), "id").alias("feature"), F.lit("mutation").alias("kind"), (F.col("id") % 7 - 3).cast("double").alias("coef"))
    model = terms.select("*", F.lit("g").alias("gene"), F.lit("m").alias("mutation"), F.lit(0.0).alias("fill"), F.lit(0.5).alias("mean"), F.lit(2.0).alias("scale"))
    docs = [(f"u{i}", ("lineage1", 5.0), [("g", f"m{k}") for k in range(i, n, 97)]) for i in range(40)] + [("u1", ("lineage1", 5.0), [("g", "m5"), ("g", "m5")]), (None, ("x", 1.0), [])]
    inst = spark.createDataFrame(docs, R.INSTANCE)
    base = -sum((k % 7 - 3) * 0.5 / 2 for k in range(n))
    want = sorted((u, round(base + sum((int(m[1:]) % 7 - 3) / 2 for m in {m for _, m in v}), 5)) for u, _, v in docs if u for _ in "DE")
    for most in (R.BROADCAST_TERMS, 10):
        monkeypatch.setattr(R, "BROADCAST_TERMS", most)
        got = R.predict(inst, model).collect()
        assert sorted((r.uid, r.logit) for r in got if r.is_valid) == want
        assert [(r.uid, r.logit) for r in got if not r.is_valid] == [(None, None)] * 2


def test_tiers(spark):
    rows = [("D", "a", "a", 0.9), ("D", "a", "b", 0.1), ("D", "b", "b", 0.8)]
    df = spark.createDataFrame(rows, "drug string, held_out string, group string, auc double").withColumns({"random_auc": F.lit(0.95), "mean_group_auc": F.lit(0.9)})
    r = E.tier_report(df).first()
    assert (r.n_folds, r.auc, r.tier, r.stability_std, r.inflation_vs_random) == (2, 0.85, "moderate", 0.05, 0.1)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name\n1,x\n2,y\n")
    lookup = release.load_lookup(spark, str(tmp_path / "a.csv"), "code int, name string", {"name": "country", "code": "id"})
    assert [tuple(r) for r in lookup.orderBy("id").collect()] == [("x", 1), ("y", 2)]
    release.write_csv(lookup, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2
    release.export_release({"t": lookup}, str(tmp_path / "rel"))
    assert release.load(spark, str(tmp_path / "rel"), "t").count() == 2
    got = {r.name: r.size for r in release.file_digests(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"a.csv": 18}
    (tmp_path / "big").mkdir()
    for name, size in (("a b.bin", 300_001), ("c.bin", 1)):
        (tmp_path / "big" / name).write_bytes(bytes(i % 251 for i in range(size)))
    for chunk in (1000, 1 << 23):
        got = {r.name: (r.size, r.sha256) for r in release.file_digests(spark, str(tmp_path / "big"), chunk).collect()}
        assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "big").iterdir()}
    found = spark.createDataFrame([("x.parquet.gz", 5, "h"), ("z", 1, "h")], "name string, size long, sha256 string")
    want = spark.createDataFrame([("x.parquet", 9), ("y", 1), ("o", 1)], "name string, size long")
    assert {r.name: r.status for r in release.verify_files(found, want, ["o"]).collect()} == {"x.parquet": "ok", "y": "missing", "o": "optional", "z": "unexpected"}
    (tmp_path / "b.bed").write_text("track x\nchr 0 10\n#c\nchr\t99\t100\n")
    assert [tuple(r) for r in release.read_bed(spark, str(tmp_path / "b.bed")).orderBy("start").collect()] == [(1, 10), (100, 100)]
    kept, lost = release.slim_release({"a": lookup, "b": lookup}, ["a"], {"a": ["country"]})
    assert list(kept) == ["a"] and kept["a"].columns == ["id"] and lost == [("column", "a.country"), ("table", "b")]
    assert release.with_optional(lookup, ["tag"], {"id": "key"}).columns == ["country", "key", "tag"]
    sums = [release.table_checksum(d).first() for d in (lookup, lookup.orderBy(F.desc("id")), lookup.filter("id = 1"))]
    assert sums[0] == sums[1] != sums[2]


def test_deposit(spark, tmp_path):
    marts = spark.createDataFrame([("D1", "none", "u", 1), ("D1", "L1", "u", 1), ("D2", "L1", "v", 0)], "drug string, held_out string, uid string, y int")
    deposit.create_deposit(marts, marts.drop("y"), str(tmp_path / "d"), {"release": "v1"}, {"k": 3}, ["class_filter"])
    table = lambda name: spark.read.parquet(str(tmp_path / "d" / name))
    assert {r.key: r.value for r in table("provenance").collect()}["release"] == "v1" and table("marts_index").count() == 3
    assert table("fe_identity").first().fe_id == deposit.fe_id({"release": "v1"}, {"k": 3}, ["class_filter"])
    assert json.loads(table("selection_manifests").first().producer)["settings"] == {"k": 3}
    assert deposit.open_deposit(spark, str(tmp_path / "d"), "marts", ["D1"], "deployment").count() == 1
    assert deposit.open_deposit(spark, str(tmp_path / "d"), "marts", ["D1", "D2"], "evaluation").count() == 2
    with pytest.raises(ValueError):
        deposit.require_arm(marts, "evaluation")
    a = deposit.fe_id({"n": 1}, {}, ["s"])
    assert a == deposit.fe_id({"n": 1}, {}, ["s"]) != deposit.fe_id({"n": 2}, {}, ["s"]) and a.startswith("fe-")
    assert deposit.mart_id(a, "1") != deposit.mart_id(a, "2")


def test_metrics_flatten(spark):
    doc = json.dumps({"all": {"random": {"auc": 0.9}, "logo": {"auc": 0.7}}})
    got = {r.metric: r.value for r in E.flatten_metrics(spark.createDataFrame([("r", doc)], "run string, manifest string")).collect()}
    assert got == {"all.random.auc": 0.9, "all.logo.auc": 0.7}


def test_entry_registers_queries():
    import __spark_entry__ as entry

    assert len(entry.queries()) > 100 and set(entry.oracle_sql()) <= set(entry.queries())


def test_grade_peels_to_the_end(spark):
    rows = [(f"u{i}{c}", i) for i in range(13) for c in ("abcde" if i == 12 else "a")]
    samples = spark.createDataFrame([("D", u, "R" if i == 12 else "S") for u, i in rows], "drug string, uid string, phenotype string")
    mutations = spark.createDataFrame([("D", u, f"m{k:02}") for u, i in rows for k in range(i + 1)], "drug string, uid string, mutation string")
    got = {r.mutation: (r.prediction, r.round) for r in G.grade(samples, mutations).collect()}
    assert got == {f"m{k:02}": ("S", k) for k in range(12)} | {"m12": ("R", 12)}


def test_no_group_or_feature_is_cut(spark):
    pool = spark.range(5005).select(F.lit("D").alias("drug"), F.lit("g").alias("gene"), F.format_string("m%05d", "id").alias("mutation"))
    cohort = spark.createDataFrame([("D", "u", None, "R"), ("D", "v", "l", "S"), ("E", "u", "l", "S")], "drug string, uid string, lineage string, phenotype string")
    carried = spark.createDataFrame([("u", "g", "m05004"), ("u", "g", "other")], "uid string, gene string, mutation string")
    rows, index = models.design(cohort, carried, pool)
    assert index.count() == 5007
    last = index.filter("mutation = 'm05004'").first().i
    got = {(r.drug, r.uid): (r.lineage, len(r.features.indices), last in r.features.indices, r.features.size, r.weight) for r in rows.collect()}
    assert got == {("D", "u"): ("unknown", 2, True, 5007, 0.75), ("D", "v"): ("l", 1, False, 5007, 0.75), ("E", "u"): ("l", 1, False, 5007, 1.5)}
    groups = spark.range(1005).select(F.format_string("g%04d", "id").alias("g"), F.lit(2).alias("n"), F.lit("D").alias("drug"))
    left = P.leave_one_out(groups, "g", ["n"], ["drug"], groups)
    assert left.count() == 1005 and left.filter("n <> 2008").isEmpty()
    rows = groups.select("g", F.explode(F.array(F.lit(0), F.lit(1))).alias("y"))
    assert len(E.usable_for_logo(rows, "g", 2)) == 1005


def test_numbers_and_sums_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [("ab"[i % 3 == 0], f"u{i:04}", float((i * 37) % 101) if i % 11 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, uid string, v double")
    for per in (7, 1):
        spark.conf.set("spark.sql.shuffle.partitions", per)
        got = ranks.numbered(df, ["g"], [F.col("v"), F.col("uid")], "k").collect()
        for g in "ab":
            own = sorted((r.v is not None, r.v or 0.0, r.uid, r.k) for r in got if r.g == g)
            assert [k for *_, k in own] == list(range(1, len(own) + 1))
        drawn = ranks.by_hash(df, ["g"], 3, "k").collect()
        for g in "ab":
            own = sorted((hashlib.md5(f"{r.uid}|3".encode()).hexdigest(), r.uid, r.k) for r in drawn if r.g == g)
            assert [k for *_, k in own] == list(range(1, len(own) + 1))
        steps = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
        for g in "ab":
            own = sorted(((r.v is not None, r.v or 0.0), r.n, r.s) for r in ranks.running(steps, ["g"], "v", "n", "s").collect() if r.g == g)
            total = 0
            for _, n, s in own:
                total += n
                assert s == total
    whole = ranks.numbered(df, [], [F.col("v"), F.col("uid")], "k").collect()
    assert [r.k for r in sorted(whole, key=lambda r: (r.v is not None, r.v or 0.0, r.uid))] == list(range(1, 1001))
    assert ranks.numbered(df.limit(0), ["g"], [F.col("v")], "k").count() == 0
    plan = lambda n: ranks.numbered(df.limit(n), ["g"], [F.col("v")], "k")._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(10) == plan(1000)  # no plan grows with the rows
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tiles = spark.range(1, 11).select(ranks.tile(F.col("id"), F.lit(10), 4).alias("t"), ranks.tile(F.col("id"), F.lit(3), 4).alias("few")).collect()
    assert [r.t for r in tiles] == [1, 1, 1, 2, 2, 2, 3, 3, 4, 4] and [r.few for r in tiles[:3]] == [1, 2, 3]


def test_one_fit_is_a_fit_of_each_drug(spark):
    """Coefficients of a joint fit against those of each drug alone."""
    rng = random.Random(4)
    rows, carried = [], []
    for d, n in (("D", 150), ("E", 60)):
        for i in range(n):
            on = [f"m{k}" for k in range(4) if rng.random() < 0.4]
            carried += [(f"{d}{i}", "g", m) for m in on]
            rows.append((d, f"{d}{i}", "l", "R" if (("m0" in on) != (rng.random() < 0.2)) else "S"))
    cohort = spark.createDataFrame(rows, "drug string, uid string, lineage string, phenotype string")
    carriage = spark.createDataFrame(carried, "uid string, gene string, mutation string")
    pool = spark.createDataFrame([(d, "g", f"m{k}") for d in "DE" for k in range(4)], "drug string, gene string, mutation string")
    both = {(r.drug, r.mutation): r.coef for r in models.coefficients(*models.design(cohort, carriage, pool)).collect()}
    for d in "DE":
        one = models.coefficients(*models.design(cohort.filter(F.col("drug") == d), carriage, pool.filter(F.col("drug") == d))).collect()
        assert len(one) == 5 and all(abs(r.coef - both[r.drug, r.mutation]) < 0.15 for r in one)
    assert both["D", "m0"] > 1 and both["E", "m0"] > 0.5


def test_a_set_of_features_scores_as_alone(spark):
    from cairn.functions.mutations import CLASSES
    from cairn.plans import analysis_queries as A

    sf = "/root/testdata/sf0.001"
    every = A.set_scored(spark, sf, "lineage", "mut_class", CLASSES).filter("drug LIKE '%@nonsynonymous'")
    only = A.features(spark, sf).filter("mut_class = 'nonsynonymous'")
    drugs = A.cohort(spark, sf).select("drug").distinct()
    alone = A.fold_scored(spark, sf, "lineage", drugs.join(only))
    got = {(r.drug.split("@")[0], r.uid): (r.fold, r.y, r.score) for r in every.collect()}
    assert got == {(r.drug, r.uid): (r.fold, r.y, r.score) for r in alone.collect()} and got


def test_wide_mart(spark, tmp_path):
    """Columns in blocks: any names, in any order, every sample, gene names
    with the separator in them."""
    from cairn.operators import wide

    rng = random.Random(2)
    names = [("D", "g_1", f"m{k}") for k in range(23)] + [("E", "h", f"K{k}.E") for k in range(3)]
    cohort = spark.createDataFrame([(d, f"u{i}", "R") for d in "DE" for i in range(30 if d == "D" else 9)], "drug string, uid string, phenotype string")
    carried = [(f"u{i}", g, m) for i in range(28) for _, g, m in names if rng.random() < 0.2] + [("u0", "other", "x")]
    universe = spark.createDataFrame(names, "drug string, gene string, mutation string")
    at = str(tmp_path / "mart")
    wide.write_wide(cohort, spark.createDataFrame(carried, "uid string, gene string, mutation string"), universe, at, block=5)
    assert {r.block for r in spark.read.parquet(f"{at}/columns").filter("drug = 'D'").collect()} == set(range(5))
    got = wide.read_wide(spark, at, "D")
    assert got.columns == ["uid", *sorted(f"raw__g_1_m{k}" for k in range(23))] and got.count() == 30
    on = {(u, f"raw__{g}_{m}") for u, g, m in carried}
    assert all(r["value"] == ((r["uid"], r["column"]) in on) for r in wide.melted(got).collect())
    some = wide.read_wide(spark, at, "E", ["raw__h_K2.E", "raw__h_K0.E"])
    assert some.columns == ["uid", "raw__h_K2.E", "raw__h_K0.E"] and some.count() == 9
    assert all(r[c] == ((r["uid"], c) in on) for r in some.collect() for c in some.columns[1:])
    with pytest.raises(KeyError):
        wide.read_wide(spark, at, "D", ["raw__h_K0.E"])
    with pytest.raises(ValueError):
        wide.columns_of(spark.createDataFrame([("D", "a_b", "c"), ("D", "a", "b_c")], "drug string, gene string, mutation string"))


def test_multidrug_mart(spark):
    cohort = spark.createDataFrame([("D", "u", "R", "lineage1", "x", 3.0), ("E", "u", "S", "lineage1", "x", 3.0), ("E", "v", "S", None, None, None)], "drug string, uid string, phenotype string, lineage string, country string, tb_depth double")
    carried = spark.createDataFrame([("u", "g", "b"), ("u", "g", "a"), ("u", "g", "a"), ("u", "h", "z"), ("w", "g", "a")], "uid string, gene string, mutation string")
    universe = spark.createDataFrame([("D", "g", "a"), ("E", "g", "a"), ("E", "g", "b")], "drug string, gene string, mutation string")
    got = {(r.drug, r.uid): r for r in M.multidrug_mart(cohort, {"D": "first"}, carried, universe).collect()}
    assert len(got) == 3 and got["D", "u"].features == got["E", "u"].features == ["raw__g_a", "raw__g_b"] and got["E", "v"].features == []
    assert (got["D", "u"].drug_class, got["E", "u"].drug_class, got["D", "u"].y, got["D", "u"].cov__lineage_L1) == ("first", "other", 1, 1)
    assert (got["E", "v"].lineage, got["E", "v"].country, got["E", "v"].cov__lineage_L1) == ("unknown", "", 0)
