"""Tables with a row for each sample: dealt in shuffles, met once for all sets."""

from pyspark.sql import functions as F

from cairn.operators import carriage as K
from cairn.operators import grading as G
from cairn.operators import wide
from cairn.operators.shared import stored


def plan(df):
    return df._jdf.queryExecution().toString()


def test_samples_are_not_broadcast(spark):
    """However small their files are, graded samples meet in a shuffle."""
    n = spark.range(2000)
    samples = stored(n.select(F.lit("D").alias("drug"), F.col("id").cast("string").alias("uid"), F.lit("R").alias("phenotype")))
    mutations = stored(n.select(F.lit("D").alias("drug"), F.col("id").cast("string").alias("uid"), F.lit("g@m").alias("mutation")))
    solos = G.solo_counts(samples, mutations)
    assert "BroadcastHashJoin" not in plan(solos) and [tuple(r) for r in solos.collect()] == [("D", "g@m", 2000, 2000)]


def test_cells_are_not_broadcast_and_sum_by_column(spark, tmp_path):
    cohort = spark.createDataFrame([("D", f"u{i}") for i in range(9)], "drug string, uid string")
    carried = spark.createDataFrame([(f"u{i}", "g", f"m{i % 3}") for i in range(7)], "uid string, gene string, mutation string")
    universe = spark.createDataFrame([("D", "g", f"m{k}") for k in range(4)], "drug string, gene string, mutation string")
    at = str(tmp_path / "mart")
    wide.write_wide(cohort, carried, universe, at, block=3)
    own = wide.read_wide(spark, at, "D")
    assert "BroadcastHashJoin" not in plan(own)
    assert {tuple(r) for r in wide.column_sums(own).collect()} == {("raw__g_m0", 9, 3), ("raw__g_m1", 9, 2), ("raw__g_m2", 9, 2), ("raw__g_m3", 9, 0)}


def test_gathered_carriage_is_the_long_form(spark):
    cohort = spark.createDataFrame([("D", "u", "l", "l.1", "R"), ("E", "u", "l", "l.1", "S"), ("D", "v", "l", "l.1", "S")], "drug string, uid string, lineage string, sublineage string, phenotype string")
    carried = spark.createDataFrame([("u", "g", "a"), ("u", "g", "b"), ("w", "g", "a")], "uid string, gene string, mutation string")
    long, on = K.labelled(cohort, carried), K.labelled(cohort, K.gathered(carried)).select(K.labelled(cohort, carried).columns)
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, on.collect())) and long.count() == 4


def test_sets_and_regimes_share_one_pass(spark):
    """Scores of two regimes at once are those of either alone."""
    from cairn.plans import analysis_queries as A

    sf = "/root/testdata/sf0.001"
    sets = A.features(spark, sf).select("gene", "mutation", F.lit("all").alias("set"))
    both = A.chosen_scored(spark, sf, ["random", "lineage"], sets, ["all", "none"])
    for regime in ("random", "lineage"):
        got = {(r.drug, r.uid): (r.fold, r.y, r.score) for r in both.filter(F.col("regime") == regime).collect()}
        alone = {(f"{r.drug}@all", r.uid): (r.fold, r.y, r.score) for r in A.fold_scored(spark, sf, regime).collect()}
        assert alone and {k: v for k, v in got.items() if k[0].endswith("@all")} == alone
        assert all(v[2] == 0 for k, v in got.items() if k[0].endswith("@none")) and len(got) == 2 * len(alone)


def small(spark):
    rows = [("D", "u", "l", "a", 1), ("E", "u", None, "a", 0), ("D", "v", "l", "b", 0), ("D", "w", "l", "b", 1)]
    strata = spark.createDataFrame(rows, "drug string, uid string, lineage string, stratum string, y int")
    carried = spark.createDataFrame([("u", "g", "x"), ("u", "h", "y"), ("v", "g", "x"), ("w", "g", None), ("w", "g", "z"), ("z", "g", "x")], "uid string, gene string, mutation string")
    return strata, carried


def test_counts_by_numbers_are_those_by_names(spark):
    from cairn.operators import select as L

    strata, carried = small(spark)
    codes, features = K.coded(carried)
    assert sorted(map(str, K.decoded(codes, features).collect())) == sorted(map(str, carried.collect()))
    want = L.counts(strata, carried)
    got = L.coded_counts(strata, codes, features).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 7


def test_a_task_gathers_no_more_rows_of_more(spark, monkeypatch):
    monkeypatch.setattr(K, "GATHERED_ROWS", 100)
    rows = spark.range(1000).select((F.col("id") % 50).alias("ck"), F.col("id").cast("int").alias("f"))
    out = K.gathered_codes(rows, "ck", 1000)
    assert "REPARTITION_BY_NUM" in plan(out) and out.rdd.getNumPartitions() == 10 and {len(r.on) for r in out.collect()} == {20}


def test_gene_flags_deal_no_rows(spark, monkeypatch):
    _, carried = small(spark)
    codes, features = K.coded(carried)
    flags = K.gene_flags_coded(codes, features)
    own = flags._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(uid" not in own
    want = sorted(map(tuple, K.gene_flags(carried).collect()))
    assert sorted(map(tuple, flags.collect())) == want
    monkeypatch.setattr(K, "FEW", 1)
    assert sorted(map(tuple, K.gene_flags_coded(codes, features).collect())) == want


def test_scores_by_numbers_are_those_by_names(spark):
    from cairn.operators import derive as D

    strata, carried = small(spark)
    cohort = strata.select("drug", "uid", "lineage", F.when(F.col("y") == 1, "R").otherwise("S").alias("phenotype"))
    weights = spark.createDataFrame([("D", "g", "x", 0.25), ("D", "h", "y", 0.5), ("E", "g", "x", -1.0)], "drug string, gene string, mutation string, w double")
    got = D.coded_score(cohort, *K.coded(carried), weights)
    assert sorted(map(str, got.collect())) == sorted(map(str, D.risk_score(cohort, carried, weights).collect()))


def test_documents_meet_a_small_model_without_a_shuffle(spark):
    from cairn.operators import serve as R

    isolates = spark.createDataFrame([("u", "lineage1", 3.0), ("v", "lineage2", None), ("n", None, 1.0)], "uid string, lineage string, tb_depth double")
    carried = spark.createDataFrame([("u", "g", "m"), ("u", "g", "a"), ("v", "g", "m")], "uid string, gene string, mutation string")
    docs = R.coded_instances(isolates, *K.coded(carried))
    assert sorted(map(str, docs.collect())) == sorted(map(str, R.assemble_instances(isolates, carried).collect()))
    terms = [("D", "g@m", "mutation", 0.0, 1.0, 0.5, 2.0), ("E", "g@m", "mutation", 0.0, 3.0, 0.5, 1.0), ("D", "tb_depth", "coverage", 40.0, 0.5, 1.0, 1.0), ("D", "intercept", "intercept", 0.0, 1.0, 0.0, 1.0)]
    model = stored(spark.createDataFrame(terms, "drug string, feature string, kind string, fill double, coef double, mean double, scale double"))
    vectors = R.vectorize(stored(docs), model)
    assert "SortMergeJoin" not in plan(vectors)
    assert sorted((r.uid, r.drug, r.feature, r.value) for r in vectors.collect()) == [("n", "D", "tb_depth", 1.0), ("u", "D", "g@m", 1.0), ("u", "D", "tb_depth", 3.0), ("u", "E", "g@m", 1.0), ("v", "D", "g@m", 1.0), ("v", "D", "tb_depth", 40.0), ("v", "E", "g@m", 1.0)]


def test_equal_rows_fit_as_one(spark):
    """Six copies of each isolate: fits see each once, and are the same."""
    import random

    import numpy as np
    from pyspark.ml.classification import GBTClassifier

    from cairn.operators import models as M

    rng = random.Random(3)
    isolates = [(f"u{i}", f"l{i % 3}", {m for m in "abcde" if rng.random() < 0.4}) for i in range(90)]
    cohort = spark.createDataFrame([("D", f"{u}-{k}", x, "R" if ("a" in on) != (rng.random() < 0.1) else "S") for u, x, on in isolates for k in range(6)], "drug string, uid string, lineage string, phenotype string")
    carried = spark.createDataFrame([(f"{u}-{k}", "g", m) for u, _, on in isolates for k in range(6) for m in on], "uid string, gene string, mutation string")
    rows, _ = M.design(cohort, carried, spark.createDataFrame([("D", "g", m) for m in "abcde"], "drug string, gene string, mutation string"))
    once = M.merged(rows)
    assert rows.count() == 540 and once.count() < 200 and abs(once.agg(F.sum("weight")).first()[0] - rows.agg(F.sum("weight")).first()[0]) < 1e-6
    net = M.logistic(0.01, 0.5)
    assert np.allclose(net.fit(once).coefficients.toArray(), net.fit(rows).coefficients.toArray(), atol=1e-5)
    trees = GBTClassifier(maxIter=3, maxDepth=3, seed=7, weightCol="weight")
    a, b = (M.fit_score(trees)(train, rows).select("uid", "score") for train in (once, rows))
    assert a.join(b.withColumnRenamed("score", "other"), "uid").filter(F.abs(F.col("score") - F.col("other")) > 1e-9).isEmpty()
    assert M.takes_merged(trees) and M.takes_merged(net) and not M.takes_merged(M.learners(6)["forest"]) and not M.takes_merged(M.learners(6)["mlp"])


def test_sums_of_fold_scores_stay_in_their_task(spark, monkeypatch):
    """Rows are dealt by isolate once, however many sums; one without carriage has a row too."""
    from cairn.plans import analysis_queries as A

    base = stored(spark.createDataFrame([(d, f"u{i}", 1, "l") for d in "DE" for i in range(50)], "drug string, uid string, y int, lineage string"))
    codes = stored(spark.createDataFrame([(f"u{i}", [0, 1]) for i in range(40)], "uid string, on array<int>"))
    monkeypatch.setattr(A, "SUMMED_ROWS", 20)
    met = A._met(base, codes, ["drug", "uid", "y", "lineage"])
    assert met.count() == 2 * (40 * 2 + 10) and met.filter("f IS NULL").count() == 20 and met.rdd.getNumPartitions() == 5
    own = met.groupBy("drug", "uid", "y", "lineage").agg(F.sum("f"))
    executed = own._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 2 and "BroadcastHashJoin" not in executed


def test_scores_by_numbers_are_those_of_documents(spark, monkeypatch):
    """No document is spelt out and no row made for a feature: sums of weights looked up by number are those of the documents."""
    from cairn.operators import serve as R

    isolates = spark.createDataFrame([("u", "lineage1", 3.3), ("v", "lineage2", None), ("n", None, 1.0), ("x", "lineage1", 2.0)], "uid string, lineage string, tb_depth double")
    on = [("u", "g", "m"), ("u", "g", "a"), ("u", "g", "tX"), ("v", "g", "m"), ("v", "h", "tX"), ("x", "g", None), ("x", None, "m"), ("x", "g", "a")]
    terms = [("D", "g@m", "mutation", 0.0, 1.0, 0.5, 2.0), ("E", "g@m", "mutation", 0.0, 3.0, 0.5, 1.0), ("E", "g@a", "mutation", 0.0, -0.7, 0.5, 1.0), ("E", "lineage1", "lineage", 0.0, 0.25, 0.2, 0.4), ("D", "tb_depth", "coverage", 40.0, 0.5, 1.0, 1.5), ("D", "h@tX", "mutation", 0.0, 9.0, 0.5, 1.0), ("D", "gone@m", "mutation", 0.0, 5.0, 0.5, 1.0)]
    terms += [(d, "intercept", "intercept", 0.0, c, 0.0, 1.0) for d, c in (("D", 1.0), ("E", 0.0), ("F", -1.0))]
    model = spark.createDataFrame(terms, "drug string, feature string, kind string, fill double, coef double, mean double, scale double")
    of = lambda df: {(r.uid, r.drug): (round(r.logit, 9), round(r.p_resistant, 9)) for r in df.collect()}

    def both(rows):
        carried = stored(spark.createDataFrame(rows, "uid string, gene string, mutation string"))
        codes, features = K.coded(carried)
        want = of(R.score_documents(R.assemble_instances(isolates, carried), model))
        got = R.score_coded(isolates, codes, features, model)
        assert len(want) == 12 and of(got) == want
        return plan(got)

    assert "Generate explode" not in both(on)
    assert "Generate explode" in both([*on, ("x", "g@m", "b"), ("x", "g", "m@b")])  # two features of one name
    monkeypatch.setattr(R, "FEW", 1)
    assert "Generate explode" in both(on)


def test_scoring_stores_no_documents(spark):
    from cairn.plans import held as H
    from cairn.plans.service_queries import score_contributions

    sf = "/root/testdata/sf0.001"
    H._HELD.pop((spark.sparkContext.applicationId, sf, "instances"), None)
    assert score_contributions(spark, sf).count() > 0
    assert (spark.sparkContext.applicationId, sf, "instances") not in H._HELD


def test_pairs_of_features_and_groups_are_counted_without_rows(spark, monkeypatch):
    """However many pairs a task counts at once."""
    rows = spark.range(200).select(F.col("id").cast("string").alias("uid"), F.explode(F.array(F.lit("D"), F.lit("E"), F.lit(None))).alias("drug"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    rows = stored(rows.withColumn("y", F.when(F.col("uid") != "7", F.col("y"))))  # an unknown label counts nowhere
    codes = stored(spark.range(250).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") % 10 > 0, F.sequence(F.lit(0), (F.col("id") % 10).cast("int"))).otherwise(F.array().cast("array<int>")).alias("on")))
    flat = rows.filter("y IS NOT NULL").join(codes, "uid").select("drug", "y", F.explode("on").alias("f"))
    want = sorted(map(str, flat.groupBy("drug", "f").agg(F.count(F.lit(1)).alias("n1"), F.sum("y").alias("r1")).collect()))
    for most in (1, 17, 2_000_000):
        monkeypatch.setattr(K, "TALLIED_PAIRS", most)
        got = K.coded_counts(rows, codes, ["drug"])
        assert "Generate" not in plan(got) and sorted(map(str, got.collect())) == want and len(want) == 30
