"""Queries of serving, sources, deposits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import agreement as A
from cairn.operators import derive as D
from cairn.operators import evaluate as E
from cairn.operators import models as M
from cairn.operators import select as L
from cairn.operators.firth import firth as firth_fit
from cairn.operators import serve as R
from cairn.operators.shared import few, new_path, stored
from cairn.plans import fixtures as X
from cairn.plans.analysis_queries import _EFFECT, _POOL, _Q, _STRATA, _TIER_CTES, _TIERS, _W, T, _folds, corr, counted, effect, scored, totals, votes
from cairn.plans.fixtures import sql
from cairn.plans.held import held
from cairn.plans.registry import query
from cairn.plans.release_queries import CLASSES, carried, carried_features, coded, cohort
from cairn.sources import deposit as P
from cairn.sources import release as S
from cairn.streaming import predict as stream


def instances(s, d):
    return held(s, d, "instances", lambda: R.coded_instances(X.isolates(s, d), *coded(s, d)))


@query("assemble_instances", sql("SELECT uid, lineage, round(tb_depth,4) AS tb_depth, string_agg(gene||'@'||mutation, ';' ORDER BY gene, mutation) AS variants FROM isolates LEFT JOIN carriage USING (uid) GROUP BY ALL", "isolates", "carriage"))
def assemble_instances(s, d):
    docs = R.assemble_instances(X.isolates(s, d), X.mutations(s, d))
    text = F.array_join(F.transform("variants", lambda v: F.concat(v["gene"], F.lit("@"), v["mutation"])), ";")
    return docs.select("uid", "covariates.lineage", F.round("covariates.tb_depth", 4).alias("tb_depth"), F.nullif(text, F.lit("")).alias("variants"))


@query(
    "exemplars",
    sql("SELECT uid, count(*) AS n_mutations FROM mutations WHERE uid IN (SELECT uid FROM mutations WHERE gene='B1') AND uid NOT IN (SELECT uid FROM mutations WHERE gene='B2') GROUP BY uid HAVING count(*) BETWEEN 2 AND 60 ORDER BY uid LIMIT 1", "mutations"),
)
def exemplars(s, d):
    return R.exemplars(X.mutations(s, d), F.col("gene") == "B1", F.col("gene") == "B2", 2, 60)


@query(
    "validate",
    sql(
        """SELECT uid, 'unknown lineage' AS rule FROM isolates WHERE lineage='lineage5' AND dataset <> 'MACHINERY' UNION ALL SELECT uid, 'covariates missing' FROM isolates WHERE dataset='MACHINERY'
  UNION ALL SELECT uid, 'variants missing' FROM isolates WHERE dataset='FURNITURE' UNION ALL SELECT uid, 'variant without mutation' FROM isolates WHERE dataset='HOUSEHOLD' AND uid IN (SELECT uid FROM carriage)""", "isolates", "carriage"),
)
def validate(s, d):
    """Documents of all isolates; those of three segments lose a part."""
    segment = X.isolates(s, d).select("uid", "dataset")
    blank = F.transform("variants", lambda v: F.struct(v["gene"].alias("gene"), F.lit(None).cast("string").alias("mutation")))
    variants = F.when(F.col("dataset") == "FURNITURE", None).when(F.col("dataset") == "HOUSEHOLD", blank).otherwise(F.col("variants"))
    docs = instances(s, d).join(segment, "uid").select("uid", F.when(F.col("dataset") != "MACHINERY", F.col("covariates")).alias("covariates"), variants.alias("variants"))
    return R.validate(R.read_instances(docs.select(F.to_json(F.struct("uid", "covariates", "variants")).alias("value"))))


# Every drug's model in closed form, so that both engines agree: risk weights of its pool's features, their share and
# its deviation; lineages, coverage and the intercept have fixed coefficients.
_REST = ",".join([f"('lineage{i}','lineage',0.0,0.25,0.2,0.4)" for i in range(1, 5)] + ["('tb_depth','coverage',40.0,-0.5,40.0,20.0)", "('intercept','intercept',0.0,-0.5,0.0,1.0)"])
_MODEL = f"""SELECT drug, gene||'@'||mutation AS feature, 'mutation' AS kind, 0.0::DOUBLE AS fill, w AS coef, p AS mean, sqrt(p*(1-p)) AS scale FROM (SELECT *, carriers::DOUBLE/(a+b+c+d) AS p FROM w JOIN t USING (drug, gene, mutation) JOIN po USING (drug, gene, mutation))
  UNION ALL SELECT drug, f, k, l, c, m, z FROM (SELECT DISTINCT drug FROM cohort), (VALUES {_REST}) x(f, k, l, c, m, z)"""
_SERVED = {"t": T, "q": _Q, "po": _POOL, "w": _W, "md": _MODEL}
_NEEDS = ("isolates", "carriage", "cohort", "pairs", "totals", "determinants")
_VECTOR = """SELECT uid, drug, feature, kind, 1.0::DOUBLE AS value FROM carriage JOIN md ON feature = gene||'@'||mutation UNION ALL SELECT uid, drug, feature, kind, 1.0 FROM isolates JOIN md ON kind='lineage' AND feature=lineage
  UNION ALL SELECT uid, drug, feature, kind, tb_depth::FLOAT::DOUBLE FROM isolates JOIN md ON kind='coverage'"""
_LOGIT = f"""SELECT uid, drug, base + sum(coef*value/scale) AS x FROM ({_VECTOR}) JOIN md USING (drug, feature, kind) JOIN (SELECT drug, sum(CASE WHEN kind='intercept' THEN coef ELSE -coef*mean/scale END) AS base FROM md GROUP BY drug) USING (drug) GROUP BY uid, drug, base"""


def model(s, d):
    """One table with all that serving reads, stored once for a release."""
    return held(s, d, "model", lambda: _model(s, d))


def _model(s, d):
    base, counts, candidates = counted(s, d)
    p = stored(L.pairs_of(counts), "pairs")
    t = totals(s, d)
    weights = D.risk_weights(p, t).join(candidates.select("drug", "gene", "mutation"), ["drug", "gene", "mutation"])
    share = p.join(F.broadcast(t), "drug").select("drug", "gene", "mutation", (F.col("carriers") / F.col("n")).alias("mean"))  # a row for each drug
    schema = R.feature_schema(weights, carried_features(s, d), 40.0)
    m = schema.join(weights, ["drug", "gene", "mutation"], "left").join(share, ["drug", "gene", "mutation"], "left")
    is_m, is_l = F.col("kind") == "mutation", F.col("kind") == "lineage"
    pick = lambda a, b, c: F.when(is_m, a).when(is_l, b).otherwise(c)
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")))
    m = m.select("drug", "feature", "kind", "gene", "mutation", "fill", pick(F.col("w"), 0.25, -0.5).alias("coef"), pick(F.col("mean"), 0.2, 40.0).alias("mean"), pick(sd, 0.4, 20.0).alias("scale"))
    none = F.lit(None).cast("string")
    extra = t.select("drug", F.lit("intercept").alias("feature"), F.lit("intercept").alias("kind"), none.alias("gene"), none.alias("mutation"), F.lit(0.0).alias("fill"), F.lit(-0.5).alias("coef"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"))
    return m.unionByName(extra)


@query("vectorize", sql(f"SELECT uid, drug, feature, round(value,3) AS value FROM ({_VECTOR})", *_NEEDS, **_SERVED))
def vectorize(s, d):
    return R.vectorize(instances(s, d), model(s, d)).select("uid", "drug", "feature", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("feature_schema", sql("SELECT drug, feature, kind, fill::DOUBLE AS fill, round(coef+1e-9,5) AS coef FROM md", *_NEEDS, **_SERVED))
def feature_schema(s, d):
    return model(s, d).select("drug", "feature", "kind", F.round("fill", 4).alias("fill"), F.round(F.col("coef") + 1e-9, 5).alias("coef"))


@query("roundtrip", sql("SELECT drug, feature, count(*) AS n_served, count(*) AS n_trained, 0::BIGINT AS n_mismatches FROM carriage JOIN md ON feature = gene||'@'||mutation GROUP BY ALL", *_NEEDS, **_SERVED))
def roundtrip(s, d):
    """What documents, written as JSON and read again, serve of each feature
    against the mart's long form written to a deposit: nothing may differ."""
    m = model(s, d)
    docs = R.read_instances(instances(s, d).select(F.to_json(F.struct("uid", "covariates", "variants")).alias("value")))
    served = stored(R.vectorize(docs, m).filter("kind = 'mutation'").select("uid", "drug", "feature", "value"), "served")
    mart = carried(s, d).join(few(m.filter("kind = 'mutation'").select("drug", "gene", "mutation", "feature")), ["gene", "mutation"])
    trained = stored(mart.select("uid", "drug", "feature", F.lit(1.0).cast("float").alias("value")), "mart")
    key = lambda df: df.select(F.concat_ws("|", "uid", "drug").alias("uid"), "feature", "value")
    wrong = R.roundtrip(key(served), key(trained)).groupBy(F.split_part("uid", F.lit("|"), F.lit(2)).alias("drug"), "feature").agg(F.count(F.lit(1)).alias("n_mismatches"))
    n = lambda df, name: df.groupBy("drug", "feature").agg(F.count(F.lit(1)).alias(name))
    return n(served, "n_served").join(n(trained, "n_trained"), ["drug", "feature"], "full_outer").join(wrong, ["drug", "feature"], "left").na.fill(0)


@query("score_contributions", sql(f"SELECT uid, drug, round(x+1e-9,5) AS logit, round(1/(1+exp(-x))+1e-9,5) AS p_resistant FROM ({_LOGIT})", *_NEEDS, **_SERVED))
def score_contributions(s, d):
    out = R.score_coded(X.isolates(s, d), *coded(s, d), model(s, d))
    return out.select("uid", "drug", *[F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("logit", "p_resistant")])


@query(
    "explain",
    sql(
        f"""SELECT uid, drug, feature, coef, direction, role, row_number() OVER (PARTITION BY uid, drug ORDER BY CASE role WHEN 'primary_driver' THEN 0 WHEN 'co-selected passenger (MDR linkage)' THEN 1 ELSE 2 END, abs(coef) DESC, feature)::INT AS rank
  FROM (SELECT uid, drug, feature, round(coef,3) AS coef, CASE WHEN coef > 0 THEN 'resistance' ELSE 'protective' END AS direction,
      CASE WHEN sig AND (drug, gene) IN (SELECT (drug, gene) FROM determinants) THEN 'primary_driver' WHEN sig AND abs(ate) >= 0.2 THEN 'co-selected passenger (MDR linkage)' ELSE 'weak/lineage-linked passenger' END AS role
    FROM carriage JOIN md ON feature = gene||'@'||mutation LEFT JOIN (SELECT drug, gene, mutation, ate, ci_lower > 0 OR ci_upper < 0 AS sig FROM ({_EFFECT})) USING (drug, gene, mutation))""".replace("FROM carriage JOIN md ON feature = gene||'@'||mutation", "FROM carriage JOIN (SELECT *, split_part(feature,'@',1) AS gene, split_part(feature,'@',2) AS mutation FROM md WHERE kind='mutation') USING (gene, mutation)"),
        *_NEEDS, **_SERVED, s=_STRATA),
)
def explain(s, d):
    m = model(s, d)
    evidence = effect(s, d).select("drug", F.concat("gene", F.lit("@"), "mutation").alias("feature"), "effect_significant", "ate")
    return R.explain(R.vectorize(instances(s, d), m), m, evidence, X.determinants(s))


@query("predict", sql(f"SELECT uid, drug, round(x,5) AS logit, true AS is_valid FROM ({_LOGIT})", *_NEEDS, **_SERVED))
def predict(s, d):
    return R.predict(instances(s, d), model(s, d)).select("uid", "drug", "logit", "is_valid")


@query("predict_stream", sql(f"SELECT uid, drug, round(x,5) AS logit, true AS is_valid FROM ({_LOGIT})", *_NEEDS, **_SERVED))
def predict_stream(s, d):
    """Documents as JSON files, taken in batches of a few files by a stream
    that ends when all are predicted."""
    at = new_path(s, "arriving")
    model(s, d).write.parquet(f"{at}/model")
    instances(s, d).select(F.to_json(F.struct("uid", "covariates", "variants")).alias("value")).repartition(8).write.text(f"{at}/in")
    stream.start(stream.read_stream(s, f"{at}/in", files=3), f"{at}/model", f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").select("uid", "drug", "logit", "is_valid")


@query("class_weights", sql("SELECT drug, phenotype, round(sum(count(*)) OVER (PARTITION BY drug)/(2*count(*)),6) AS weight FROM cohort GROUP BY drug, phenotype", "cohort"))
def class_weights(s, d):
    return M.class_weights(cohort(s, d))


@query("fills", sql("SELECT drug, round(median(tb_depth),6) AS depth_fill FROM cohort GROUP BY drug", "cohort"))
def fills(s, d):
    return M.fills(cohort(s, d))


@query("flatten_metrics", sql("SELECT drug AS run, m AS metric, v AS value FROM (SELECT drug, count(*)::DOUBLE AS n, count(*) FILTER (phenotype='R')::DOUBLE AS r FROM cohort GROUP BY drug), LATERAL (VALUES ('all.logo.n', n), ('all.random.n_r', r)) x(m, v)", "cohort"))
def flatten_metrics(s, d):
    g = cohort(s, d).groupBy("drug").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("phenotype") == "R").alias("r"))
    doc = F.to_json(F.struct(F.struct(F.struct(F.col("n")).alias("logo"), F.struct(F.col("r").alias("n_r")).alias("random")).alias("all")))
    return E.flatten_metrics(g.select(F.col("drug").alias("run"), doc.alias("manifest")))


@query("best_candidate")
def best_candidate(s, d):
    """The closed-form risk score against two fitted models on held-out lineages."""
    from cairn.plans.analysis_queries import fold_scored

    rows, _, drugs, _ = _rows(s, d)
    oof = M.out_of_fold(rows, {"logistic_l2": M.logistic(0.01, 0.0, drugs), "elastic_net": M.logistic(0.01, 0.5, drugs)})
    risk = fold_scored(s, d, "lineage").withColumn("model", F.lit("risk"))
    cols = ["drug", "uid", "y", "score", "model"]
    return E.best_candidate(risk.select(*cols).unionByName(oof.select(*cols)))


_INDEX = "SELECT drug, lineage AS held_out, count(*) AS n_rows, count(*) FILTER (phenotype='R') AS n_r, count(DISTINCT uid) AS n_uid FROM cohort GROUP BY ALL"


def marts(s, d):
    return cohort(s, d).select("drug", F.col("lineage").alias("held_out"), "uid", (F.col("phenotype") == "R").cast("int").alias("y"))


@query("marts_index", sql(_INDEX, "cohort"))
def marts_index(s, d):
    return P.marts_index(marts(s, d))


@query("open_deposit", sql("SELECT drug, lineage AS held_out, uid, (phenotype='R')::INT AS y FROM cohort WHERE drug IN ('D1','D3')", "cohort"))
def open_deposit(s, d):
    """A deposit written to the shared folder, then two drugs of it read back."""
    path = new_path(s, "deposit")
    chosen = carried(s, d).join(F.broadcast(X.determinants(s)), "gene").select("drug", "gene", "mutation", F.lit("none").alias("held_out")).distinct()
    P.create_deposit(marts(s, d), chosen, path, {"release": "v1"}, {"least": 10})
    rows = P.open_deposit(s, path, "marts", ["D1", "D3"], "evaluation")
    return P.require_arm(rows.select("drug", "held_out", "uid", "y"), "evaluation")


@query("deposit_manifest", sql("SELECT drug, 'none' AS held_out, count(DISTINCT (gene, mutation)) AS n_features FROM carriage JOIN determinants USING (gene) GROUP BY drug", "carriage", "determinants"))
def deposit_manifest(s, d):
    path = new_path(s, "deposit")
    chosen = carried(s, d).join(F.broadcast(X.determinants(s)), "gene").select("drug", "gene", "mutation", F.lit("none").alias("held_out")).distinct()
    P.create_deposit(marts(s, d), chosen, path, {"release": "v1"}, {"least": 10})
    return s.read.parquet(f"{path}/selection_manifests").select("drug", "held_out", "n_features")


@query("selections_union", sql("SELECT drug, gene, mutation, 'deployment' AS arm, 'none' AS held_out FROM determinants JOIN carriage USING (gene) GROUP BY ALL UNION ALL SELECT drug, gene, mutation, 'evaluation', 'lineage2' FROM determinants JOIN carriage USING (gene) WHERE gene='B1' GROUP BY ALL", "determinants", "carriage"))
def selections_union(s, d):
    rows = carried(s, d).join(F.broadcast(X.determinants(s)), "gene").select("drug", "gene", "mutation").distinct()
    return P.selections_union([(None, rows), ("lineage2", rows.filter("gene = 'B1'"))])


@query("lookup", "SELECT n_name AS country_name, n_nationkey AS code FROM nation")
def lookup(s, d):
    """A lookup in CSV, its columns projected and renamed as it is read."""
    at = new_path(s, "lookup")
    X.table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("header", True).csv(at)
    return S.load_lookup(s, at, "n_nationkey int, n_name string, n_regionkey int", {"n_name": "country_name", "n_nationkey": "code"})


@query(
    "gff",
    """SELECT 'B'||p_partkey AS gene, p_partkey::INT*10 AS start, p_partkey::INT*10+p_size AS "end", CASE WHEN p_size%5=0 THEN 'PE/PPE' WHEN p_size%7=0 THEN 'insertion seqs and phages' ELSE p_type END AS functional_category, p_type='SMALL' AS is_pseudogene,
  p_type IN ('PROMO','LARGE') AS essential_hint, p_size%5=0 OR p_size%7=0 AS is_hitchhiker_region, CASE WHEN p_size%3=0 THEN 'D1,D'||(p_size%4+2) ELSE '' END AS drug_resistance, CASE WHEN p_size%2=0 THEN 'PF'||p_size ELSE '' END AS pfam FROM part""",
)
def gff(s, d):
    """Annotation lines made of the parts, parsed."""
    p, size, text = X.table(s, d, "part"), F.col("p_size"), lambda t: F.lit(t)
    category = F.when(size % 5 == 0, "PE/PPE").when(size % 7 == 0, "insertion seqs and phages").otherwise(F.col("p_type"))
    attr = F.concat(
        text("Locus=L"), F.col("p_partkey"), text(";Name=B"), F.col("p_partkey"), text(";Functional_Category="), category, text(";Is_Pseudogene="), F.when(F.col("p_type") == "SMALL", "Yes").otherwise("No"),
        text(";Comments="), F.when(F.col("p_type") == "PROMO", "Essential gene").otherwise("nonessential"), F.when(F.col("p_type") == "LARGE", ";Product=an essential kinase").otherwise(""),
        F.when(size % 3 == 0, F.concat(text(";Drug Resistance Mutations=D1,D"), (size % 4 + 2).cast("string"))).otherwise(""), F.when(size % 2 == 0, F.concat(text(";PFAM=PF"), size.cast("string"))).otherwise(""),
    )
    start = F.col("p_partkey") * 10
    line = F.concat_ws("\t", F.lit("chr"), F.lit("src"), F.lit("CDS"), start.cast("string"), (start + F.col("p_size")).cast("string"), F.lit("."), F.lit("+"), F.lit("0"), attr)
    return S.parse_gff(p.select(line.alias("value"))).select("gene", "start", "end", "functional_category", "is_pseudogene", "essential_hint", "is_hitchhiker_region", "drug_resistance", "pfam")


@query("bed", "SELECT p_partkey::INT*10+1 AS start, p_partkey::INT*10+p_size AS \"end\" FROM part")
def bed(s, d):
    p = X.table(s, d, "part")
    start = F.col("p_partkey") * 10
    return S.parse_bed(p.select(F.concat_ws("\t", F.lit("chr"), start.cast("string"), (start + F.col("p_size")).cast("string")).alias("value")))


@query(
    "verify_source",
    """SELECT name, size, found_size, sha256, CASE WHEN found_size IS NULL THEN 'missing' WHEN size IS NULL THEN 'unexpected' WHEN size <> found_size THEN 'size differs' ELSE 'ok' END AS status FROM (SELECT name, CASE WHEN name NOT LIKE '%0' THEN size END AS size, CASE WHEN name NOT LIKE '%5' THEN size + (CASE WHEN name LIKE '%7' THEN 1 ELSE 0 END) END AS found_size,
  CASE WHEN name NOT LIKE '%5' THEN sha256(name) END AS sha256 FROM (SELECT p_name||p_partkey AS name, p_size AS size FROM part))""",
)
def verify_source(s, d):
    """Parts as files: some missing, some unexpected, some of another size."""
    p = X.table(s, d, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("size"))
    found = p.filter("name NOT LIKE '%5'").select("name", (F.col("size") + F.when(F.col("name").like("%7"), 1).otherwise(0)).alias("size"), F.sha2("name", 256).alias("sha256"))
    return S.verify_files(found, p.filter("name NOT LIKE '%0'"))


@query(
    "file_digests",
    """SELECT p_size AS number, sum(strlen(line) + 1)::BIGINT AS size, sha256(string_agg(line || chr(10), '' ORDER BY line)) AS sha256 FROM (SELECT p_size, p_partkey||' '||p_name AS line FROM part) GROUP BY p_size""",
)
def file_digests(s, d):
    """Parts written as a text file for each size, and those files' digests."""
    at = new_path(s, "files")
    lines = X.table(s, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(" "), "p_name").alias("line"), F.col("p_size").alias("number"))
    lines.repartition("number").sortWithinPartitions("number", "line").write.partitionBy("number").text(at)
    found = S.file_digests(s, at)
    return found.select(F.regexp_extract("path", "/number=([0-9]+)/", 1).cast("int").alias("number"), "size", "sha256")


@query("slim_release", sql("SELECT uid, drug, gene, mutation FROM effects", "effects"))
def slim_release(s, d):
    kept, _ = S.slim_release({"effects": X.effects(s, d), "dst": X.dst(s, d)}, ["effects"], {"effects": ["prediction", "catalogue_name", "catalogue_version"]})
    return kept["effects"]


@query("release_metadata", sql("SELECT 'n_'||t AS key, n::VARCHAR AS value FROM (SELECT 'dst' AS t, count(*) AS n FROM dst UNION ALL SELECT 'effects', count(*) FROM effects)", "dst", "effects"))
def release_metadata(s, d):
    n = lambda df, k: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(k).alias("key"), "value")
    return n(X.dst(s, d), "n_dst").unionByName(n(X.effects(s, d), "n_effects"))


@query("table_checksum")
def table_checksum(s, d):
    return S.table_checksum(X.mutations(s, d))


def _rows(s, d):
    """Rows and column index of all drugs' models, and how many drugs."""
    base, counts, candidates = counted(s, d)
    rows, index = M.coded_design(cohort(s, d), *coded(s, d), candidates)
    return rows, index, index.filter("gene IS NULL").count(), L.pairs_of(counts)


def fitted(s, d):
    rows, index, _, p = _rows(s, d)
    return M.deployable(stored(M.coefficients(rows, index), "coefficients"), p, totals(s, d))


@query("train_logistic")
def train_logistic(s, d):
    """Every drug's model as serving reads it."""
    return fitted(s, d)


@query("coefficient_catalogue")
def coefficient_catalogue(s, d):
    return fitted(s, d).filter("kind = 'mutation'").select("drug", "feature", F.round("coef", 4).alias("coef"), "direction").orderBy("drug", F.desc(F.abs("coef")), "feature")


@query("predict_fitted")
def predict_fitted(s, d):
    """Every isolate's documents scored by every drug's fitted model."""
    return R.score_coded(X.isolates(s, d), *coded(s, d), stored(fitted(s, d), "model"))


@query("vote_importance")
def vote_importance(s, d):
    rows, index, _, p = _rows(s, d)
    return M.importance_vote(M.coefficients(rows, index), p, totals(s, d))


@query("concordance_three")
def concordance_three(s, d):
    """All three votes; two of them make a feature concordant."""
    base, counts, candidates = counted(s, d)
    rows, index = M.coded_design(cohort(s, d), *coded(s, d), candidates)
    important = stored(M.importance_vote(M.coefficients(rows, index), L.pairs_of(counts), totals(s, d)), "importance")
    return L.concordance(L.vote_effect(base, counts, candidates), L.vote_residual(base, counts, candidates), important)


@query("variable_importance")
def variable_importance(s, d):
    rows, index, _, _ = _rows(s, d)
    return M.variable_importance(rows, index)


@query("select_cross_model")
def select_cross_model(s, d):
    """Each drug's features in the top 20 of a forest and of a perceptron."""
    rows, index, _, _ = _rows(s, d)
    return A.cross_model(rows, carried(s, d), index)


@query("select_cross_model_held_out")
def select_cross_model_held_out(s, d):
    """Those of either model, neither of which has seen the first lineage."""
    rows, index, _, _ = _rows(s, d)
    return A.cross_model(rows, carried(s, d), index, mode="union", held_out="lineage1")


def _panel(s, d):
    rows, index, drugs, _ = _rows(s, d)
    return M.out_of_fold(rows, M.learners(index.count(), drugs))


@query("model_panel")
def model_panel(s, d):
    return M.leaderboard(_panel(s, d))


@query("stack_weights")
def stack_weights(s, d):
    """All models of the panel, and the four best by pooled AUC."""
    oof = _panel(s, d)
    best = [r["model"] for r in S_auc(oof, ["model"]).orderBy(F.desc("auc"), "model").limit(4).collect()]
    return M.stack(oof, {"full": ["logistic_l2", "elastic_net", "forest", "boosted", "mlp"], "top4": sorted(best)})


def S_auc(scored_rows, by):
    from cairn.operators.stats import auc

    return auc(scored_rows, "score", F.col("y") == 1, by)


@query("nested_logo")
def nested_logo(s, d):
    rows, _, drugs, _ = _rows(s, d)
    return M.nested_logo(rows, [0.001, 0.01], drugs)


@query("surrogate")
def surrogate(s, d):
    """What the best model of each drug's leaderboard says out of fold, as an
    additive model: its largest terms and how much of it they explain."""
    rows, index, drugs, _ = _rows(s, d)
    oof = M.out_of_fold(rows, M.learners(index.count(), drugs))
    best = E.best_candidate(oof).filter("is_best").select("drug", "model")
    return M.surrogate(rows, index, oof.join(F.broadcast(best), ["drug", "model"])).join(F.broadcast(best), "drug")  # a row for each drug


@query("eval_mic")
def eval_mic(s, d):
    """Regressor of the graded phenotype on held-out lineages: rank agreement
    and error, and its AUC for resistance beside a classifier's."""
    from cairn.operators.stats import spearman_rmse

    rows, _, drugs, _ = _rows(s, d)
    graded = X.dst(s, d).groupBy("drug", "uid").agg((F.median("mic") / 1000).alias("value"))
    out = M.graded_regression(rows, graded)
    own = S_auc(out.withColumn("score", F.col("prediction")), ["drug"]).select("drug", F.round("auc", 6).alias("regressor_auc"))
    other = S_auc(M.out_of_fold(rows, {"own": M.logistic(0.01, 0.0, drugs)}), ["drug"]).select("drug", F.round("auc", 6).alias("classifier_auc"))
    return spearman_rmse(out, "label", "prediction", ["drug"]).join(own, "drug").join(other, "drug")


@query("firth")
def firth(s, d):
    """Bias-reduced coefficients of each drug's whole candidate pool."""
    _, _, candidates = counted(s, d)
    return firth_fit(cohort(s, d), carried(s, d), candidates)


@query("transfer_eval")
def transfer_eval(s, d):
    base, counts, candidates = counted(s, d)
    rows, index = M.coded_design(cohort(s, d), *coded(s, d), candidates)
    return M.transfer(rows, *coded(s, d), candidates, CLASSES, index.filter("gene IS NULL").count())


@query("elastic_net_overlap")
def elastic_net_overlap(s, d):
    """The elastic net tuned over both its penalties, and the Jaccard overlap
    of its features with the concordant ones."""
    rows, index, drugs, _ = _rows(s, d)
    best = M.tuned(rows, [(r, l) for r in (0.003, 0.03) for l in (0.2, 0.8)], drugs).first()
    if best is None:
        raise ValueError("no lineage to hold out")
    a = M.coefficients(rows, index, best["reg"], best["l1"]).filter("gene IS NOT NULL AND coef <> 0").select("drug", "gene", "mutation", F.lit(True).alias("a"))
    b = votes(s, d).filter("is_concordant").select("drug", "gene", "mutation", F.lit(True).alias("b"))
    n = a.join(b, ["drug", "gene", "mutation"], "full_outer").groupBy("drug").agg(F.count_if("a").alias("n_net"), F.count_if("b").alias("n_concordant"), F.count_if(F.col("a") & F.col("b")).alias("n_both"), F.count(F.lit(1)).alias("n_any"))
    return n.withColumns({"jaccard": F.round(F.col("n_both") / F.col("n_any"), 6), "reg": F.lit(best["reg"]), "l1": F.lit(best["l1"])})


_CARD = """SELECT drug, sha256(string_agg(term, ';' ORDER BY term)) AS model_sha256, count(*) FILTER (kind <> 'intercept') AS n_features, string_agg(feature, ',' ORDER BY k) FILTER (kind = 'mutation' AND k <= 5) AS largest,
  max(CASE WHEN kind='coverage' THEN fill END) AS depth_fill, count(*) FILTER (gone) AS n_missing, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (gone), '') AS missing
  FROM (SELECT *, feature||'='||floor(coef*1e9+0.5)::BIGINT AS term, kind='mutation' AND feature LIKE '%9\\_del\\_%' ESCAPE '\\' AS gone, row_number() OVER (PARTITION BY drug, kind ORDER BY round(abs(coef),9) DESC, split_part(feature,'@',1), split_part(feature,'@',2)) AS k FROM md) GROUP BY drug"""


@query(
    "model_cards",
    sql(
        f"""SELECT c.*, n, n_r, round(100*n_r/n,1) AS pct_r, auc, tier, stability_std, '{P.fe_id({"release": "v1"}, {"least": 10}, [])}' AS fe_id, 'v1' AS release FROM ({_CARD}) c JOIN (SELECT drug, count(*) AS n, count(*) FILTER (phenotype='R') AS n_r FROM cohort GROUP BY drug) USING (drug)
  LEFT JOIN (SELECT drug, auc, tier, stability_std FROM ({_TIERS})) USING (drug)""",
        *_NEEDS, **{**_SERVED, **_TIER_CTES}),
)
def model_cards(s, d):
    """Cards of the closed-form models, for a mart that lacks some features."""
    m, c = model(s, d), cohort(s, d)
    known = carried_features(s, d).filter("mutation NOT LIKE '%9\\_del\\_%'")
    marts = c.select("drug").distinct().withColumns({"release": F.lit("v1"), "fe_id": F.lit(P.fe_id({"release": "v1"}, {"least": 10}, []))})
    return M.model_cards(m, E.tier_report(_folds(s, d)), c, known, marts)


@query("mlp_sweep")
def mlp_sweep(s, d):
    rows, index, _, _ = _rows(s, d)
    return M.mlp_sweep(rows, index.count())


@query("cv_random")
def cv_random(s, d):
    from cairn.operators.mart import stratified_folds

    rows, _, drugs, _ = _rows(s, d)
    return M.cv_random(rows, M.logistic(0.01, 0.0, drugs), stratified_folds(cohort(s, d), 3, 7), 3)


@query(
    "confounders",
    sql("""SELECT drug, uid, coalesce(x, median(x) OVER (PARTITION BY drug)) AS tb_depth FROM (SELECT drug, uid, CASE WHEN quality <> 'LOW' THEN tb_depth END AS x FROM cohort)""", "cohort"),
)
def confounders(s, d):
    c = cohort(s, d).select("drug", "uid", F.when(F.col("quality") != "LOW", F.col("tb_depth")).alias("tb_depth"))
    return M.impute_confounders(c, ["tb_depth"])
