"""Queries over the release: views, integrity, cohorts and the mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import carriage as K
from cairn.operators import cohort as C
from cairn.operators import integrity as V
from cairn.operators import mart as M
from cairn.operators import wide as W
from cairn.operators.shared import few, new_path
from cairn.plans import fixtures as X
from cairn.plans.fixtures import sql
from cairn.plans.held import held
from cairn.plans.registry import query

DRUGS = ["D1", "D2", "D3", "D4", "D5"]


def made_cohort(s: SparkSession, d: str) -> DataFrame:
    rows = held(s, d, "tested", lambda: X.tested(s, d, carried(s, d)).select("uid", "ck", "d", "carrier"))
    return C.cohort(X.phenotypes(s, d, rows), X.predictions(s, d, rows), X.isolates(s, d), X.CATALOGUE, X.VERSION)


def cohort(s: SparkSession, d: str) -> DataFrame:
    return held(s, d, "cohort", lambda: made_cohort(s, d))


def coded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Carriage as numbers, and the parts' features that they stand for."""
    features = held(s, d, "numbers", lambda: K.numbered_features(X.parts(s, d)))
    return held(s, d, "coded", lambda: X.coded_carriage(s, d, features)), features


def carried(s: SparkSession, d: str) -> DataFrame:
    return K.decoded(*coded(s, d))


def carried_features(s: SparkSession, d: str) -> DataFrame:
    """(gene, mutation) that some isolate carries, a row each."""

    def made() -> DataFrame:
        on, features = coded(s, d)
        return on.select(F.explode("on").alias("f")).distinct().join(features, "f").select(*K.FEATURE)

    return held(s, d, "features", made)


def gathered(s: SparkSession, d: str) -> DataFrame:
    return held(s, d, "gathered", lambda: K.gathered(carried(s, d)))


def labelled(s: SparkSession, d: str) -> DataFrame:
    return K.labelled(cohort(s, d), gathered(s, d))


def pairs(s: SparkSession, d: str, by: tuple[str, ...] = ()) -> DataFrame:
    def made() -> DataFrame:
        on, features = coded(s, d)
        rows = cohort(s, d).select("uid", "drug", *by, (F.col("phenotype") == "R").cast("int").alias("y"))
        n = K.coded_counts(rows, on, ["drug", *by]).join(few(features), "f")
        return n.select("drug", *K.FEATURE, *by, F.col("n1").alias("carriers"), F.col("r1").alias("carriers_r"))

    return held(s, d, "-".join(("pairs", *by)), made)


@query("fx_isolates", sql("SELECT * FROM isolates", "isolates"))
def fx_isolates(s, d):
    return X.isolates(s, d)


@query("fx_mutations", sql("SELECT uid, gene, mutation, round(frs,6) AS frs, coverage, is_minor FROM mutations", "mutations"))
def fx_mutations(s, d):
    return X.mutations(s, d).withColumn("frs", F.round("frs", 6))


@query("fx_phenotypes", sql("SELECT * FROM phenotypes", "phenotypes"))
def fx_phenotypes(s, d):
    return X.phenotypes(s, d)


@query("unique_check", sql("SELECT uid, drug, count(*) AS n_rows, uid IS NULL OR drug IS NULL AS has_null FROM dst GROUP BY ALL HAVING count(*) > 1 OR has_null", "dst"))
def unique_check(s, d):
    return V.key_faults(X.dst(s, d), ["uid", "drug"])


@query("row_id")
def row_id(s, d):
    return V.with_row_id(X.effects(s, d), ["uid", "gene", "mutation"])


@query(
    "catalogues",
    sql(
        """SELECT catalogue_name, catalogue_version::INT AS catalogue_version, count(*) FILTER (src='e') AS n_effects, count(*) FILTER (src='p') AS n_predictions
  FROM (SELECT catalogue_name, catalogue_version, 'e' AS src FROM effects UNION ALL SELECT catalogue_name, catalogue_version, 'p' FROM predictions) GROUP BY 1, 2""",
        "effects",
        "predictions",
    ),
)
def catalogues(s, d):
    return V.catalogues(X.effects(s, d), X.predictions(s, d))


_COVERAGE = """SELECT uid, coalesce(w,false) AS in_wgs, coalesce(x,false) AS in_dst, uid IN (SELECT uid FROM mutations) AS has_mutations, uid IN (SELECT uid FROM phenotypes) AS has_phenotypes
  FROM (SELECT DISTINCT uid, true AS w FROM isolates) FULL JOIN (SELECT DISTINCT uid, true AS x FROM dst) USING (uid)"""


def _coverage(s, d):
    anchors = {"wgs": X.isolates(s, d), "dst": X.dst(s, d)}
    return V.sample_coverage(anchors, {"mutations": X.mutations(s, d), "phenotypes": X.phenotypes(s, d)})


@query("sample_coverage", sql(_COVERAGE, "isolates", "dst", "mutations", "phenotypes"))
def sample_coverage(s, d):
    return _coverage(s, d)


@query(
    "population_overlap",
    sql(
        "SELECT count(*) FILTER (in_wgs) AS n_a, count(*) FILTER (in_dst) AS n_b, count(*) FILTER (in_wgs AND in_dst) AS n_both, count(*) AS n_all FROM c",
        "isolates", "dst", "mutations", "phenotypes", c=_COVERAGE,
    ),
)
def population_overlap(s, d):
    return V.population_overlap(_coverage(s, d), "in_wgs", "in_dst")


@query(
    "sample_fanout",
    sql(
        """SELECT 'mutations' AS table_name, uid, count(*) AS n_rows FROM mutations GROUP BY uid UNION ALL SELECT 'dst', uid, count(*) FROM dst GROUP BY uid
  UNION ALL SELECT 'effects', uid, count(*) FROM effects GROUP BY uid""", "mutations", "dst", "effects"),
)
def sample_fanout(s, d):
    return V.sample_fanout({"mutations": X.mutations(s, d), "dst": X.dst(s, d), "effects": X.effects(s, d)})


def _children(s, d):
    """lineitem with null part keys where l_linenumber = 3, and parts without every 50th."""
    li = X.table(s, d, "lineitem").withColumn("p_partkey", F.when(F.col("l_linenumber") != 3, F.col("l_partkey")))
    return li, X.table(s, d, "part").filter("p_partkey % 50 <> 0")


@query("ri_orphans", "SELECT l_orderkey, l_linenumber, l_partkey AS p_partkey FROM lineitem WHERE l_linenumber <> 3 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)")
def ri_orphans(s, d):
    child, parent = _children(s, d)
    return V.orphans(child, parent, ["p_partkey"]).select("l_orderkey", "l_linenumber", "p_partkey")


@query("ri_codes", "SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_linenumber <> 3 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)")
def ri_codes(s, d):
    return V.orphan_codes(*_children(s, d), "p_partkey")


@query(
    "ri_composite",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem a WHERE NOT EXISTS
  (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'N' AND a.l_orderkey=b.l_orderkey AND a.l_partkey=b.l_partkey AND a.l_suppkey=b.l_suppkey)""",
)
def ri_composite(s, d):
    li = X.table(s, d, "lineitem")
    return V.orphans(li, li.filter("l_returnflag = 'N'"), ["l_orderkey", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


_SUMMARY = """SELECT 'mutations.part' AS check_name, count(*) FILTER (l_linenumber <> 3 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 50 <> 0)) AS n_orphans,
    count(*) FILTER (l_linenumber = 3) AS n_null_keys FROM lineitem
  UNION ALL SELECT 'events.customer', count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)), 0 FROM events
  UNION ALL SELECT 'labels.documents', count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)), 0 FROM labels"""


def _summary(s, d):
    events = X.table(s, d, "events").withColumnRenamed("user_id", "c_custkey")
    return V.union(
        [
            V.ri_check("mutations.part", *_children(s, d), ["p_partkey"]),
            V.ri_check("events.customer", events, X.table(s, d, "customer").filter("c_custkey % 7 <> 0"), ["c_custkey"]),
            V.ri_check("labels.documents", X.table(s, d, "labels"), X.table(s, d, "documents"), ["doc_id"]),
        ]
    )


@query("ri_summary", f"SELECT * FROM ({_SUMMARY}) ORDER BY n_orphans DESC, check_name")
def ri_summary(s, d):
    return _summary(s, d).orderBy(F.desc("n_orphans"), "check_name")


@query(
    "ri_gate",
    f"""SELECT scope, count(*) AS n_checks, count(*) FILTER (n_orphans > 0) AS n_failed, count(*) FILTER (n_orphans > 0 AND scope = 'analysis') AS n_blocking
  FROM (SELECT *, CASE WHEN split_part(check_name,'.',1) IN ('mutations','labels') THEN 'analysis' ELSE 'peripheral' END AS scope FROM ({_SUMMARY})) GROUP BY scope""",
)
def ri_gate(s, d):
    return V.integrity_gate(_summary(s, d), ["mutations", "labels"])


@query("fill_rate", sql("SELECT 'frs' AS column_name, count(frs) AS n_filled, count(*) AS n_rows FROM mutations UNION ALL SELECT 'coverage', count(coverage), count(*) FROM mutations", "mutations"))
def fill_rate(s, d):
    return V.fill_rate(X.mutations(s, d), ["frs", "coverage"])


@query(
    "genotype_label",
    sql("SELECT c.uid, c.drug, phenotype, gene, mutation FROM cohort c JOIN mutations m USING (uid) WHERE quality = 'HIGH' AND frs >= 0.95", "cohort", "mutations"),
)
def genotype_label(s, d):
    good = cohort(s, d).filter("quality = 'HIGH'").select("uid", "drug", "phenotype")
    return good.join(X.mutations(s, d).filter("frs >= 0.95").select("uid", "gene", "mutation"), "uid")


@query(
    "call_vs_dst",
    sql(
        """SELECT p.drug, prediction, coalesce(phenotype,'none') AS phenotype, count(*) AS n FROM predictions p JOIN dst d ON p.uid=d.uid AND p.drug=d.drug
  WHERE catalogue_version=1 GROUP BY ALL""", "predictions", "dst"),
)
def call_vs_dst(s, d):
    called = X.predictions(s, d).filter("catalogue_version = 1")
    return called.join(X.dst(s, d), ["uid", "drug"]).groupBy("drug", "prediction", F.coalesce("phenotype", F.lit("none")).alias("phenotype")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "growth_layout",
    """SELECT l_returnflag AS design, p_type AS well_drug, p_size AS dilution, count(*) AS n, round(min(p_retailprice), 2) AS conc FROM lineitem JOIN part ON l_partkey = p_partkey AND l_suppkey % 10 = p_size % 10 GROUP BY ALL""",
)
def growth_layout(s, d):
    li = X.table(s, d, "lineitem").withColumn("k", F.col("l_suppkey") % 10)
    p = X.table(s, d, "part").withColumn("k", (F.col("p_size") % 10).cast("long")).withColumnRenamed("p_partkey", "l_partkey")
    out = li.join(p, ["l_partkey", "k"]).groupBy(F.col("l_returnflag").alias("design"), F.col("p_type").alias("well_drug"), F.col("p_size").alias("dilution"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("p_retailprice"), 2).alias("conc"))


@query(
    "feature_frame",
    sql(
        """SELECT uid, gene, mutation FROM carriage JOIN (SELECT gene, mutation FROM carriage GROUP BY ALL ORDER BY count(DISTINCT uid) DESC, gene, mutation LIMIT 20) USING (gene, mutation)""",
        "carriage"),
)
def feature_frame(s, d):
    c = carried(s, d)
    top = c.groupBy("gene", "mutation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gene", "mutation").limit(20)
    return c.join(F.broadcast(top.drop("n")), ["gene", "mutation"]).select("uid", "gene", "mutation")


@query("cohort", sql("SELECT * FROM cohort", "cohort"))
def cohort_query(s, d):
    return made_cohort(s, d)


@query(
    "per_drug_summary",
    sql(
        """SELECT drug, count(*) AS n, count(*) FILTER (phenotype='R') AS n_r, count(*) FILTER (phenotype<>'R') AS n_s, round(100*count(*) FILTER (phenotype='R')/count(*), 2) AS pct_r,
  count(*) FILTER (phenotype='S' AND prediction='R') AS catalogue_fp, count(*) FILTER (phenotype='R' AND prediction='S') AS catalogue_fn FROM cohort GROUP BY drug""", "cohort"),
)
def per_drug_summary(s, d):
    return C.per_drug_summary(cohort(s, d))


@query("catalogue_errors", sql("SELECT drug, count(*) FILTER (phenotype='S' AND prediction='R') AS catalogue_fp, count(*) FILTER (phenotype='R' AND prediction='S') AS catalogue_fn FROM cohort GROUP BY drug", "cohort"))
def catalogue_errors(s, d):
    return C.per_drug_summary(cohort(s, d)).select("drug", "catalogue_fp", "catalogue_fn")


@query("per_drug_lineage", sql("SELECT drug, lineage, count(*) AS n, count(*) FILTER (phenotype='R') AS n_r FROM cohort WHERE lineage IS NOT NULL GROUP BY ALL", "cohort"))
def per_drug_lineage(s, d):
    return C.per_drug_lineage(cohort(s, d))


@query(
    "cohort_drug",
    sql("SELECT uid, drug, phenotype, quality, prediction, lineage, sublineage, round(tb_depth,4) AS tb_depth, CASE WHEN tb_depth > 20 THEN country END AS country, NULL::VARCHAR AS dataset FROM (SELECT c.*, i.sublineage AS own FROM cohort c JOIN isolates i USING (uid)) WHERE drug = 'D2'", "cohort", "isolates"),
)
def cohort_drug(s, d):
    """One drug's cohort from a release whose samples have no data set and are
    missing for isolates of low depth: every isolate stays."""
    iso = X.isolates(s, d)
    samples = iso.filter("tb_depth > 20").select("uid", "country")
    rows, absent = C.drug_cohort(X.phenotypes(s, d), X.predictions(s, d), iso.select("uid", "lineage", "sublineage", "tb_depth"), samples, X.CATALOGUE, X.VERSION, "D2")
    assert absent == ["dataset", "tb_coverage"]
    return rows.withColumn("tb_depth", F.round("tb_depth", 4))


@query("cohort_counts", sql("SELECT count(*) AS n_rows, count(DISTINCT uid) AS n_uid, count(DISTINCT drug) AS n_drug FROM cohort", "cohort"))
def cohort_counts(s, d):
    return C.cohort_counts(cohort(s, d))


@query("tag_cohort", sql("SELECT DISTINCT uid FROM isolates WHERE dataset = 'BUILDING'", "isolates"))
def tag_cohort(s, d):
    return C.tag_cohort(X.isolates(s, d), "dataset", "BUILDING")


_RESOLVED = """SELECT uid, drug, count(DISTINCT phenotype) AS n_distinct, CASE WHEN count(DISTINCT phenotype)=1 THEN min(phenotype) END AS phenotype
  FROM dst WHERE phenotype IN ('R','S') GROUP BY uid, drug"""


@query("phenotype_resolved", sql(_RESOLVED, "dst"))
def phenotype_resolved(s, d):
    return C.resolve_phenotype(C.phenotype_source("dst", dst=X.dst(s, d), plate=X.phenotypes(s, d)))


@query("phenotype_conflicts", sql("SELECT drug, count(*) AS n, count(*) FILTER (n_distinct=2) AS n_conflicts FROM r GROUP BY drug", "dst", r=_RESOLVED))
def phenotype_conflicts(s, d):
    return C.resolve_phenotype(X.dst(s, d)).groupBy("drug").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_distinct") == 2).alias("n_conflicts"))


@query("phenotype_source_plate", sql("SELECT uid, drug, 1::BIGINT AS n_distinct, phenotype FROM phenotypes", "phenotypes"))
def phenotype_source_plate(s, d):
    return C.resolve_phenotype(C.phenotype_source("plate", dst=X.dst(s, d), plate=X.phenotypes(s, d)))


_CM = "SELECT DISTINCT uid, gene||'@'||mutation AS mutation FROM mutations WHERE gene IN ('B1','B6') AND uid IN (SELECT uid FROM isolates WHERE dataset='BUILDING') AND frs >= 0.9"


def _cm(s, d):
    return C.cohort_mutations(X.mutations(s, d), tag_cohort(s, d), ["B1", "B6"], 0.9)


@query("cohort_mutations", sql(_CM, "mutations"))
def cohort_mutations(s, d):
    return _cm(s, d)


@query(
    "cohort_report",
    sql(
        """SELECT (SELECT count(*) FROM t) AS n_cohort, count(DISTINCT uid) AS n_phenotyped_any, count(*) FILTER (drug='D1') AS n_phenotyped, count(*) FILTER (drug='D1' AND phenotype='R') AS n_r,
  count(*) FILTER (drug='D1' AND phenotype='S') AS n_s, count(*) FILTER (drug='D1' AND phenotype IS NULL) AS n_conflicts, (SELECT count(*) FROM t) - 300 AS delta FROM r WHERE uid IN (SELECT uid FROM t)""",
        "dst", r=_RESOLVED, t="SELECT DISTINCT uid FROM isolates WHERE dataset='BUILDING'"),
)
def cohort_report(s, d):
    return C.cohort_report(tag_cohort(s, d), C.resolve_phenotype(X.dst(s, d)), "D1", 300)


# Default rules and their calls.
RULES = [("*=", "S"), ("-*_indel", "U"), ("*_indel", "U"), ("-*?", "U"), ("*?", "U"), ("del_0.0", "U")]
_RULES = ",".join(f"('{a}','{b}')" for a, b in RULES)


@query("wildcards", sql(f"SELECT g||'@'||p AS mutation, c AS prediction FROM (SELECT DISTINCT split_part(mutation,'@',1) AS g FROM m), (VALUES {_RULES}) r(p, c)", "mutations", m=_CM))
def wildcards(s, d):
    return C.wildcards(_cm(s, d), RULES)


@query("carriers", sql("SELECT * FROM carriage", "carriage"))
def carriers(s, d):
    return K.carriage(X.mutations(s, d))


_ELIGIBLE = "SELECT p.* FROM pairs p JOIN totals USING (drug) WHERE carriers BETWEEN 10 AND floor(0.5*n)"


def eligible(s, d):
    return K.eligible(pairs(s, d), K.totals(cohort(s, d)), 10, 0.5)


@query("eligible", sql(_ELIGIBLE, "pairs", "totals"))
def eligible_query(s, d):
    return eligible(s, d)


_TOP = "SELECT drug, gene, mutation, carriers, carriers_r FROM (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY carriers DESC, gene, mutation) AS k FROM e) WHERE k <= 20"


@query("top_universe", sql(_TOP, "pairs", "totals", e=_ELIGIBLE))
def top_universe(s, d):
    return K.top_n(eligible(s, d), 20, F.desc("carriers"))


_SEEDED = f"SELECT drug, gene, mutation FROM ({_TOP}) UNION SELECT drug, gene, mutation FROM e JOIN determinants USING (drug, gene)"


def seeded(s, d):
    e = eligible(s, d)
    return K.seeded(K.top_n(e, 20, F.desc("carriers")), e, X.determinants(s))


@query("seeded_universe", sql(_SEEDED, "pairs", "totals", "determinants", e=_ELIGIBLE))
def seeded_universe(s, d):
    return seeded(s, d)


@query("feature_long", sql(f"SELECT c.drug, uid, gene||'_'||mutation AS feature FROM cohort c JOIN carriage k USING (uid) JOIN ({_SEEDED}) u USING (drug, gene, mutation)", "cohort", "pairs", "totals", "determinants", e=_ELIGIBLE))
def feature_long(s, d):
    return K.feature_long(carried(s, d), seeded(s, d), cohort(s, d))


@query("gene_flags", sql("SELECT DISTINCT uid, gene FROM carriage", "carriage"))
def gene_flags(s, d):
    return K.gene_flags_coded(*coded(s, d))


def _even(df):
    """Means rounded, ties upwards whatever the order of the sum."""
    return df.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean_frs", "mean_coverage")})


@query("raw_summary", sql("SELECT uid, count(*) AS n_mutations, round(avg(frs)+1e-9,6) AS mean_frs, round(avg(coverage)+1e-9,6) AS mean_coverage, count(*) FILTER (is_minor) AS n_minor FROM mutations GROUP BY uid", "mutations"))
def raw_summary(s, d):
    return _even(M.raw_summary(X.mutations(s, d)))


_COUNTS = "SELECT uid, drug, " + ", ".join(f"count(*) FILTER (prediction='{c}') AS n_{c.lower()}" for c in "RSUF") + " FROM effects GROUP BY uid, drug"


@query("cat_counts", sql(_COUNTS, "effects"))
def cat_counts(s, d):
    return M.cat_counts(X.effects(s, d))


@query(
    "coresist",
    sql(
        "SELECT a.uid, " + ", ".join(f"max(CASE WHEN b.drug='{x}' THEN (b.phenotype='R')::INT END) AS coresist_{x}" for x in DRUGS[1:])
        + ", count(*) FILTER (b.phenotype='R') AS n_coresist FROM cohort a LEFT JOIN cohort b ON a.uid=b.uid AND b.drug<>'D1' WHERE a.drug='D1' GROUP BY a.uid", "cohort"),
)
def coresist(s, d):
    return M.coresist(cohort(s, d), "D1", DRUGS)


@query("median_mic", sql("SELECT uid, drug, median(mic) AS median_mic FROM dst GROUP BY uid, drug", "dst"))
def median_mic(s, d):
    return M.median_mic(X.dst(s, d))


_CORE = (
    "SELECT uid, drug, (phenotype='R')::INT AS y, " + ", ".join(f"(coalesce(lineage,'')='lineage{i}')::INT AS lineage_l{i}" for i in range(1, 5))
    + ", coalesce(lineage,'unknown') AS lineage, coalesce(country,'') AS country, quality='HIGH' AS is_high_quality, tb_depth>30 AS is_deep, quality='HIGH' AND tb_depth>30 AS is_train_eligible FROM cohort"
)


@query("core", sql(_CORE, "cohort"))
def core(s, d):
    return M.core(cohort(s, d))


@query(
    "mart_core",
    sql(
        f"""SELECT c.*, coalesce(n_mutations,0) AS n_mutations, mean_frs, mean_coverage, coalesce(n_minor,0) AS n_minor, coalesce(n_r,0) AS n_r, coalesce(n_s,0) AS n_s, coalesce(n_u,0) AS n_u, coalesce(n_f,0) AS n_f
  FROM ({_CORE}) c LEFT JOIN (SELECT uid, count(*) AS n_mutations, round(avg(frs)+1e-9,6) AS mean_frs, round(avg(coverage)+1e-9,6) AS mean_coverage, count(*) FILTER (is_minor) AS n_minor FROM mutations GROUP BY uid) s USING (uid)
  LEFT JOIN ({_COUNTS}) e USING (uid, drug)""", "cohort", "mutations", "effects"),
)
def mart_core(s, d):
    return _even(M.assemble(M.core(cohort(s, d)), M.raw_summary(X.mutations(s, d)), M.cat_counts(X.effects(s, d))))


_LONG = f"SELECT c.drug, uid, 'raw__'||gene||'_'||mutation AS \"column\" FROM cohort c JOIN carriage k USING (uid) JOIN ({_SEEDED}) u USING (drug, gene, mutation)"


def _wide(s, d, what):
    """`what` of every drug's wide mart, its seeded universe written in blocks
    and read by name, with the drug; a plan has a block's columns."""
    path = new_path(s, "wide")
    c = cohort(s, d)
    W.write_wide(c, carried(s, d), seeded(s, d), path, block=60)
    blocks = {}
    for r in s.read.parquet(f"{path}/columns").orderBy("drug", "column").collect():  # the columns of the mart
        blocks.setdefault((r["drug"], r["block"]), []).append(r["column"])
    out = None
    for (drug, _), names in blocks.items():
        part = what(W.read_wide(s, path, drug, names)).select(F.lit(drug).alias("drug"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("mart_wide", sql(_LONG, "cohort", "carriage", "pairs", "totals", "determinants", e=_ELIGIBLE))
def mart_wide(s, d):
    """The ones of all drugs' wide marts: the long form again."""
    return _wide(s, d, W.melted).filter("value = 1").select("drug", "uid", "column")


@query(
    "mart_wide_columns",
    sql(f"SELECT u.drug, 'raw__'||gene||'_'||mutation AS \"column\", (SELECT count(*) FROM cohort c WHERE c.drug=u.drug) AS n_cells, (SELECT count(*) FROM lo WHERE lo.drug=u.drug AND lo.\"column\"='raw__'||gene||'_'||mutation) AS n_ones FROM ({_SEEDED}) u", "cohort", "carriage", "pairs", "totals", "determinants", e=_ELIGIBLE, lo=_LONG),
)
def mart_wide_columns(s, d):
    """Cells and ones of each column: every sample has a cell."""
    return _wide(s, d, W.column_sums).select("drug", "column", "n_cells", "n_ones")


@query("mart_down_cast", sql("SELECT uid, coalesce(has,0)::TINYINT AS has, coalesce(n,0)::SMALLINT AS n FROM isolates LEFT JOIN (SELECT uid, 1 AS has, count(*) AS n FROM carriage GROUP BY uid) USING (uid)", "isolates", "carriage"))
def mart_down_cast(s, d):
    n = carried(s, d).groupBy("uid").agg(F.lit(1).alias("has"), F.count(F.lit(1)).alias("n"))
    return M.down_cast(X.isolates(s, d).select("uid").join(n, "uid", "left"), ["has"], ["n"])


_STRATIFIED = "SELECT drug, uid, phenotype, ((row_number() OVER (PARTITION BY drug, phenotype ORDER BY md5(uid||'|7'), uid) - 1) % 5)::INT AS fold FROM cohort"


@query("folds_stratified", sql(_STRATIFIED, "cohort"))
def folds_stratified(s, d):
    return M.stratified_folds(cohort(s, d), 5, 7)


@query("fold_counts", sql("SELECT drug, fold, phenotype, count(*) AS n FROM f GROUP BY ALL", "cohort", f=_STRATIFIED))
def fold_counts(s, d):
    return M.fold_counts(M.stratified_folds(cohort(s, d), 5, 7))


@query("folds_group", sql("SELECT drug, uid, phenotype, CASE WHEN lineage IN ('lineage1','lineage2','lineage3','lineage4') THEN right(lineage,1)::INT-1 ELSE 4 END AS fold FROM cohort", "cohort"))
def folds_group(s, d):
    return M.group_folds(cohort(s, d), "lineage", [f"lineage{i}" for i in range(1, 5)])


@query(
    "folds_stratified_group",
    sql("SELECT uid, n_r, ((row_number() OVER (PARTITION BY n_r ORDER BY md5(uid||'|7'), uid) - 1) % 5)::INT AS fold FROM (SELECT uid, count(*) FILTER (phenotype='R') AS n_r FROM cohort GROUP BY uid)", "cohort"),
)
def folds_stratified_group(s, d):
    return M.stratified_group_folds(cohort(s, d), 5, 7)


@query("multidrug_profile", sql("SELECT drug, count(*) AS n, round(100*count(*) FILTER (phenotype='R')/count(*),1) AS pct_r FROM cohort GROUP BY drug", "cohort"))
def multidrug_profile(s, d):
    return M.profile(cohort(s, d))


CLASSES = {"D1": "first line", "D2": "first line", "D3": "second line"}


_UNION = f"SELECT DISTINCT gene, mutation FROM ({_SEEDED})"


@query(
    "multidrug_mart",
    sql(
        f"""SELECT uid, drug, CASE WHEN drug IN ('D1','D2') THEN 'first line' WHEN drug='D3' THEN 'second line' ELSE 'other' END AS drug_class, (phenotype='R')::INT AS y, coalesce(lineage,'unknown') AS lineage, coalesce(country,'') AS country,
  {", ".join(f"coalesce((lineage='lineage{k}')::INT,0) AS cov__lineage_L{k}" for k in range(1, 5))}, round(tb_depth::FLOAT::DOUBLE,4) AS tb_depth, coalesce(n,0) AS n_features, coalesce(features,'') AS features
  FROM cohort LEFT JOIN (SELECT uid, count(*) AS n, string_agg('raw__'||gene||'_'||mutation, ',' ORDER BY 'raw__'||gene||'_'||mutation) AS features FROM carriage JOIN ({_UNION}) USING (gene, mutation) GROUP BY uid) USING (uid)""",
        "cohort", "carriage", "pairs", "totals", "determinants", e=_ELIGIBLE),
)
def multidrug_mart(s, d):
    """All drugs' rows with the union of their universes as features."""
    out = M.multidrug_mart(cohort(s, d), CLASSES, carried(s, d), seeded(s, d))
    return out.select(*[c for c in out.columns if c not in ("features", "tb_depth")], F.round(F.col("tb_depth").cast("double"), 4).alias("tb_depth"), F.size("features").cast("long").alias("n_features"), F.array_join("features", ",").alias("features"))


@query(
    "multidrug_mart_folds",
    sql(
        """SELECT fold, drug, count(*) AS n, sum((phenotype='R')::INT)::BIGINT AS n_r FROM cohort JOIN (SELECT uid, ((row_number() OVER (PARTITION BY n_r ORDER BY md5(uid||'|7'), uid) - 1) % 5)::INT AS fold
  FROM (SELECT uid, count(*) FILTER (phenotype='R') AS n_r FROM cohort GROUP BY uid)) USING (uid) GROUP BY ALL""", "cohort"),
)
def multidrug_mart_folds(s, d):
    """Rows and resistant ones of each fold: an isolate's rows share a fold."""
    mart = M.multidrug_mart(cohort(s, d), CLASSES, carried(s, d), seeded(s, d))
    folds = M.stratified_group_folds(cohort(s, d), 5, 7).select("uid", "fold")
    return mart.join(folds, "uid").groupBy("fold", "drug").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_r"))


_COLUMNS = """SELECT DISTINCT 'raw__'||gene||'_'||mutation AS column_name FROM carriage UNION ALL SELECT DISTINCT 'cat__n_per_mut_'||prediction FROM effects UNION ALL SELECT DISTINCT 'cov__coresist_'||drug FROM cohort
  UNION ALL SELECT DISTINCT 'cov__lineage_L'||right(lineage,1) FROM cohort UNION ALL SELECT DISTINCT 'y__'||phenotype FROM cohort UNION ALL SELECT 'cov__country' FROM cohort GROUP BY 1"""


@query(
    "leakage_boundary",
    sql(
        f"""SELECT column_name, column_name LIKE 'raw\\_\\_%' ESCAPE '\\' AS in_de_novo, column_name[1:5] IN ('raw__','cat__') AS in_models, column_name[1:5] IN ('raw__','cat__') OR column_name LIKE 'cov%' AND column_name NOT IN ('cov__country') AS in_all FROM ({_COLUMNS})""",
        "carriage", "effects", "cohort"),
)
def leakage_boundary(s, d):
    """Every column of the mart and which feature sets may read it: those of
    evaluation with a lineage held out, `all` without."""
    c = cohort(s, d)
    name = lambda df, prefix, col: df.select(F.concat(F.lit(prefix), col).alias("column_name"))
    parts = [
        name(carried(s, d), "raw__", F.concat("gene", F.lit("_"), "mutation")), name(X.effects(s, d), "cat__n_per_mut_", F.col("prediction")), name(c, "cov__coresist_", F.col("drug")),
        name(c, "cov__lineage_L", F.right("lineage", F.lit(1))), name(c, "y__", F.col("phenotype")), c.select(F.lit("cov__country").alias("column_name")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    x = F.col("column_name")
    return every.distinct().select(x, M.in_feature_set(x, "de_novo", True).alias("in_de_novo"), M.in_feature_set(x, "models", True).alias("in_models"), M.in_feature_set(x, "all", False).alias("in_all"))
