"""Serving documents: assemble, validate, vectorise, score and explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.carriage import decoded
from cairn.operators.shared import FEW, few, hot_join, in_shuffle, stored

INSTANCE = "uid string, covariates struct<lineage: string, tb_depth: double>, variants array<struct<gene: string, mutation: string>>"
LINEAGES = ("lineage1", "lineage2", "lineage3", "lineage4")
# The roles, first to last, and the least effect of a passenger.
ROLES = ("primary_driver", "co-selected passenger (MDR linkage)", "weak/lineage-linked passenger")
PASSENGER = 0.2


def assemble_instances(isolates: DataFrame, mutations: DataFrame, uids: DataFrame | None = None) -> DataFrame:
    """One nested document per isolate, variants in order; many in one scan."""
    base = isolates if uids is None else isolates.join(uids, "uid", "left_semi")
    rows = (mutations if uids is None else mutations.join(uids, "uid", "left_semi")).select("uid", "gene", "mutation").distinct()
    variants = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("gene", "mutation"))).alias("variants"))
    out = base.select("uid", F.struct("lineage", "tb_depth").alias("covariates")).join(variants, "uid", "left")
    return out.select("uid", "covariates", F.coalesce("variants", F.array().cast("array<struct<gene: string, mutation: string>>")).alias("variants"))


def coded_instances(isolates: DataFrame, codes: DataFrame, features: DataFrame) -> DataFrame:
    """The same of carriage as numbers: names come in within a document's row."""
    none = F.array().cast("array<struct<gene: string, mutation: string>>")
    if features.count() > FEW:
        return assemble_instances(isolates, decoded(codes, features))
    named = features.agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "gene", "mutation"))), lambda x: F.struct(x["gene"].alias("gene"), x["mutation"].alias("mutation"))).alias("names"))
    variants = codes.crossJoin(F.broadcast(named)).select("uid", F.array_sort(F.transform("on", lambda f: F.get("names", f))).alias("variants"))  # one row
    out = isolates.select("uid", F.struct("lineage", "tb_depth").alias("covariates")).join(in_shuffle(variants), "uid", "left")
    return out.select("uid", "covariates", F.coalesce("variants", none).alias("variants"))


def exemplars(mutations: DataFrame, wanted: Column, unwanted: Column, least: int, most: int) -> DataFrame:
    """The first isolate with a wanted mutation, no unwanted one, and a number
    of mutations in the range."""
    n = mutations.groupBy("uid").agg(F.count(F.lit(1)).alias("n_mutations")).filter(F.col("n_mutations").between(least, most))
    out = n.join(mutations.filter(wanted).select("uid").distinct(), "uid", "left_semi").join(mutations.filter(unwanted).select("uid").distinct(), "uid", "left_anti")
    return out.orderBy("uid").limit(1)


def read_instances(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON text to documents; what can't be parsed keeps nulls for `validate`."""
    return raw.select(F.from_json(column, INSTANCE, {"mode": "PERMISSIVE"}).alias("d")).select("d.*")


def validate(instances: DataFrame, lineages: Sequence[str] = LINEAGES) -> DataFrame:
    """(uid, rule) for every rule that a document breaks."""
    v = F.col("variants")
    lineage = F.col("covariates.lineage")
    rules = {
        "uid missing": F.col("uid").isNull() | (F.col("uid") == ""),
        "covariates missing": F.col("covariates").isNull(),
        "unknown lineage": lineage.isNotNull() & ~lineage.isin(list(lineages)),
        "variants missing": v.isNull(),
        "variant without gene": F.coalesce(F.exists(v, lambda x: x["gene"].isNull()), F.lit(False)),
        "variant without mutation": F.coalesce(F.exists(v, lambda x: x["mutation"].isNull()), F.lit(False)),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return instances.select("uid", F.explode(broken).alias("rule"))


NAMES = "array<string>"


def _present() -> Column:
    """Names of what a document has: its variants (an unresolved X call is
    absent), its lineage, and its coverage."""
    on = F.transform(F.filter("variants", lambda x: ~x["mutation"].rlike("[Xx]$")), lambda x: F.concat(x["gene"], F.lit("@"), x["mutation"]))
    return F.array_compact(F.array_distinct(F.concat(F.coalesce(on, F.array().cast(NAMES)), F.array(F.col("covariates.lineage"), F.lit("tb_depth")))))


def vectorize(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, drug, feature, kind, value) of the features of each drug's model
    that are not 0 in a document: mutations and lineage 1, coverage its value or
    the model's fill. Features that are not there are 0, so a document makes as
    many rows as it has features, whatever the model's size: an equality join.
    `model(drug, feature, kind, gene, mutation, fill, coef, mean, scale)`."""
    docs = instances.select("uid", F.col("covariates.tb_depth").alias("depth"), F.explode(_present()).alias("feature"))
    both = docs.join(few(model.filter("kind <> 'intercept'").select("drug", "feature", "kind", "fill")), "feature")
    value = F.when(F.col("kind") == "coverage", F.coalesce("depth", "fill")).otherwise(1.0)
    return both.select("uid", "drug", "feature", "kind", value.cast("float").alias("value"))


def feature_schema(selected: DataFrame, mart_features: DataFrame, fill: float) -> DataFrame:
    """(drug, feature, kind, gene, mutation, fill) of each drug's model: its
    selected features, the lineages and coverage. A feature that the mart lacks
    is an error."""
    gone = selected.join(mart_features, ["gene", "mutation"], "left_anti")
    if not gone.isEmpty():
        raise ValueError(f"features missing in the mart: {gone.limit(5).collect()}")
    m = selected.select("drug", F.concat("gene", F.lit("@"), "mutation").alias("feature"), F.lit("mutation").alias("kind"), "gene", "mutation", F.lit(0.0).alias("fill"))
    rest = [F.struct(F.lit(x).alias("feature"), F.lit("lineage").alias("kind"), F.lit(0.0).alias("fill")) for x in LINEAGES]
    rest.append(F.struct(F.lit("tb_depth").alias("feature"), F.lit("coverage").alias("kind"), F.lit(float(fill)).alias("fill")))
    none = F.lit(None).cast("string")
    extra = selected.select("drug").distinct().select("drug", F.inline(F.array(*rest))).withColumns({"gene": none, "mutation": none})
    return m.unionByName(extra)


def roundtrip(served: DataFrame, trained: DataFrame) -> DataFrame:
    """Values that differ between what is served and what was trained on."""
    both = served.select("uid", "feature", F.col("value").alias("served")).join(trained.select("uid", "feature", F.col("value").alias("trained")), ["uid", "feature"], "full_outer")
    return both.filter(~F.col("served").eqNullSafe(F.col("trained")))


def contributions(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """coef * value / scale of each feature that is not 0; a missing value
    counts as the mean. What centring takes off is in `bases`."""
    v = vectors.select("uid", "drug", "feature", "value").join(few(model.select("drug", "feature", "kind", "coef", "mean", "scale")), ["drug", "feature"])
    return v.select("uid", "drug", "feature", "kind", (F.col("coef") * F.coalesce(F.col("value").cast("double"), "mean") / F.col("scale")).alias("contribution"), "value")


def bases(model: DataFrame) -> dict[str, float]:
    """Each drug's score of a document whose features are all 0."""
    term = F.when(F.col("kind") == "intercept", F.col("coef")).otherwise(-F.col("coef") * F.col("mean") / F.col("scale"))
    return {r["drug"]: r["b"] for r in model.groupBy("drug").agg(F.sum(term).alias("b")).orderBy("drug").collect()}


def score(vectors: DataFrame, instances: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, drug, logit, p_resistant) of every document and drug."""
    base = F.array(*[F.struct(F.lit(k).alias("drug"), F.lit(float(v)).alias("base")) for k, v in bases(model).items()])  # a row for each drug
    every = instances.select("uid", F.inline(base))
    sums = contributions(vectors, model).groupBy("uid", "drug").agg(F.sum("contribution").alias("x"))
    out = every.join(sums, ["uid", "drug"], "left").select("uid", "drug", (F.col("base") + F.coalesce("x", F.lit(0.0))).alias("logit"))
    return out.withColumn("p_resistant", 1 / (1 + F.exp(-F.col("logit"))))


def _weights(model: DataFrame, drugs: Sequence[str]) -> DataFrame:
    """(feature, w0, w1, ...), stored: what having a feature adds for each of `drugs`."""
    own = [F.sum(F.when(F.col("drug") == d, F.col("coef") / F.col("scale"))).alias(f"w{k}") for k, d in enumerate(drugs)]
    return stored(model.filter("kind NOT IN ('intercept', 'coverage')").groupBy("feature").agg(*own), "terms")


def _scored(sums: DataFrame, model: DataFrame, base: dict[str, float]) -> DataFrame:
    """(uid, drug, logit, p_resistant) of `sums(uid, depth, w0, w1, ...)`, the drugs those of `base`."""
    covered = {r["drug"]: r for r in model.filter("kind = 'coverage' AND feature = 'tb_depth'").collect()}  # a row for each drug

    def of_depth(drug: str) -> Column:
        if drug not in covered:
            return F.lit(0.0)
        r = covered[drug]
        value = F.coalesce("depth", F.lit(r["fill"]).cast("double")).cast("float").cast("double")
        return F.lit(r["coef"]) * F.coalesce(value, F.lit(r["mean"])) / F.lit(r["scale"])

    each = [F.struct(F.lit(d).alias("drug"), (F.lit(float(b)) + F.col(f"w{k}") + of_depth(d)).alias("logit")) for k, (d, b) in enumerate(base.items())]
    return sums.select("uid", F.inline(F.array(*each))).withColumn("p_resistant", 1 / (1 + F.exp(-F.col("logit"))))


def score_documents(instances: DataFrame, model: DataFrame) -> DataFrame:
    """`score` of what `vectorize` makes of the documents, without a row for
    each drug and feature: a feature has its weight for every drug in one row,
    a document's sums are made once, and only they are dealt."""
    base = bases(model)  # a number for each drug
    on = instances.select("uid", F.col("covariates.tb_depth").alias("depth"), F.explode(_present()).alias("feature"))
    fixed = _weights(model, list(base)).withColumn("hit", F.lit(True))
    hits = on.join(few(fixed), "feature", "left").filter("hit OR feature = 'tb_depth'")  # a document has a row, whatever it carries
    sums = hits.groupBy("uid").agg(F.max("depth").alias("depth"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(len(base))])
    return _scored(sums, model, base)


def score_coded(isolates: DataFrame, codes: DataFrame, features: DataFrame, model: DataFrame) -> DataFrame:
    """`score_documents` of the documents that `coded_instances` makes, which
    are not spelt out: a feature's weights are looked up by its number within
    an isolate's row, and only sums are dealt. Uids are distinct."""
    names = stored(features.select("f", F.when(~F.col("mutation").rlike("[Xx]$"), F.concat("gene", F.lit("@"), "mutation")).alias("feature")), "names")
    n = names.agg(F.count(F.lit(1)).alias("all"), F.count("feature").alias("named"), F.count_distinct("feature").alias("distinct")).first()
    if n["all"] > FEW or n["named"] > n["distinct"]:  # a name of two features counts once in a document
        return score_documents(coded_instances(isolates, codes, features), model)
    base = bases(model)  # a number for each drug
    ws, fixed = [f"w{k}" for k in range(len(base))], _weights(model, list(base))
    zero = F.lit(0.0)
    in_order = F.array_sort(F.collect_list(F.struct("f", *[F.coalesce(w, zero).alias(w) for w in ws])))
    line = names.join(few(fixed), "feature", "left").agg(in_order.alias("line")).select(*[F.col(f"line.{w}").alias(f"_{w}") for w in ws])

    def of(w: str) -> Column:
        return F.aggregate("on", zero, lambda x, f: x + F.get(f"_{w}", f)).alias(f"_{w}")

    carried = codes.crossJoin(F.broadcast(line)).select("uid", *[of(w) for w in ws])  # one row
    of_lineage = few(fixed).withColumnRenamed("feature", "lineage")
    docs = isolates.select("uid", "lineage", F.col("tb_depth").alias("depth")).join(of_lineage, "lineage", "left").join(in_shuffle(carried), "uid", "left")
    sums = docs.select("uid", "depth", *[(F.coalesce(w, zero) + F.coalesce(f"_{w}", zero)).alias(w) for w in ws])
    return _scored(sums, model, base)


def explain(vectors: DataFrame, model: DataFrame, evidence: DataFrame, determinants: DataFrame) -> DataFrame:
    """Fired mutations of each document and drug with role and order: primary
    drivers, then co-selected passengers, then weak ones, by coefficient.
    `evidence(drug, feature, effect_significant, ate)`."""
    key = ["drug", "feature"]
    rows = vectors.filter("kind = 'mutation' AND value > 0").select("uid", *key).join(model.select(*key, "coef"), key)
    rows = rows.join(evidence.select(*key, "effect_significant", "ate"), key, "left").withColumn("gene", F.split_part("feature", F.lit("@"), F.lit(1)))
    rows = rows.join(F.broadcast(determinants.select("drug", "gene", F.lit(True).alias("known"))), ["drug", "gene"], "left")  # curated genes
    sure, known = F.coalesce("effect_significant", F.lit(False)), F.coalesce("known", F.lit(False))
    held = [sure & known, sure & (F.abs("ate") >= PASSENGER), F.lit(True)]
    role = F.coalesce(*[F.when(c, name) for c, name in zip(held, ROLES, strict=True)])
    out = rows.select("uid", *key, F.round("coef", 3).alias("coef"), F.when(F.col("coef") > 0, "resistance").otherwise("protective").alias("direction"), role.alias("role"))
    order = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role"))
    w = Window.partitionBy("uid", "drug").orderBy(order, F.desc(F.abs("coef")), "feature")
    return out.withColumn("rank", F.row_number().over(w))


#: Features of a model that are broadcast, at most.
BROADCAST_TERMS = 100_000


def _terms_met(on: DataFrame, model: DataFrame) -> DataFrame:
    """`on(feature, ...)` with `terms`, what each drug's model has for the
    feature. A model that is too large to be broadcast meets the documents'
    features in a shuffle, where the frequent ones are broadcast alone."""
    term = F.struct("drug", "kind", "fill", "coef", "mean", "scale")
    terms = stored(model.filter("kind <> 'intercept'").groupBy("feature").agg(F.collect_list(term).alias("terms")), "terms")  # a term for each drug
    if terms.count() <= BROADCAST_TERMS:
        return on.join(F.broadcast(terms), "feature")
    on = stored(on, "present")
    sizes = on.groupBy("feature").agg(F.count(F.lit(1)).alias("_n"))
    return hot_join(on, stored(terms.join(sizes, "feature"), "terms"), ["feature"], "_n").drop("_n")


def predict(instances: DataFrame, model: DataFrame) -> DataFrame:
    """(uid, drug, logit, p_resistant, is_valid) of every document and drug;
    documents that break a rule have no score. Documents that repeat a uid are
    rows of their own. The model is a table that documents are joined with; the
    driver sees one number for each drug."""
    docs = stored(instances.select("*", F.monotonically_increasing_id().alias("_doc")), "documents")
    valid = ~(F.col("uid").isNull() | F.col("covariates").isNull() | F.col("variants").isNull())
    on = docs.filter(valid).select("_doc", F.col("covariates.tb_depth").alias("depth"), F.explode(_present()).alias("feature"))
    hits = _terms_met(on, model).select("_doc", "depth", F.inline("terms"))
    depth = F.coalesce("depth", "fill", "mean").cast("float").cast("double")
    value = F.when(F.col("kind") == "coverage", depth).otherwise(1.0)
    sums = hits.groupBy("_doc", "drug").agg(F.sum(F.col("coef") * value / F.col("scale")).alias("x"))
    base = F.array(*[F.struct(F.lit(k).alias("drug"), F.lit(float(v)).alias("base")) for k, v in bases(model).items()])  # a row for each drug
    every = docs.select("_doc", "uid", valid.alias("is_valid"), F.inline(base.cast("array<struct<drug: string, base: double>>")))
    out = every.join(sums, ["_doc", "drug"], "left")
    x = F.when(F.col("is_valid"), F.col("base") + F.coalesce("x", F.lit(0.0)))
    return out.select("uid", "drug", F.round(x, 5).alias("logit"), F.round(1 / (1 + F.exp(-x)), 5).alias("p_resistant"), "is_valid")
