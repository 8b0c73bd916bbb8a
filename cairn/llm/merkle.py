"""A Merkle manifest of a dataset as a content-addressed DAG.

Each tree (a source) has its rows as leaves, by id; runs of 16 consecutive
digests become the digest of their concatenation until one, the subroot, is
left, and the subroots, by source, become the root in the same way. What is
kept are records digest -> children. A proof needs no position but the leaf's
rank: requests go down from the root by the rank's digits to base 16, and at
each record gather the children that they do not take. All requests below a
node go down as one row. The gathered segments, in reverse, are the proof.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import salted_join, stored, unused
from cairn.operators.ranks import numbered

FAN = 16  #: children of a node, at most
BITS = 4  #: of a rank's digit
BROADCAST_RECORDS = 10_000  #: records of a level that are broadcast, at most: 1 kB each
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, `:`, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


@dataclass
class Forest:
    """Trees of one table of leaves. `levels[k - 1]` holds the nodes of level k
    (tree, rank, digest, children, n, the number of its tree's nodes there),
    `roots` a row (tree, height, digest) for each tree, `sizes[k - 1]` the
    number of nodes of level k."""

    levels: list[DataFrame]
    roots: DataFrame
    sizes: list[int]

    def records(self, level: int) -> DataFrame:
        """`digest` and `children`; equal nodes are one record."""
        return self.levels[level - 1].groupBy("digest").agg(F.first("children").alias("children"))


def grow(leaves: DataFrame) -> Forest:
    """The trees over `leaves`: tree (not null), rank (from 0 without gaps),
    digest, n (leaves of the tree). Stored: each level reads the one below."""
    levels, sizes = [], []
    roots = leaves.filter("n = 1").select("tree", F.lit(0).alias("height"), "digest")
    now = leaves
    while now.filter("n > 1").limit(1).count():
        runs = now.filter("n > 1").groupBy("tree", F.shiftright("rank", BITS).alias("rank"), F.ceil(F.col("n") / FAN).alias("n"))
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda x: x["digest"])  # 16 at most
        nodes = runs.agg(children.alias("children")).withColumn("digest", F.sha2(F.concat_ws("", "children"), 256))
        now = stored(nodes, "merkle")
        levels.append(now)
        sizes.append(now.count())
        roots = roots.unionByName(now.filter("n = 1").select("tree", F.lit(len(levels)).alias("height"), "digest"))
    return Forest(levels, stored(roots, "roots"), sizes)


@dataclass
class Manifest:
    """`leaves` (tree, rank, digest, n and other columns), the sources' trees,
    the tree of their subroots (rank and tree of each) and the root."""

    leaves: DataFrame
    trees: Forest
    subroots: DataFrame
    top: Forest
    root: str | None

    def records(self) -> DataFrame:
        """All records of the manifest, the smallest part that proofs need."""
        out = None
        for forest in (self.trees, self.top):
            for k in range(len(forest.levels)):
                out = forest.records(k + 1) if out is None else out.unionByName(forest.records(k + 1))
        return out if out is None else out.dropDuplicates(["digest"])


def build(leaves: DataFrame, order: Sequence[str]) -> Manifest:
    """The manifest of `leaves`: tree, digest, and the columns `order` that
    rank the leaves of a tree, nulls first. A tree may hold any share of them;
    they are ranked by ranges. Stored, and read twice."""
    ranked = numbered(leaves, ["tree"], [F.col(c) for c in order], "rank").withColumn("rank", F.col("rank") - 1)
    ranked = stored(ranked, "ranked")
    sizes = ranked.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    few = sizes.count() <= BROADCAST_RECORDS
    ranked = stored(ranked.join(F.broadcast(sizes), "tree") if few else salted_join(ranked, sizes, "tree", "rank"), "leaves")
    trees = grow(ranked.select("tree", "rank", "digest", "n"))
    subroots = stored(numbered(trees.roots, [], [F.col("tree")], "rank").withColumn("rank", F.col("rank") - 1), "subroots")
    top = grow(subroots.select(F.lit("").alias("tree"), "rank", "digest", F.lit(subroots.count()).cast("long").alias("n")))
    root = top.roots.first()
    return Manifest(ranked, trees, subroots, top, root and root["digest"])


def _down(forest: Forest, level: int, nodes: DataFrame) -> DataFrame:
    """`nodes` (digest, path, other columns), of `level`, with `children`."""
    records = forest.records(level)
    if forest.sizes[level - 1] <= BROADCAST_RECORDS:
        return nodes.join(F.broadcast(records), "digest")
    return salted_join(stored(nodes, "frontier"), records, "digest", "rank")


def _taken(digit: Column) -> list[Column]:
    """The child at `digit`, and `path` with what stands beside it."""
    beside = F.struct(
        F.array_join(F.slice("children", F.lit(1), digit), "").alias("left"),
        F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "").alias("right"),
    )
    return [F.get("children", digit).alias("digest"), F.concat("path", F.array(beside)).alias("path")]


def _step(forest: Forest, level: int, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """From `level` to the one below, where a request is: `wanted` has the
    (tree, rank) of nodes there."""
    asked = wanted.groupBy("tree", F.shiftright("rank", BITS).alias("rank")).agg(F.collect_set((F.col("rank") % FAN).cast("int")).alias("digits"))
    rows = _down(forest, level, nodes).join(asked, ["tree", "rank"]).withColumn("digit", F.explode("digits"))
    keep = [c for c in nodes.columns if c not in ("digest", "path", "rank")]
    return rows.select(*keep, (F.col("rank") * FAN + F.col("digit")).alias("rank"), *_taken(F.col("digit")))


_PATH = "array<struct<left: string, right: string>>"


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The proof of each of `requests`: tree, rank and `ask`, a struct that
    comes back. Returns `ask`, `leaf` as the records have it, `subroot`, and
    `path`: from the leaf to the root, the digests on the `left` and `right` of
    the node in its run. Requests may repeat, but those of one run meet in a
    row: ask for a leaf a few times only. Requests of no leaf get no row."""
    trees, top = manifest.trees, manifest.top
    runs = requests.groupBy("tree", F.shiftright("rank", BITS).alias("rank")).agg(F.collect_list(F.struct((F.col("rank") % FAN).cast("int").alias("digit"), "ask")).alias("asks"))
    runs = stored(runs, "runs")
    wanted = runs.select("tree", "rank")

    # from the root to the subroots that are asked for
    height = len(top.levels)
    places = manifest.subroots.join(wanted.select("tree").distinct(), "tree", "left_semi")
    lines = places.select(F.lit("").alias("tree"), "rank")
    nodes = top.roots.select("tree", F.lit(0).cast("long").alias("rank"), "digest", F.array().cast(_PATH).alias("path"))
    for k in range(height, 0, -1):
        below = lines.select("tree", F.shiftright("rank", BITS * (k - 1)).alias("rank")).distinct()
        nodes = _step(top, k, nodes, below)
    heads = places.select("rank", F.col("tree").alias("_tree")).join(manifest.trees.roots.select(F.col("tree").alias("_tree"), "height"), "_tree")
    heads = heads.join(nodes.drop("tree"), "rank").select(F.col("_tree").alias("tree"), F.lit(0).cast("long").alias("rank"), "height", "digest", "path", F.col("digest").alias("subroot"))
    heads = stored(heads, "heads")

    # from each subroot to the runs that hold the leaves asked for
    nodes = heads.filter(F.col("height") == len(trees.levels)).drop("height")
    for k in range(len(trees.levels), 1, -1):
        below = wanted.select("tree", F.shiftright("rank", BITS * (k - 2)).alias("rank")).distinct()
        nodes = _step(trees, k, nodes, below).unionByName(heads.filter(F.col("height") == k - 1).drop("height"))
    leaf = F.col("asked.ask").alias("ask")
    out = heads.filter("height = 0").join(runs, ["tree", "rank"]).select(F.explode("asks").alias("asked"), "digest", "subroot", "path")
    out = out.filter("asked.digit = 0").select(leaf, F.col("digest").alias("leaf"), "subroot", F.reverse("path").alias("path"))
    if trees.levels:
        # the runs' requests come to the paths, not the paths to each request
        rows = _down(trees, 1, nodes).join(runs, ["tree", "rank"]).select(F.explode("asks").alias("asked"), "children", "subroot", "path")
        rows = rows.filter(F.col("asked.digit") < F.size("children")).select("asked", "subroot", *_taken(F.col("asked.digit")))
        out = out.unionByName(rows.select(leaf, F.col("digest").alias("leaf"), "subroot", F.reverse("path").alias("path")))
    return out


def fold(leaf: Column, path: Column) -> Column:
    """The root that `leaf` and the digests beside its `path` lead to."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def tree_of(source: Column) -> Column:
    """A tree's name that is not null and sorts as the source does, nulls first."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def verify_documents(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `leaf`, `subroot` (of its source), `root`,
    `proof_sha256` (digest of the siblings from leaf to root), `folded_root`
    (from the leaf as read again and the siblings) and `verified` (it is the
    root). Where 5 divides the crc32 of the id, what is read again has A-Z of
    the text in lower case; so only texts with such letters fail there.

    Rows of a source are leaves by id, null ids first, rows that share an id by
    leaf: equal rows have equal leaves and proofs of their own places. Null
    sources are one source, before all others. Null values are `-` in a leaf,
    an empty text is `0:`. A source of one row has it as subroot, a table of
    one source its subroot as root. An empty table gives no rows. Other columns
    are not read.

    Texts are read once and never moved. Rows are ranked by ranges of (source,
    id, leaf), so one source or id may hold any share of them; equal nodes are
    one record, and a record that many nodes ask for is salted.
    """
    values = {c: F.col(f"`{c}`") for c in columns}
    low = F.translate(values[text_col].cast("string"), UPPER, LOWER)
    again = leaf_digest([low if c == text_col else v for c, v in values.items()])
    chosen = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    held, name = unused(docs, "_id"), F.col(id_col)
    rows = docs.select(
        tree_of(F.col(source_col)).alias("tree"), name.alias(held), leaf_digest(list(values.values())).alias("digest"),
        F.when(chosen, again).alias("again"), F.monotonically_increasing_id().alias("n_row"),
    )
    manifest = build(stored(rows, "digests"), [held, "digest", "n_row"])
    ask = F.struct(F.col(held).alias("id"), "again").alias("ask")
    proofs = prove(manifest, manifest.leaves.select("tree", "rank", ask))
    folded = fold(F.coalesce("ask.again", "leaf"), F.col("path"))
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        F.col("ask.id").alias(id_col), "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
