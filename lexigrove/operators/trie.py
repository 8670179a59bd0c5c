"""The frequency trie as a relation: a row (prefix, depth, frequency, is_terminal, is_leaf) for each node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefixes import windows


def trie(strings: DataFrame) -> DataFrame:
    """Of inserted strings (prefix, frequency): a node's frequency is the sum over the strings that begin with it.

    is_terminal: a string ends at the node; is_leaf: no node is below it. Null and empty strings and counts below 1 are left out.
    """
    sound = strings.where("prefix is not null and prefix <> '' and frequency > 0")
    grown = sound.select(F.explode(F.sequence(F.lit(1), F.length("prefix"))).alias("depth"), "prefix", "frequency")
    nodes = grown.select(F.substring("prefix", F.lit(1), F.col("depth")).alias("node"), "depth", "frequency", (F.length("prefix") > F.col("depth")).alias("goes_on"))
    out = nodes.groupBy("node", "depth").agg(F.sum("frequency").alias("frequency"), F.bool_or(~F.col("goes_on")).alias("is_terminal"), (~F.bool_or("goes_on")).alias("is_leaf"))
    return out.withColumnRenamed("node", "prefix")


def merge(*tries: DataFrame) -> DataFrame:
    total = tries[0]
    for more in tries[1:]:
        total = total.unionByName(more)
    return total.groupBy("prefix", "depth").agg(F.sum("frequency").alias("frequency"), F.bool_or("is_terminal").alias("is_terminal"), F.bool_and("is_leaf").alias("is_leaf"))


def leaves(nodes: DataFrame) -> DataFrame:
    return nodes.where("is_leaf")


def collect(nodes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(prefix, frequency, length) of the nodes at which a string ends, that have nothing below them, or that lie at max_depth; none deeper."""
    end = F.col("is_terminal") | F.col("is_leaf")
    if max_depth is not None:
        end = (end | (F.col("depth") == max_depth)) & (F.col("depth") <= max_depth)
    return nodes.where(end).select("prefix", "frequency", F.col("depth").alias("length"))


def prune(nodes: DataFrame, limit: int) -> DataFrame:
    """The trie without what lies below nodes of at most limit; these become leaves. Frequencies don't grow with depth, so the parent decides."""
    parents = nodes.select(F.col("prefix").alias("_parent"), F.col("frequency").alias("_above"))
    kept = nodes.join(parents, F.substring("prefix", F.lit(1), F.col("depth") - 1) == F.col("_parent"), "left").where((F.col("depth") == 1) | (F.col("_above") > limit))
    return kept.withColumn("is_leaf", F.col("is_leaf") | (F.col("frequency") <= limit)).drop("_parent", "_above")


def frequency(nodes: DataFrame, prefix: str) -> DataFrame:
    """One row (frequency): 0 if there is no such node, or for the empty prefix."""
    return nodes.where(F.col("prefix") == prefix).agg(F.coalesce(F.max("frequency"), F.lit(0)).cast("long").alias("frequency"))


def has_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    """One row (has_prefix); the empty prefix is always there."""
    return nodes.where(F.col("prefix") == prefix).agg(((F.count("*") > 0) | F.lit(prefix == "")).alias("has_prefix"))


def node(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.col("prefix") == prefix)


def from_text(corpus: DataFrame, width: int, targets: DataFrame | None = None, terminal: str | None = None) -> DataFrame:
    """The trie of all windows without newlines; the terminal symbol is allowed only as a window's last. targets (prefix): only windows that begin with one of them."""
    found = windows(corpus, width)
    if terminal:
        found = found.where(F.locate(terminal, F.col("prefix")).isin(0, width))
    if targets is not None:
        sized = targets.select(F.col("prefix").alias("_target"))
        hits = None
        for n in sorted(r[0] for r in sized.select(F.length("_target")).distinct().collect()):
            hit = found.join(sized.where(F.length("_target") == n), F.substring("prefix", 1, n) == F.col("_target"), "left_semi")
            hits = hit if hits is None else hits.unionByName(hit)
        found = found.limit(0) if hits is None else hits.distinct()
    return trie(found.groupBy("prefix").agg(F.count("*").alias("frequency")))


def serialize(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct("prefix", "depth", "frequency", "is_terminal", "is_leaf")).alias("node"))


def deserialize(rows: DataFrame) -> DataFrame:
    return rows.select(F.from_json("node", "prefix string, depth int, frequency long, is_terminal boolean, is_leaf boolean").alias("n")).select("n.*")
