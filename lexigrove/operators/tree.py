"""Sub-trees from sorted suffixes.

A tree's inner nodes are intervals of the common prefixes; where each interval ends is a matter of nearest smaller values, which pointer jumping finds for all places at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import PREVIEW, visible

ELEMENTS = "prefix string, node_id int, depth int, type string, rank long, lcp int, suffix_start long, doc_id long, parent int, start long, end long"


SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]]) for x in ELEMENTS.split(", ")])


def _smaller(x: np.ndarray, left: bool) -> np.ndarray:
    """For each entry the nearest one on that side that is smaller: its place, -1 or len(x) if there is none."""
    n = len(x)
    if not left:
        return n - 1 - _smaller(x[::-1], True)[::-1]
    near = np.arange(-1, n - 1)
    value = np.append(x, np.iinfo(np.int64).min)  # value[-1] ends each search
    open_ = np.flatnonzero(value[near] >= x)
    while len(open_):
        near[open_] = near[near[open_]]
        open_ = open_[value[near[open_]] >= x[open_]]
    return near


@dataclass
class Shape:
    """Sub-trees, one after the other, of suffixes in order; all entries of inner nodes are in the order of the suffix that calls for them.

    leaf, leaf_parent: node of each suffix and the one above it, with its depth. call: the suffix that calls for an inner node; inner, inner_parent: its
    node and the one above; first: the first suffix below it.
    """

    leaf: np.ndarray
    leaf_parent: np.ndarray
    leaf_above: np.ndarray
    call: np.ndarray
    inner: np.ndarray
    inner_depth: np.ndarray
    inner_parent: np.ndarray
    inner_above: np.ndarray
    first: np.ndarray


def shape(lcp: np.ndarray, begins: np.ndarray) -> Shape:
    """The trees of suffixes with these common prefixes, where a tree's first suffix has 0. A node's number is its turn: an inner node comes just before the leaf that calls for it.

    A length opens an inner node where it is not the one of an earlier suffix with nothing shorter between; all of that interval lies below. What is above
    a node has the greater of the lengths on both sides of its interval.
    """
    n = len(lcp)
    before, behind = _smaller(lcp, True), _smaller(lcp, False)
    tree = np.cumsum(begins) - 1
    starts = np.flatnonzero(begins)
    # equal lengths with the same smaller one before belong to one node, called for by the first of them
    key = np.where(lcp > 0, before, -1)
    order = np.lexsort((np.arange(n), lcp, key))
    k, d = key[order], lcp[order]
    head = np.ones(n, bool)
    head[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    caller = np.empty(n, np.int64)
    caller[order] = order[np.maximum.accumulate(np.where(head, np.arange(n), 0))]
    new = (caller == np.arange(n)) & (lcp > 0)
    made = np.cumsum(new)
    leaf = np.arange(n) - starts[tree] + 1 + made - (made - new)[starts[tree]]
    node = np.where(lcp > 0, (leaf - 1)[caller], 0)  # of the length before each suffix; its number holds within the tree
    after = np.append(lcp[1:], 0)
    after[starts[1:] - 1] = 0
    deeper = after > lcp
    leaf_parent = np.where(deeper, np.append(node[1:], 0), node)
    call = np.flatnonzero(new)
    left = before[call]
    right = np.where(behind[call] < n, behind[call], 0)  # the 0 of some tree's first suffix: no node
    above = np.maximum(lcp[left], lcp[right])
    parent = np.where(above == 0, 0, np.where(lcp[left] >= lcp[right], node[left], node[right]))
    return Shape(leaf, leaf_parent, np.maximum(lcp, after), call, node[call], lcp[call], parent, above, left)


def table(prefix: pa.Array, lcp: np.ndarray, room: np.ndarray, pos: np.ndarray, docs: np.ndarray, doc_valid: np.ndarray | None, begins: np.ndarray, end: int) -> pa.Table:
    """ELEMENTS of the trees of suffixes in order: a row for each root, inner node and leaf, with the edge that leads to it.

    prefix: of each suffix. room: characters of each. end: 1 if a text's end is a symbol of its own, so that equal suffixes part there; else 0.
    An edge's label is a range of the text of its doc_id. Strings may come as a dictionary's.
    """
    n = len(lcp)
    if not n:
        return SCHEMA.empty_table()
    s = shape(lcp, begins)
    starts = np.flatnonzero(begins)
    roots, inner = len(starts), len(s.call)
    total = roots + inner + n
    leaves = slice(roots + inner, total)
    middle = slice(roots, roots + inner)
    owner = np.concatenate([starts, s.call, np.arange(n)])

    def column(kind: type, root, mid, leaf) -> np.ndarray:
        out = np.empty(total, kind)
        out[:roots], out[middle], out[leaves] = root, mid, leaf
        return out

    rank = np.arange(n) - starts[np.cumsum(begins) - 1]
    isroot = np.arange(total) < roots
    notleaf = np.arange(total) < roots + inner
    doc = column(np.int64, 0, docs[s.first], docs)
    no_doc = isroot.copy()
    if doc_valid is not None:
        no_doc |= ~column(bool, True, doc_valid[s.first], doc_valid)
    first = pos[s.first]
    kinds = pa.DictionaryArray.from_arrays(pa.array(column(np.int8, 0, 1, 2)), pa.array(["root", "internal", "leaf"]))
    return pa.table(
        {
            "prefix": prefix.take(pa.array(owner)),
            "node_id": pa.array(column(np.int32, 0, s.inner, s.leaf)),
            "depth": pa.array(column(np.int32, 0, s.inner_depth, room + end)),
            "type": kinds,
            "rank": pa.array(column(np.int64, 0, 0, rank), mask=notleaf),
            "lcp": pa.array(column(np.int32, 0, 0, lcp), mask=notleaf),
            "suffix_start": pa.array(column(np.int64, 0, 0, pos), mask=notleaf),
            "doc_id": pa.array(doc, mask=no_doc),
            "parent": pa.array(column(np.int32, 0, s.inner_parent, s.leaf_parent), mask=isroot),
            "start": pa.array(column(np.int64, 0, first + s.inner_above, pos + s.leaf_above), mask=isroot),
            "end": pa.array(column(np.int64, 0, first + s.inner_depth, pos + room + end), mask=isroot),
        }
    )



def _grow(end: int):
    def grow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank").combine_chunks()
        lcp, room, pos = (rows[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lcp", "size", "pos"))
        docs = rows["doc_id"].combine_chunks()
        begins = np.zeros(len(lcp), bool)
        begins[:1] = True
        valid = None if docs.null_count == 0 else docs.is_valid().to_numpy(zero_copy_only=False)
        return table(rows["prefix"].combine_chunks(), lcp, room, pos, docs.fill_null(0).to_numpy(), valid, begins, end).cast(SCHEMA)

    return grow


def elements(suffixes: DataFrame, corpus: DataFrame, boundary: str = "document") -> DataFrame:
    """Nodes of all sub-trees of a suffix array, each with the edge that leads to it; leaves with their suffix's rank and common prefix."""
    sized = suffixes.join(corpus.select("doc_id", F.length("text").alias("_n")), "doc_id").select("prefix", "rank", "doc_id", "pos", "lcp", (F.col("_n") - F.col("pos")).cast("int").alias("size"))
    return sized.groupBy("prefix").applyInArrow(_grow(1 if boundary == "document" else 0), ELEMENTS)


def suffixes(found: DataFrame) -> DataFrame:
    """(prefix, rank, doc_id, pos, lcp) of the leaves: the suffix array."""
    return found.where("type = 'leaf'").select("prefix", "rank", "doc_id", F.col("suffix_start").alias("pos"), "lcp")


def nodes(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(prefix, node_id, depth, type, suffix_start, doc_id, doc_name, local_index); the last four only for leaves."""
    mine = found.withColumn("doc_id", F.when(F.col("type") == "leaf", F.col("doc_id")))
    named = mine.join(corpus.select("doc_id", F.col("name").alias("doc_name")), "doc_id", "left")
    return named.select("prefix", "node_id", "depth", "type", "suffix_start", "doc_id", "doc_name", F.col("suffix_start").alias("local_index"))


def edges(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """(prefix, from, to, start, end, doc_id, label_preview): an edge's label is [start, end) of the text of doc_id; its end may lie one behind the text's, for the end itself."""
    named = found.where("parent is not null").join(corpus.select("doc_id", "text"), "doc_id")
    preview = F.substring("text", (F.col("start") + 1).cast("int"), F.least(F.lit(PREVIEW), F.col("end") - F.col("start")).cast("int"))
    return named.select("prefix", F.col("parent").alias("from"), F.col("node_id").alias("to"), "start", "end", "doc_id", visible(preview).alias("label_preview"))


def tree_stats(found: DataFrame) -> DataFrame:
    """(prefix, nodes, edges, leaves, max_depth) of each sub-tree."""
    return found.groupBy("prefix").agg(
        F.count("*").alias("nodes"),
        F.count("parent").alias("edges"),
        F.count_if(F.col("type") == "leaf").alias("leaves"),
        F.max("depth").alias("max_depth"),
    )


def index_stats(found: DataFrame, prefixes: DataFrame, limit: int, window: int) -> DataFrame:
    """One row: total_nodes, total_edges, max_depth, total_suffixes, s_prefixes, memory_limit, final_window_size."""
    trees = found.agg(F.count("*").alias("total_nodes"), F.count("parent").alias("total_edges"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))
    sums = prefixes.agg(F.coalesce(F.sum("frequency"), F.lit(0)).alias("total_suffixes"), F.count("*").cast("int").alias("s_prefixes"))
    return trees.crossJoin(sums).select("*", F.lit(limit).cast("long").alias("memory_limit"), F.lit(window).alias("final_window_size"))


def _levels(table: pa.Table) -> pa.Table:
    parents = dict(zip(table["to"].to_pylist(), table["from"].to_pylist(), strict=True))
    known = {0: (0, "0")}

    def place(x: int) -> None:
        way = []
        while x not in known:
            way.append(x)
            x = parents[x]
        level, path = known[x]
        for y in reversed(way):
            level, path = level + 1, f"{path}/{y}"
            known[y] = (level, path)

    for x in parents:
        place(x)
    prefix = table["prefix"][0].as_py()
    rows = [(prefix, x, parents.get(x), level, path) for x, (level, path) in known.items()]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["prefix", "node_id", "parent_id", "level", "path"])


def hierarchy(tree_nodes: DataFrame, tree_edges: DataFrame) -> DataFrame:
    """(prefix, node_id, parent_id, level, path, depth, type): each node's place below its sub-tree's root; edges to or from nodes that aren't there are left out."""
    known = tree_nodes.select("prefix", "node_id")
    sound = tree_edges.select("prefix", "from", "to").join(known.withColumnRenamed("node_id", "from"), ["prefix", "from"], "left_semi").join(known.withColumnRenamed("node_id", "to"), ["prefix", "to"], "left_semi")
    placed = sound.groupBy("prefix").applyInArrow(_levels, "prefix string, node_id int, parent_id int, level int, path string")
    return placed.join(tree_nodes.select("prefix", "node_id", "depth", "type"), ["prefix", "node_id"])
