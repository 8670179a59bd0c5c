"""Queries of the text index, each over its whole table, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.symbols import SEPARATOR, TERMINATOR, placement, utf16_length, visible
from .operators import allocate, prefixes, search, suffixes, tree, trie
from .plans.engine import SuffixIndex
from .sources import corpus as corpora
from .storage import cut, prepare, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LIMIT = 100
PATTERNS = ["the ", "aa", "ion", "anan", "th"]
#: Frequency above which a pair of characters of the documents needs a longer window.
FREQUENT = 10_000


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _corpus(spark: SparkSession, sf_dir: str, table: str, key: str, text: str) -> DataFrame:
    prepare(spark)
    return corpora.corpus_from(spread(spark.read.parquet(f"{sf_dir}/{table}.parquet")), key, text)


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "benchmark", "item_id", "text")


def _nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "nation", "n_nationkey", "n_name")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir, "documents", "doc_id", "text")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts, with how often each occurs."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.col("p_name").alias("prefix")).agg(F.count("*").alias("frequency"))


# windows and discovery


def _counts_sql(table: str, width: int) -> str:
    return f"""
with s as (select text, unnest(range(1, length(text) - {width} + 2)) as p from {table} where length(text) >= {width}),
w as (select substring(text, p, {width}) as prefix from s)
select prefix, count(*) as frequency, {width} as length from w
where not contains(prefix, chr(10)) and not contains(prefix, chr(13)) group by prefix"""


def _add_counts(name: str, table: str, key: str, width: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return prefixes.window_counts(_corpus(spark, sf_dir, table, key, "text"), width)

    run.__name__ = name
    _query(_counts_sql(table, width))(run)


for _w in (1, 2, 3):
    _add_counts(f"window_counts_w{_w}", "benchmark", "item_id", _w)
_add_counts("window_counts_conversations", "conversations", "conv_id", 3)

#: Widths that the SQL counts; discovery ends before.
_WIDTHS = 8


def _discovery_sql(table: str, key: str, limit: str, widths: int) -> str:
    """CTEs: w, the counts of all windows of up to so many characters; found, those of discovery."""
    ahead = ", ".join(f"lead(ch, {k}) over o as a{k}" for k in range(1, widths))
    grown = " union all ".join(
        f"select {k + 1} as k, {' || '.join(['ch', *(f'a{i}' for i in range(1, k + 1))])} as x, left_over from g where left_over > {k}" for k in range(widths)
    )
    return f"""
c as (select {key} as d, unnest(string_split(text, '')) as ch, unnest(range(0, length(text))) as p, length(text) as n from {table} where length(text) > 0),
g as materialized (select ch, {ahead}{', ' if ahead else ''}n - p as left_over from c window o as (partition by d order by p)),
grown as ({grown}),
w as materialized (select k, x, count(*) as f, max(left_over) as depth from grown where not contains(x, chr(10)) and not contains(x, chr(13)) group by k, x),
lim as materialized (select {limit} as most),
found as materialized (select c.x as prefix, c.f as frequency, cast(c.k as integer) as length, c.depth from w c left join w q on q.k = c.k - 1 and q.x = substring(c.x, 1, c.k - 1)
          where c.f <= (select most from lim) and (c.k = 1 or q.f > (select most from lim)))"""


_DISCOVERY = _discovery_sql("benchmark", "item_id", str(LIMIT), _WIDTHS)


@_query(f"with {_DISCOVERY} select prefix, frequency, length from found")
def sprefix_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.discover(_benchmark(spark, sf_dir), LIMIT)[0]


@_query(f"with {_DISCOVERY} select prefix, frequency, length from found")
def sprefix_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from all windows up to the final width at once, by pruning."""
    corpus = _benchmark(spark, sf_dir)
    width = prefixes.discover(corpus, LIMIT)[1]
    counts = cut(prefixes.merge_counts(*(prefixes.window_counts(corpus, w) for w in range(1, width + 1))))
    return prefixes.prune(prefixes.partition_by_frequency(counts, LIMIT)[0])


@_query(f"""with {_DISCOVERY} select sum(length(text))::bigint as characters, (select sum(frequency) from found)::bigint as covered,
(sum(length(text)) - (select sum(frequency) from found))::bigint as uncovered from benchmark""")
def uncovered_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _benchmark(spark, sf_dir)
    return prefixes.uncovered(corpus, prefixes.discover(corpus, LIMIT)[0]).select(*(F.col(c).cast("long").alias(c) for c in ("characters", "covered", "uncovered")))


@_query(f"""
with c as (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(0, length(text))) as pos from documents),
g as (select ch || lead(ch) over (partition by doc_id order by pos) as prefix from c)
select prefix, count(*) as frequency, 2 as length from g where not contains(prefix, chr(10)) and not contains(prefix, chr(13)) group by prefix having count(*) > {FREQUENT}""")
def sprefix_needs_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.partition_by_frequency(prefixes.window_counts(_documents(spark, sf_dir), 2), FREQUENT)[1]


@_query(f"select * from ({_counts_sql('benchmark', 3)}) where frequency >= 2")
def sprefix_min_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.at_least(prefixes.window_counts(_benchmark(spark, sf_dir), 3), 2)


@_query(f"select prefix, frequency, length, row_number() over (order by frequency desc, prefix) as place from ({_counts_sql('benchmark', 2)})")
def sprefix_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = prefixes.window_counts(_benchmark(spark, sf_dir), 2)
    keyed = counts.withColumn("key", F.struct((-F.col("frequency")).alias("f"), "prefix"))
    return corpora.running_total(keyed.withColumn("one", F.lit(1)), "key", "one", "before").select("prefix", "frequency", "length", (F.col("before") + 1).alias("place"))


# trie


_TRIE = """
names as (select p_name as s, count(*) as f from part where length(p_name) > 0 group by 1),
grown as (select substring(s, 1, d) as prefix, d, f, length(s) > d as more from names, range(1, 100) r(d) where d <= length(s)),
nodes as (select prefix, cast(d as integer) as depth, cast(sum(f) as bigint) as frequency, bool_or(not more) as is_terminal, not bool_or(more) as is_leaf from grown group by prefix, d)"""


@_query(f"with {_TRIE} select * from nodes")
def trie_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(_names(spark, sf_dir))


@_query(f"with {_TRIE} select * from nodes where is_leaf")
def trie_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.leaves(trie.trie(_names(spark, sf_dir)))


@_query(f"with {_TRIE} select prefix, frequency, depth as length from nodes where depth <= 5 and (is_terminal or is_leaf or depth = 5)")
def trie_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.collect(trie.trie(_names(spark, sf_dir)), 5)


@_query(f"""with {_TRIE} select n.prefix, n.depth, n.frequency, n.is_terminal, n.is_leaf or n.frequency <= 50 as is_leaf
from nodes n left join nodes p on p.prefix = substring(n.prefix, 1, n.depth - 1) where n.depth = 1 or p.frequency > 50""")
def trie_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prune(trie.trie(_names(spark, sf_dir)), 50)


@_query(f"with {_TRIE} select prefix, depth, 2 * frequency as frequency, is_terminal, is_leaf from nodes")
def trie_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = trie.trie(_names(spark, sf_dir))
    return trie.merge(one, trie.deserialize(trie.serialize(one)))


@_query(f"with {_TRIE} select coalesce(max(frequency), 0)::bigint as frequency, true as has_prefix, false as has_other from nodes where prefix = (select min(substring(p_name, 1, 3)) from part)")
def trie_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    nodes = trie.trie(names)
    first = names.agg(F.min(F.substring("prefix", 1, 3))).first()[0] or ""
    other = trie.has_prefix(nodes, "no such prefix").withColumnRenamed("has_prefix", "has_other")
    return trie.frequency(nodes, first).crossJoin(trie.has_prefix(nodes, first)).crossJoin(other)


@_query("""
with s as (select n_name as t, unnest(range(1, length(n_name) - 1)) as p from nation where length(n_name) >= 3),
w as (select substring(t, p, 3) as x from s), u as (select x from w where instr(x, 'A') in (0, 3)),
g as (select substring(x, 1, d) as prefix, d, d < 3 as more from u, range(1, 4) r(d))
select prefix, cast(d as integer) as depth, count(*) as frequency, bool_or(not more) as is_terminal, not bool_or(more) as is_leaf from g group by prefix, d""")
def trie_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.from_text(_nation(spark, sf_dir), 3, terminal="A")


# places


@_query("""
select cast(row_number() over (order by doc_id) - 1 as integer) as index, doc_id, 'file-' || doc_id as name,
coalesce(sum(strlen(text)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as start,
sum(strlen(text)) over (order by doc_id rows between unbounded preceding and current row)::bigint as "end" from documents""")
def boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.boundaries(_documents(spark, sf_dir))


@_query("""
with b as (select cast(row_number() over (order by s_suppkey) - 1 as integer) as index, 'file-' || s_suppkey as name, length(s_name) as n,
coalesce(sum(length(s_name)) over (order by s_suppkey rows between unbounded preceding and 1 preceding), 0)::bigint as start from supplier),
p as (select unnest(range(0, (select sum(length(s_name)) + 20 from supplier)::bigint)) as pos),
l as (select * from b order by start + n desc, index desc limit 1)
select p.pos, coalesce(b.index, l.index) as index, coalesce(b.name, l.name) as name, coalesce(p.pos - b.start, l.n)::bigint as local
from p cross join l left join b on p.pos >= b.start and p.pos < b.start + b.n""")
def position_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = cut(corpora.boundaries(_corpus(spark, sf_dir, "supplier", "s_suppkey", "s_name"), unit="chars"))
    total = bounds.agg(F.max("end")).first()[0] or 0
    return search.position_to_document(spark.range(total + 20).withColumnRenamed("id", "pos"), bounds)


def _patterns_sql(columns: str, tail: str = "") -> str:
    values = ", ".join(f"('{p}')" for p in PATTERNS)
    ahead = " || ".join(["ch", *(f"coalesce(lead(ch, {k}) over w, '')" for k in range(1, max(map(len, PATTERNS))))])
    return f"""
with pat(pattern) as (values {values}),
c as (select doc_id, unnest(string_split(text, '')) as ch, unnest(range(0, length(text))) as pos from documents),
g as (select doc_id, pos, {ahead} as x from c window w as (partition by doc_id order by pos))
select {columns} from g join pat on starts_with(x, pattern) {tail}"""


@_query(_patterns_sql("pattern, doc_id, pos"))
def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrences(_documents(spark, sf_dir), PATTERNS)


@_query(_patterns_sql("pattern, count(*) as occurrences, count(distinct doc_id) as documents", "group by pattern"))
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.occurrence_counts(_documents(spark, sf_dir), PATTERNS)


@_query("select page_id as doc_id from pages where contains(html, '<footer>')")
def contains_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.contains(_corpus(spark, sf_dir, "pages", "page_id", "html"), "<footer>").select("doc_id")


# suffix arrays and trees

_SUFFIXES = {
    "nation": "select n_nationkey::bigint as d, n_name as x from nation",
    "region": "select r_regionkey::bigint as d, r_name as x from region",
    "part": "select p_partkey::bigint as d, p_name as x from part",
    "supplier": "select s_suppkey::bigint as d, s_name as x from supplier",
    "benchmark": "select item_id as d, text as x from benchmark",
}
_COLUMNS = {"nation": ("n_nationkey", "n_name"), "region": ("r_regionkey", "r_name"), "part": ("p_partkey", "p_name"), "supplier": ("s_suppkey", "s_name"), "benchmark": ("item_id", "text")}


def _suffix_sql(table: str) -> str:
    return f"""
with t as ({_SUFFIXES[table]}), s as (select d, unnest(range(1, length(x) + 1)) as p, x from t),
u as (select substring(x, p, 1) as prefix, d as doc_id, p - 1 as pos, substring(x, p) as suffix from s where not regexp_matches(substring(x, p, 1), '[\\n\\r]')),
o as (select *, row_number() over w - 1 as rank, lag(suffix) over w as before from u window w as (partition by prefix order by suffix, doc_id, pos))
select prefix, rank, doc_id, pos, cast(case when before is null then 0 else coalesce(list_max(list_filter(range(0, least(length(suffix), length(before)) + 1),
lambda k: substring(suffix, 1, k) = substring(before, 1, k))), 0) end as integer) as lcp from o"""


def _single(corpus: DataFrame) -> DataFrame:
    """Each character but newlines as a prefix."""
    return prefixes.window_counts(corpus, 1)


def _add_suffix_array(name: str, table: str, strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        corpus = cut(_corpus(spark, sf_dir, table, *_COLUMNS[table]))
        return suffixes.suffix_array(corpus, cut(_single(corpus)), strategy)

    run.__name__ = name
    _query(_suffix_sql(table))(run)


_add_suffix_array("suffix_array", "nation", "auto")
_add_suffix_array("suffix_array_region", "region", "auto")
_add_suffix_array("suffix_array_part", "part", "auto")
_add_suffix_array("suffix_array_supplier", "supplier", "auto")
_add_suffix_array("suffix_array_benchmark", "benchmark", "auto")
_add_suffix_array("suffix_array_doubling", "benchmark", "doubling")


@_query(f"""with o as ({_suffix_sql("supplier")}), t as ({_SUFFIXES["supplier"]}),
l as (select *, lag(doc_id) over w as d2, lag(pos) over w as p2 from o window w as (partition by prefix order by rank)),
s as (select l.*, substring(t.x, l.pos + l.lcp + 1, 32) as own, substring(u.x, l.p2 + l.lcp + 1, 1) as theirs from l join t on t.d = l.doc_id left join t u on u.d = l.d2)
select prefix, rank, doc_id, pos, case when d2 is null or own = '' or theirs = '' then chr(0) else theirs end as char,
case when d2 is not null and theirs = '' then '' else own end as range, lcp as offset from s""")
def lcp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = cut(_corpus(spark, sf_dir, "supplier", "s_suppkey", "s_name"))
    return suffixes.lcp_ranges(suffixes.suffix_array(corpus, cut(_single(corpus))), corpus)


@_query("""
with j as (select string_agg(n_name, chr(57344) order by n_nationkey) || chr(57345) as x from nation),
s as (select unnest(range(1, length(x) + 1)) as p, x from j),
u as (select substring(x, p, 1) as prefix, p - 1 as pos, translate(substring(x, p), chr(57345) || chr(57344), chr(1) || chr(2)) as suffix from s)
select case prefix when chr(57344) then '#' when chr(57345) then '$' else prefix end as prefix, row_number() over (partition by prefix order by suffix) - 1 as rank, pos from u""")
def suffix_array_superstring(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _nation(spark, sf_dir)
    found, _ = prefixes.discover(corpus, 10_000, superstring=True)
    array = suffixes.suffix_array(cut(corpora.superstring(corpus)), found, joined=True)
    return array.select(visible(F.col("prefix")).alias("prefix"), "rank", "pos")


_TREE = """
t as (select s_suppkey::bigint as d, s_name as x from supplier),
i as (select d, x, unnest(range(1, length(x) + 1)) as i from t),
o as (select substring(x, i, l) as s, l, case when i + l > length(x) then '$' || d || ',' || i else substring(x, i + l, 1) end as nxt
      from (select d, x, i, unnest(range(1, length(x) - i + 2)) as l from i)),
inner_nodes as (select s, cast(any_value(l) as integer) as depth from o group by s having count(distinct nxt) >= 2),
leaves as (select d as doc_id, i - 1 as pos, substring(x, i) as s from i),
below as (
  select 'internal' as type, c.s, c.depth, null::bigint as doc_id, null::bigint as pos, coalesce(max(p.depth), 0) as parent_depth, count(p.s) + 1 as level
  from inner_nodes c left join inner_nodes p on p.depth < c.depth and starts_with(c.s, p.s) group by c.s, c.depth
  union all
  select 'leaf', l.s, length(l.s) + 1, l.doc_id, l.pos, coalesce(max(p.depth), 0), count(p.s) + 1
  from leaves l left join inner_nodes p on starts_with(l.s, p.s) group by l.s, l.doc_id, l.pos)"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The corpus of suppliers' names, its prefixes, and the elements of its trees."""
    corpus = cut(_corpus(spark, sf_dir, "supplier", "s_suppkey", "s_name"))
    single = cut(_single(corpus))
    return corpus, single, suffixes.index_elements(corpus, single)


def _labelled(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Edges with the label from the root to their lower end."""
    ends = tree.edges(found, corpus).join(tree.nodes(found, corpus).select("prefix", F.col("node_id").alias("to"), "depth", "type", "suffix_start"), ["prefix", "to"])
    above = tree.nodes(found, corpus).select("prefix", F.col("node_id").alias("from"), F.col("depth").alias("parent_depth"))
    named = ends.join(above, ["prefix", "from"]).join(corpus.select("doc_id", "text"), "doc_id")
    return named.withColumn("label", F.substring("text", (F.col("end") - F.col("depth") + 1).cast("int"), F.col("depth")))


@_query(f"with {_TREE} select s as label, depth from inner_nodes")
def internal_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, found = _tree(spark, sf_dir)
    return _labelled(corpus, found).where("type = 'internal'").select("label", "depth")


@_query(f"with {_TREE} select substring(s, 1, 1) as prefix, doc_id, pos as suffix_start, pos as local_index, 'file-' || doc_id as doc_name, cast(depth as integer) as depth from below where type = 'leaf'")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, found = _tree(spark, sf_dir)
    return tree.nodes(found, corpus).where("type = 'leaf'").select("prefix", "doc_id", "suffix_start", "local_index", "doc_name", "depth")


@_query(f"with {_TREE} select substring(s, 1, 1) as prefix, type, s as label, doc_id, pos, cast(depth as integer) as depth, cast(parent_depth as integer) as parent_depth from below")
def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, found = _tree(spark, sf_dir)
    leaf = F.col("type") == "leaf"
    return _labelled(corpus, found).select("prefix", "type", "label", F.when(leaf, F.col("doc_id")).alias("doc_id"), F.when(leaf, F.col("suffix_start")).alias("pos"), "depth", "parent_depth")


@_query(f"with {_TREE} select s as label, type, doc_id, substring(s, parent_depth::bigint + 1, least(32, depth - parent_depth)::bigint) as label_preview, depth - parent_depth as label_length from below")
def edge_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, found = _tree(spark, sf_dir)
    leaf = F.col("type") == "leaf"
    return _labelled(corpus, found).select("label", "type", F.when(leaf, F.col("doc_id")).alias("doc_id"), "label_preview", (F.col("end") - F.col("start")).cast("int").alias("label_length"))


@_query(f"""with {_TREE} select substring(s, 1, 1) as prefix, count(*) + 1 as nodes, count(*) as edges, count(*) filter (type = 'leaf') as leaves,
cast(max(depth) as integer) as max_depth from below group by 1""")
def subtree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.tree_stats(_tree(spark, sf_dir)[2])


@_query(f"""with {_TREE} select count(*) + count(distinct substring(s, 1, 1)) as total_nodes, count(*) as total_edges, cast(max(depth) as integer) as max_depth,
count(*) filter (type = 'leaf') as total_suffixes, cast(count(distinct substring(s, 1, 1)) as integer) as s_prefixes, 50000::bigint as memory_limit, 1 as final_window_size from below""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, single, found = _tree(spark, sf_dir)
    return tree.index_stats(found, single, 50_000, 1)


@_query(f"""with {_TREE} select substring(s, 1, 1) as prefix, type, cast(depth as integer) as depth, cast(level as integer) as level, count(*) as nodes from below group by all
union all select distinct substring(s, 1, 1), 'root', 0, 0, 1 from below""")
def tree_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, _, found = _tree(spark, sf_dir)
    placed = tree.hierarchy(tree.nodes(found, corpus), tree.edges(found, corpus))
    return placed.groupBy("prefix", "type", "depth", "level").agg(F.count("*").alias("nodes"))


# groups


_ASSIGNED = f"""{_DISCOVERY},
sorted as materialized (select row_number() over (order by frequency desc, prefix) as i, prefix, frequency as f, length from found),
many as materialized (select count(*) as n from sorted),
fit as (  -- best fit: each where the least room is left over, else into a new bin
  select 0::bigint as i, []::bigint[] as room
  union all
  select s.i, case when best is null then list_append(room, {LIMIT} - s.f)
    else list_transform(room, lambda x, k: case when k = list_position(room, best) then x - s.f else x end) end
  from (select fit.i, room, sorted.f, list_min(list_filter(room, lambda x: x >= sorted.f)) as best from fit join sorted on sorted.i = fit.i + 1) t join sorted s on s.i = t.i + 1),
bins as materialized (select len(room) as b from fit where i = (select n from many)),
least as (select case when b < 4 then b else (b + 3) // 4 * 4 end as g from bins),
placed as (  -- the least loaded, the first among equals, for that number of groups and a few more
  select 0::bigint as i, g + extra as g, list_resize([]::bigint[], g + extra, 0::bigint) as load, null::bigint as spot from least, range(0, 9) e(extra)
  union all
  select s.i, g, list_transform(load, lambda x, k: case when k = list_position(load, list_min(load)) then x + s.f else x end), list_position(load, list_min(load)) - 1
  from placed join sorted s on s.i = placed.i + 1 where list_min(load) + s.f <= {LIMIT}),
groups as materialized (select min(g) as g from placed where i = (select n from many)),
assigned as materialized (select prefix, f as frequency, length, cast(spot as integer) as group_id, cast(spot // 4 as integer) as round_id from placed join sorted using (i) where g = (select g from groups))"""


@_query(f"""with recursive {_ASSIGNED}
select cast(n + 1 as integer) as display_index, cast(n as integer) as group_id, cast(n // 4 as integer) as round_id, coalesce(sum(frequency), 0)::bigint as total_frequency, count(prefix) as prefix_count
from range(0, (select g from groups)) r(n) left join assigned on group_id = n group by n""")
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = prefixes.discover(_benchmark(spark, sf_dir), LIMIT)
    return allocate.group_totals(*allocate.allocated(found, LIMIT, 4), 4)


@_query(f"with recursive {_ASSIGNED} select * from assigned")
def task_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = prefixes.discover(_benchmark(spark, sf_dir), LIMIT)
    return allocate.allocate(found, LIMIT, 4)


@_query(f"""with recursive {_ASSIGNED}
select cast((select g from groups) as integer) as group_count, count(*) as prefix_count, round(count(*) / (select g from groups), 2) as prefixes_per_group from assigned""")
def group_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = prefixes.discover(_benchmark(spark, sf_dir), LIMIT)
    return allocate.group_stats(*allocate.allocated(found, LIMIT, 4))


# whole builds

_RULE = "greatest(50000, (select sum(strlen(text)) from documents) // 50)"


@_query(f"""with {_discovery_sql("documents", "doc_id", _RULE, 5)}
select prefix, frequency as leaves, cast(max(depth) + 1 as integer) as max_depth from found group by prefix, frequency""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build over all documents, its suffix arrays and trees included: of each sub-tree its leaves and its depth."""
    return SuffixIndex.trees(_documents(spark, sf_dir))


@_query("""select count(*) as texts, round(coalesce(sum(strlen(text)), 0) / 1024, 2) as kilobytes,
(select string_agg('file-' || doc_id, ' ' order by doc_id) from (select doc_id from documents order by doc_id limit 5)) as first_names from documents""")
def corpus_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.corpus_info(_documents(spark, sf_dir)).withColumn("first_names", F.array_join("first_names", " "))


# functions


@_query("select s_suppkey, s_name || '#' || s_name || '$' as shown from supplier")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return df.select("s_suppkey", visible(F.concat("s_name", F.lit(SEPARATOR), "s_name", F.lit(TERMINATOR))).alias("shown"))


@_query("""select s_suppkey, cast(abs(case when h >= 2147483648 then h - 4294967296 else h end) % 4 as integer) as part from
(select s_suppkey, list_reduce(list_prepend(0::bigint, list_transform(string_split(s_name, ''), lambda c: ascii(c)::bigint)), lambda a, c: (a * 31 + c) % 4294967296) as h from supplier)""")
def hash_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", placement(F.col("s_name"), 4).alias("part"))


@_query("select item_id, length(text) + (length(text) - length(regexp_replace(text, '[\\x{10000}-\\x{10FFFF}]', '', 'g'))) as utf16 from benchmark")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", utf16_length(F.col("text")).alias("utf16"))
