"""The operators' queries, each over its whole table, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import prepare, spread
from . import exact, html, lm, near, packing, pieces, quality, suffix, tokens, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_spans(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors whose id 100 divides, against all."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), query_step=100)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id 100 divides, scored on all documents but for the scored occurrences themselves."""
    documents = _table(spark, sf_dir, "documents")
    return lm.score(documents.where("doc_id % 100 = 0"), documents, id_col="doc_id", own_col="doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_sentencepiece,
        op3_token_counts,
        op4_packing,
        op5_quality,
        op6_suffix_dedup,
        op7_near_dedup,
        op8_topk,
        op9_html_extraction,
        op10_lm_scoring,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
select doc_id, min(doc_id) over w as keep_id, count(*) over w as copies, doc_id = min(doc_id) over w as keep
from documents window w as (partition by text)
""",
    "op6_suffix_dedup": r"""
with w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[\t\n\v\f\r ]+'), lambda x: x <> '')) as word, generate_subscripts(list_filter(regexp_split_to_array(text, '[\t\n\v\f\r ]+'), lambda x: x <> ''), 1) - 1 as pos
  from documents where doc_id is not null),
s as (select doc_id, pos, string_agg(word, ' ') over ahead as passage, count(*) over ahead as n from w window ahead as (partition by doc_id order by pos rows between current row and 49 following)),
g as (select doc_id, pos, count(*) over (partition by passage) as c, first_value(doc_id) over one as first_id, first_value(pos) over one as first_pos
  from s where n = 50 window one as (partition by passage order by doc_id, pos)),
h as (select doc_id, pos, doc_id = first_id and pos = first_pos as first, first_id from g where c > 1),
i as (select *, coalesce(pos > lag(pos) over run + 50, true) as new from h window run as (partition by doc_id, first order by pos)),
j as (select *, sum(new::int) over (partition by doc_id, first order by pos) as span from i)
select doc_id, cast(min(pos) as integer) as start_word, cast(max(pos) + 50 as integer) as end_word, first, min(first_id) as first_doc_id from j group by doc_id, first, span
""",
    "op8_topk": """
with v as (select vec_id, embedding::double[] as e from embeddings),
p as (select a.vec_id, b.vec_id as neighbor_id, list_inner_product(a.e, b.e) as x from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
r as (select *, row_number() over (partition by vec_id order by round(x, 9) desc, neighbor_id) as rank from p)
select vec_id, cast(rank as integer) as rank, neighbor_id, round(x, 6) + 0.0 as score from r where rank <= 10
""",
}
