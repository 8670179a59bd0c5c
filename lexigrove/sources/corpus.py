"""Texts to index, as (doc_id, name, text); and where each lies in their concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.symbols import SEPARATOR, TERMINATOR
from ..storage import cut

SCHEMA = "doc_id long, name string, text string"


def corpus_from(df: DataFrame, id_col: str, text_col: str, name_col: str | None = None) -> DataFrame:
    """Nulls count as empty texts; a missing name is file-<doc_id>."""
    name = F.col(name_col).cast("string") if name_col else F.lit(None).cast("string")
    key = F.col(id_col).cast("long")
    return df.select(key.alias("doc_id"), F.coalesce(name, F.concat(F.lit("file-"), key.cast("string"))).alias("name"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file of a folder as a text, numbered in the order of their paths."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    # the numbering is a window over the file names only, one short row per file
    order = files.select("path").distinct().select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("doc_id"))
    return files.join(order, "path").select("doc_id", F.element_at(F.split("path", "/"), -1).alias("name"), "text")


def running_total(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """df with the sum of value over the rows before each, in the order given.

    Rows are range-partitioned and summed within their partition; only one total per partition meets on the driver.
    """
    placed = cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(value).alias("total"), F.min(order).alias("least")).orderBy("least").collect()
    before, table = 0, []
    for row in totals:
        table.append((row._part, before))
        before += row.total or 0
    offsets = df.sparkSession.createDataFrame(table, "_part int, _before long")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def boundaries(corpus: DataFrame, unit: str = "bytes", separator: int = 0) -> DataFrame:
    """(index, name, start, end), half-open, of each text in the concatenation in the order of doc_id.

    unit: bytes or chars. separator: width of what lies between two texts, in that unit. index counts from 0.
    """
    size = F.octet_length("text") if unit == "bytes" else F.length("text")
    sized = corpus.select("doc_id", "name", size.cast("long").alias("size"), (size + separator).cast("long").alias("step"), F.lit(1).alias("one"))
    placed = running_total(running_total(sized, "doc_id", "step", "start"), "doc_id", "one", "index")
    return placed.select(F.col("index").cast("int").alias("index"), "doc_id", "name", "start", (F.col("start") + F.col("size")).alias("end"))


def corpus_info(corpus: DataFrame, names: int = 5) -> DataFrame:
    """One row (texts, kilobytes, first_names): how many texts, their size to 2 digits, and the names of the first few by doc_id."""
    sums = corpus.agg(F.count("*").alias("texts"), F.round(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)) / 1024, 2).alias("kilobytes"))
    first = corpus.orderBy("doc_id").limit(names).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "name"))), lambda x: x["name"]).alias("first_names"))
    return sums.crossJoin(first)


def superstring(corpus: DataFrame) -> DataFrame:
    """One row: all texts in the order of doc_id, a separator between neighbours, a terminator at the end. For inputs that one value can hold."""
    bad = corpus.where(F.col("text").rlike(f"[{SEPARATOR}{TERMINATOR}]"))
    if not bad.isEmpty():
        raise ValueError("a text has the separator or the terminator in it")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x.text), SEPARATOR)
    return corpus.agg(F.concat(joined, F.lit(TERMINATOR)).alias("text")).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("superstring").alias("name"), "text")


def write_index(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """Each table of a result into a folder of its own below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/{name}")
