"""Readers and writers: raw documents, JSON lines, benchmark files, stored zones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.index import point_id
from ..operators.lineage import cut


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (path within the folder), source, text of all files under it.

    Hidden and blank files are left out, undecodable bytes dropped. PDF and DOCX are
    parsed where their libraries are installed, else read as text, as other suffixes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    inner = F.substring_index(path, root, -1)
    named = files.select(inner.alias("doc_id"), "content").where(~F.concat(F.lit("/"), F.col("doc_id")).contains("/."))
    suffix = F.lower(F.regexp_extract("doc_id", r"\.([^./]+)$", 1))
    plain = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    rich = F.when(suffix.isin("pdf", "docx"), _parse()(suffix, F.col("content")))
    docs = named.select("doc_id", F.col("doc_id").alias("source"), F.coalesce(rich, plain).alias("text"))
    return docs.where(F.length(T.strip(F.col("text"))) > 0)


def _parse():
    @F.pandas_udf("string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for suffixes, contents in batches:
            yield pd.Series([_rich_text(s, c) for s, c in zip(suffixes, contents, strict=True)])

    return parse


def _rich_text(suffix: str, content: bytes) -> str | None:
    import io

    try:
        if suffix == "pdf":
            from pypdf import PdfReader

            return "\n\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)
        if suffix == "docx":
            from docx import Document

            document = Document(io.BytesIO(content))
            parts = [p.text for p in document.paragraphs]
            for table in document.tables:
                for i, row in enumerate(table.rows):
                    cells = [c.text.strip() for c in row.cells]
                    parts.append("| " + " | ".join(cells) + " |")
                    if i == 0:
                        parts.append("|" + "---|" * len(cells))
            return "\n".join(parts)
    except ImportError:
        return None
    return None


def append_json_lines(df: DataFrame, folder: str) -> None:
    """Appends rows with the time of writing in ts."""
    df.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")).write.mode("append").json(folder)


def read_json_lines(spark: SparkSession, folder: str, schema: str, last: int = 0) -> DataFrame:
    """Rows of a schema with ts; the last so many by ts, oldest first, all if 0. Bad
    lines drop out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(folder)
    if not last:
        return rows
    return rows.orderBy(F.col("ts").desc()).limit(last).orderBy("ts")


def write_result(summary: DataFrame, path: str) -> None:
    """A run's summary, baseline or ablation as JSON: few rows, one file."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a benchmark's corpus file; title and text in one."""
    rows = spark.read.schema("_id string, title string, text string").json(path)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.select(F.col("_id").alias("doc_id"), T.strip(text).alias("text"))


def parse_qrels(lines: DataFrame) -> DataFrame:
    """query_id, doc_id, grade of lines (value, and n to tell which is last); the
    header and short lines are left out, of equal pairs the last counts."""
    parts = F.split(T.strip(F.col("value")), r"(?U)\s+")
    rows = lines.withColumn("p", parts).where((F.size("p") >= 3) & (F.get("p", F.lit(0)) != "query-id"))
    graded = rows.select(
        F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(1)).alias("doc_id"), F.expr("cast(try_cast(p[2] as double) as int)").alias("grade"), "n"
    )
    latest = graded.groupBy("query_id", "doc_id").agg(F.max_by("grade", "n").alias("grade"))
    return latest.where("grade is not null")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return parse_qrels(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def read_golden(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One JSON array, or with multi_line false an object a line."""
    schema = "id string, question string, answer_keywords array<string>, relevant_docs array<string>, notes string"
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def write_zone(df: DataFrame, path: str, by: str | None = None) -> None:
    """A stored zone: cleaned texts, chunks (by strategy), vectors (by role), edges."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def upsert_points(points: DataFrame, stored: DataFrame | None) -> DataFrame:
    """The store after writing points (chunk_id, ...) keyed by their point id: new
    rows replace equal ids."""
    new = points.withColumn("point_id", point_id(F.col("chunk_id")))
    if stored is None:
        return new
    return stored.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def prune_points(stored: DataFrame, live: DataFrame) -> DataFrame:
    """The store without points whose chunk is gone."""
    keep = live.select(point_id(F.col("chunk_id")).alias("point_id"))
    return stored.join(keep, "point_id", "left_semi")


#: Buckets of a stored table of points; a bucket is what an update rewrites.
BUCKETS = 64


def _bucketed(points: DataFrame, buckets: int) -> DataFrame:
    return points.withColumn("bucket", F.pmod(F.xxhash64("point_id"), F.lit(buckets)).cast("int"))


def _overwrite(rows: DataFrame, touched: DataFrame, path: str, only: Column | None = None) -> None:
    """Replaces the touched buckets (column bucket) by rows, or by those of them for which
    `only`, a condition over the rows of a bucket, is true. Each gets a row without an id as well, so that one
    that has become empty is replaced, too. Rows are sent once, to their bucket."""
    blank = touched.select("bucket", *(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "bucket"))
    out = rows.unionByName(blank).repartition("bucket")
    if only is not None:
        out = out.withColumn("_only", only).where("point_id is null or _only").drop("_only", "_mark")
    out.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").partitionBy("bucket").parquet(path)


def _highest() -> Column:
    """The highest mark of a point's rows, which all lie in its bucket."""
    return F.max("_mark").over(Window.partitionBy("bucket", "point_id"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The stored points, with their bucket."""
    return spark.read.parquet(path).where("point_id is not null")


def write_points(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Stores points (chunk_id, ...) by hash bucket of their point id; ids are distinct."""
    rows = _bucketed(points.withColumn("point_id", point_id(F.col("chunk_id"))), buckets)
    _overwrite(rows, points.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")), path)


def _touched(spark: SparkSession, path: str, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The buckets of changed (column bucket), and the stored rows of those alone: the scan
    opens no other bucket's files."""
    touched = cut(changed.select("bucket").distinct())
    listed = [r[0] for r in touched.collect()]  # as many as there are buckets at most
    return touched, read_points(spark, path).where(F.col("bucket").isin(listed))


def upsert_in_place(points: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Points replace stored ones of equal id or are added: only the buckets that hold one of
    them are read and rewritten, each at once by a staged overwrite of its folder."""
    spark = points.sparkSession
    new = cut(_bucketed(points.withColumn("point_id", point_id(F.col("chunk_id"))), buckets))
    touched, stored = _touched(spark, path, new)
    marked = stored.withColumn("_mark", F.lit(0)).unionByName(new.select(stored.columns).withColumn("_mark", F.lit(1)))
    _overwrite(marked, touched, path, F.col("_mark") == _highest())


def prune_in_place(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Removes the points of chunks (chunk_id): only the buckets that hold one are rewritten."""
    spark = chunks.sparkSession
    gone = cut(_bucketed(chunks.select(point_id(F.col("chunk_id")).alias("point_id")), buckets))
    held = read_points(spark, path).select("point_id", "bucket").join(gone, ["point_id", "bucket"], "left_semi")
    touched, stored = _touched(spark, path, held)
    marks = gone.join(F.broadcast(touched), "bucket", "left_semi").withColumn("_mark", F.lit(1))
    marked = stored.withColumn("_mark", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    _overwrite(marked, touched, path, _highest() == 0)


def limited_categories(docs: DataFrame, most: int = 500, least_chars: int = 200) -> DataFrame:
    """Up to so many documents of each category that are long enough, numbered."""
    long_enough = docs.where(F.length(T.strip(F.col("text"))) >= least_chars)
    number = F.row_number().over(Window.partitionBy("category").orderBy("doc_id"))
    return long_enough.withColumn("number", number).where(F.col("number") <= most)
