"""JSON, JSONL, asset and index sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schemas


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Page arrays below a folder, one JSON array per file; unreadable rows become null rows
    that the row rules drop."""
    return (
        spark.read.schema(schemas.RAW_PAGE)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue document as one row per (category, book) in file order.

    Categories, and books of a category, are parsed one by one: an entry that is no object or has no name is left
    out and the others stay.
    """
    raw = spark.read.option("wholetext", True).text(path)
    categories = raw.select(F.posexplode(F.from_json("value", "MAP<STRING, STRING>")).alias("category_pos", "category", "info"))
    parsed = categories.select("category_pos", "category", F.from_json("info", "weight STRING, books ARRAY<STRING>").alias("c"))
    books = parsed.select(
        "category_pos", "category", F.coalesce(F.expr("try_cast(c.weight AS DOUBLE)"), F.lit(1.0)).alias("weight"), F.posexplode("c.books").alias("book_pos", "entry")
    ).withColumn("entry", F.from_json("entry", "name STRING, display_name STRING"))
    return books.where(F.length("entry.name") > 0).select(
        "category_pos", "category", "weight", "book_pos", F.col("entry.name").alias("book"), F.col("entry.display_name").alias("display_name"),
    )


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file with its path, for page maps, navigation files and manifests."""
    return (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json")
        .json(path)
        .withColumn("source_file", F.col("_metadata.file_path"))
    )


def read_correction_lines(spark: SparkSession, path: str) -> DataFrame:
    """Correction chunks, one JSON object per line; a malformed line fails the job."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    return lines.select(F.from_json("value", schemas.CORRECTION_ROW, {"mode": "FAILFAST"}).alias("row")).select("row.*")


def list_assets(spark: SparkSession, path: str, pattern: str = r"P0*(\d+)\.jpe?g", glob: str = "*.*") -> DataFrame:
    """Files whose name matches ``pattern`` with their number and change signature.

    Only listing columns are selected, so file contents are never read. Empty files are left out, as Spark's reader makes no row of them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return (
        files.select(name.alias("name"), "length", "modificationTime")
        .withColumn("page_key", F.regexp_extract("name", f"(?i)^{pattern}$", 1))
        .where(F.col("page_key") != "")
        .select("page_key", "name", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    )


def write_jsonl(df: DataFrame, path: str) -> None:
    """One compact JSON object per row."""
    df.write.mode("overwrite").json(path)


def write_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Persist chunks with their vectors, partitioned by source class."""
    joined = chunks.join(vectors, "vec_id", "left")
    joined.write.mode("overwrite").partitionBy("source_class").parquet(path)


def verify_index(index: DataFrame) -> DataFrame:
    """Counts of a published index by class, with and without a printed page number."""
    return index.groupBy(F.coalesce("source_class", F.lit("unknown")).alias("source_class")).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("logical_page").isNotNull()).alias("with_logical_page"),
        F.count_if(F.col("logical_page").isNull()).alias("without_logical_page"),
    )


def sample_index(index: DataFrame, n: int = 5, preview: int = 120) -> DataFrame:
    """First chunks of an index by key (corrections, which have no page, behind the pages of their book), with a text preview."""
    return (
        index.orderBy("book", F.col("pdf_page").asc_nulls_last(), "chunk", "text")
        .limit(n)
        .select("book", "pdf_page", "chunk", F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, preview).alias("preview"))
    )
