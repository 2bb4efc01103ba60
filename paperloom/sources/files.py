"""Files as rows: fingerprints, validity, images, word-processor paragraphs and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, fingerprint): files with their SHA-256; the content is hashed where it is read and not kept. The
    reader gives no row for an empty file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("fingerprint"))


def file_problems(length: Column, pages: Column, encrypted: Column, most: int = 50 * 1024 * 1024) -> Column:
    """What keeps a file from being taken in: empty, too large, encrypted or without pages; an empty list if nothing."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(length, F.lit(0)) <= 0, "EMPTY"), F.when(length > most, "TOO_LARGE"), F.when(F.coalesce(encrypted, F.lit(False)), "ENCRYPTED"),
            F.when(F.coalesce(pages, F.lit(0)) < 1, "NO_PAGES"),
        )
    )


def same_files(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New files with the least path of a stored file of the same fingerprint, if there is one."""
    known = stored.groupBy("fingerprint").agg(F.min("path").alias("same_as"))
    return new.join(known, "fingerprint", "left").select("path", "fingerprint", "same_as")


def useful_images(images: DataFrame, least: int = 100) -> DataFrame:
    """Images of at least ``least`` pixels either way."""
    return images.filter((F.col("width") >= least) & (F.col("height") >= least))


def word_text(parts: DataFrame, id_col: str) -> DataFrame:
    """(id, text): paragraphs and table rows of a document in order, a row's cells parted by bars, blank ones left out.

    ``parts`` has id, pos, kind (paragraph or row), text, and cells (array)."""
    line = F.when(F.col("kind") == "row", F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")).otherwise(F.trim("text"))
    own = parts.withColumn("line", line).filter("line != ''")
    return own.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
