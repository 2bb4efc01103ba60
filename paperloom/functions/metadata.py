"""Bibliographic fields: tags, authors, identifiers, titles, years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag_list(column: str) -> Column:
    """The parts of a keyword field (parted by comma or semicolon of either width), trimmed, none blank, none twice."""
    return F.array_distinct(F.filter(F.transform(F.split(column, "[,;，；]"), lambda x: F.trim(x)), lambda x: x != ""))


def tags(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id, position, tag) of every tag of every row; null and blank fields give none."""
    return df.select(id_col, F.posexplode(tag_list(column)).alias("position", "tag"))


def author_list(column: Column) -> Column:
    """Names of an author field: parted by semicolons if it has any, else by commas; trimmed, none blank. A null field
    has none."""
    parts = F.when(column.contains(";"), F.split(column, ";")).otherwise(F.split(column, ","))
    return F.coalesce(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def author_json(column: Column) -> Column:
    """The names as JSON records with a role."""
    return F.to_json(F.transform(author_list(column), lambda x: F.struct(x.alias("name"), F.lit("author").alias("role"))))


def bare_doi(column: Column) -> Column:
    """A DOI in lower case without resolver address or label; null if nothing is left."""
    bare = F.lower(F.regexp_replace(F.trim(column), r"^(?i:https?://[^/]+/|doi:\s*)", ""))
    return F.when(bare != "", bare)


def find_doi(column: Column) -> Column:
    """The first DOI in a text, without punctuation at its end; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(column, r"(10\.\d{4,9}/[^\s\"<>]+)", 1)), r"[.,;:)\]}]+$", "")


def find_arxiv(column: Column) -> Column:
    """The first arXiv identifier in a text, without its version; empty if there is none."""
    return F.regexp_extract(column, r"(?i)arxiv[:/\s]*(?:abs/)?(\d{4}\.\d{4,5}|[a-z-]+/\d{7})", 1)


def find_year(column: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    year = F.regexp_extract(column, r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1)
    return F.when(year != "", year.cast("int"))


def clean_title(column: Column) -> Column:
    """A title without markup and line breaks: tags stripped, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(column, r"<[^>]*>", " "), r"\s+", " "))
