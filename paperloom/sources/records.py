"""Record sources: JSON lines that are upserted by key, Atom feeds, bibliographic JSON records, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.metadata import clean_title
from paperloom.functions.text import first_nonempty


def read_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, line, damaged): lines of JSON with the value of one of their fields. Blank lines are left out; lines that
    are no JSON object are kept, with a null key."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    sound = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    return lines.select(F.when(sound, F.get_json_object("value", f"$.{key}")).alias("key"), F.col("value").alias("line"), (~sound).alias("damaged"))


def upsert_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old lines with the new ones in the place of those of the same key; lines without a key stay as they are."""
    kept = old.join(new.filter("key is not null").select("key").distinct(), "key", "left_anti").select("key", "line", "damaged")
    latest = new.filter("key is not null").groupBy("key").agg(F.max_by(F.struct("line", "damaged"), F.length("line")).alias("r")).select("key", "r.*")
    return kept.unionByName(latest).unionByName(new.filter("key is null"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of one value each, by an explicit schema; nothing is inferred."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_atom(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, entry_no, entry_id, title, summary, authors, published, doi): the entries of Atom feeds in a column. A text
    without entries gives no row; missing fields are null."""
    entries = df.select(id_col, F.posexplode(F.regexp_extract_all(F.coalesce(xml_col, F.lit("")), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))).alias("entry_no", "e"))

    def field(name: str):
        found = F.regexp_extract("e", rf"(?s)<{name}\b[^>]*>(.*?)</{name}>", 1)
        return first_nonempty(clean_title(found))

    names = F.transform(F.regexp_extract_all("e", F.lit(r"(?s)<author\b[^>]*>.*?<name>(.*?)</name>"), F.lit(1)), lambda x: F.trim(x))
    return entries.select(
        id_col, "entry_no", F.regexp_replace(field("id"), r"^https?://[^/]+/abs/|v\d+$", "").alias("entry_id"), field("title").alias("title"), field("summary").alias("summary"),
        names.alias("authors"), F.to_date(F.substring(field("published"), 1, 10)).alias("published"), field("(?:\\w+:)?doi").alias("doi"),
    )


#: Schema of a bibliographic service's record.
WORK = """struct<message struct<title array<string>, `container-title` array<string>, DOI string, abstract string,
author array<struct<given string, family string, name string>>,
`published-print` struct<`date-parts` array<array<int>>>, `published-online` struct<`date-parts` array<array<int>>>, issued struct<`date-parts` array<array<int>>>>>"""


def parse_works(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, title, source, doi, authors, year, abstract): records of a bibliographic service. First title and venue,
    the year in print, else online, else issued; authors joined by semicolons; tags stripped from the abstract, which
    is cut at 3 000 characters. A damaged record has nulls."""
    m = df.select(id_col, F.from_json(json_col, WORK)["message"].alias("m"))
    year = lambda c: F.get(F.get(F.col(f"m.{c}.date-parts"), 0), 0)
    names = F.transform("m.author", lambda a: F.coalesce(a["name"], F.concat_ws(" ", a["given"], a["family"])))
    return m.select(
        id_col, clean_title(F.get("m.title", 0)).alias("title"), clean_title(F.get(F.col("m.container-title"), 0)).alias("source"), F.lower("m.DOI").alias("doi"),
        F.array_join(F.filter(names, lambda x: x != ""), "; ").alias("authors"), F.coalesce(year("published-print"), year("published-online"), year("issued")).alias("year"),
        F.substring(clean_title(F.col("m.abstract")), 1, 3000).alias("abstract"),
    )
