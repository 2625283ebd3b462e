"""Scans of stored raw data: pages, JSON lines, documents, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import RAW_PR


def from_wire(wire: DataFrame) -> DataFrame:
    """Stored form of rows as the interface sends them: connections become arrays, counts numbers, missing lines 0."""

    def comment(c: Column) -> Column:
        plain = [c[k].alias(k) for k in ("id", "url", "body", "createdAt", "diffHunk", "author", "authorAssociation")]
        return F.struct(*plain, F.coalesce(c["thumbsUp"]["totalCount"], F.lit(0)).alias("thumbsUp"), F.coalesce(c["thumbsDown"]["totalCount"], F.lit(0)).alias("thumbsDown"))

    def thread(t: Column) -> Column:
        plain = [t[k].alias(k) for k in ("id", "path")]
        return F.struct(*plain, F.coalesce(t["line"], F.lit(0)).alias("line"), t["isResolved"].alias("isResolved"), t["isOutdated"].alias("isOutdated"), F.coalesce(t["comments"]["totalCount"], F.lit(0)).alias("commentsTotal"), F.transform(t["comments"]["nodes"], comment).alias("comments"))

    kept = ["number", "title", "body", "url", "state", "merged", "createdAt", "updatedAt", "mergedAt", "author", "authorAssociation"]
    return wire.select(
        *kept,
        F.transform("labels.nodes", lambda x: x["name"]).alias("labels"),
        F.transform("files.nodes", lambda x: x["path"]).alias("files"),
        F.coalesce("files.totalCount", F.lit(0)).alias("filesTotal"),
        F.col("reviews.nodes").alias("reviews"),
        F.transform("reviewThreads.nodes", thread).alias("threads"),
        F.transform("comments.nodes", comment).alias("comments"),
    )


def load_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All versions in a folder's pages with ``read_order``: pages by name, then lines as they stand."""
    rows = spark.read.schema(RAW_PR).option("mode", "FAILFAST").json(f"{folder}/page-*.jsonl")
    return rows.withColumn("read_order", F.struct(F.col("_metadata.file_path").alias("page"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a broken one fails the scan."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON document; None where there is none."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """(host, owner, name, key) of a list's lines in their order, comments and blank lines left out, each repository once."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), X.trim_ws(F.split("value", "#", 2)[0]).alias("line")).filter("line <> ''")
    parsed = lines.select("at", X.parse_repo(F.col("line")).alias("p")).filter("p is not null")
    keyed = parsed.select("at", "p.host", "p.owner", "p.name", F.lower(F.concat_ws("/", "p.host", "p.owner", "p.name")).alias("key"))
    first = keyed.groupBy("key").agg(F.min_by(F.struct("host", "owner", "name"), "at").alias("p"), F.min("at").alias("at"))
    return first.orderBy("at").select("p.host", "p.owner", "p.name", "key")


def discover(spark: SparkSession, cache: str) -> DataFrame:
    """(owner, name) of the repositories whose state lies in a cache folder."""
    found = spark.read.text(f"{cache}/*/*/fetch_state.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"))
    part = lambda k: F.regexp_extract("path", r"/([^/]+)/([^/]+)/fetch_state\.json$", k)
    return found.select(part(1).alias("owner"), part(2).alias("name")).distinct()
