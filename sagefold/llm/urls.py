"""URL filter: a blocked Bloom filter before an exact hash join.

A listed URL is a host and a path prefix; it fits the host and its subdomains,
for paths that start with its path.  The longest listed one that fits wins.

Each URL gives candidate keys: suffixes of its host with prefixes of its path, of
the lengths that listed paths have.  A blocked Bloom filter of the listed keys
(each key has its bits in one block of 256) lets pass those that may be listed;
an exact hash join on the key removes the false positives.  The filter's size
is bounded; a list beyond that makes more false positives for the join and
changes no result.

Null URLs and those without ``://`` have empty host and path and fit nothing.
Repeated rows each get their verdict; of equal entries the smallest action counts.
Very long URLs give a key for each label of their host and listed length.  An
empty list allows everything, an empty table gives an empty result.  Of the
pages' columns only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_host(host: Column) -> Column:
    """Without user, port and final dots: what a list of hosts means by a host."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "(?s)^.*@", ""), ":[0-9]*$", ""), r"\.+$", "")


def canonical_path(path: Column) -> Column:
    """Slashes in a row are one; an empty path is the root's."""
    return F.when(path == "", "/").otherwise(F.regexp_replace(path, "/+", "/"))


#: Entries up to which the list is broadcast in the exact join (some 20 MB); beyond, both sides are shuffled.
MOST_BROADCAST = 200_000


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, action, priority) of every row; the last three are null where nothing listed fits.

    ``rules``: (host, path, action, priority, canonical), hosts in lower case; the
    highest priority wins, then the longest; of equal ones the smallest action
    counts.  Entries with ``canonical`` fit the canonical host and path, others the
    URL's as they stand.
    """
    form = F.when(F.col("canonical"), "c").otherwise("r")
    listed = rules.groupBy("host", "path", "priority", "canonical").agg(F.min("action").alias("action"))
    listed = listed.select(F.concat("host", "path").alias("rule"), "action", "priority", F.concat_ws("\n", form, "host", "path").alias("key"), F.length("path").alias("path_length"))
    # Lengths of URL paths are few, whatever the list's size.
    lengths = sorted(r[0] for r in listed.select("path_length").distinct().collect())
    many = listed.count()
    blocks = bloom.block_count(many)
    at = pages.select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))

    def keys(kind: str, host: Column, path: Column) -> Column:
        labels = F.split(host, r"\.", -1)
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        fitting = F.filter(F.array(*(F.lit(n) for n in lengths)).cast("array<int>"), lambda n: n <= F.length(path))
        return F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: F.concat_ws("\n", F.lit(kind), h, path.substr(F.lit(1), n)))))

    host, path = F.col("host"), F.col("path")
    both = F.array_union(keys("r", host, path), keys("c", F.col("_host"), F.col("_path")))
    # URLs without a host fit nothing: they are many at times and would meet in one task
    hosted = at.filter(host != "")
    distinct = hosted.select("host", "path").distinct().withColumns({"_host": canonical_host(host), "_path": canonical_path(path)})
    candidates = distinct.select("host", "path", F.explode(both).alias("key"))
    passed = bloom.passing(candidates, F.col("key"), bloom.build(listed, F.col("key"), blocks), blocks)
    hits = passed.select("host", "path", "key").join(F.broadcast(listed) if many <= MOST_BROADCAST else listed, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("priority", F.length("rule").alias("n"), "rule", "action")).alias("best"))
    columns = [F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"), F.col("best.priority").alias("priority")]
    none = at.filter(host == "").withColumn("best", F.lit(None).cast(best.schema["best"].dataType))
    return hosted.join(best, ["host", "path"], "left").select(columns).unionByName(none.select(columns))
