"""Incremental maintenance: what changed, what counts, what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 3


def refresh(feed: DataFrame, watermark: Column, updated: str = "updated_at") -> DataFrame:
    """Rows at or after the high-water mark: inclusive, as equal stamps may hide a change."""
    return feed.filter(F.col(updated) >= watermark)


def watermark(feed: DataFrame, updated: str = "updated_at", by: list[str] | None = None) -> DataFrame:
    return feed.groupBy(*(by or [])).agg(F.max(updated).alias("watermark"))


def newest(feed: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """A cap on the rows of a feed that comes newest first."""
    return feed.orderBy(*order).limit(n)


def dirty(units: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Units whose content no generation has: new ones and changed ones."""
    return units.join(ledger.select(*keys, "hash"), [*keys, "hash"], "left_anti")


def latest_generation(gen_prs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., gen): the newest generation of each pull request."""
    return gen_prs.groupBy(*keys).agg(F.max("gen").alias("gen"))


def current_evidence(evidence: DataFrame, gen_prs: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence from each pull request's newest generation; older extractions no longer count."""
    return evidence.join(latest_generation(gen_prs, keys), [*keys, "gen"], "left_semi")


def unfolded(candidates: DataFrame, folded: DataFrame, key: str = "gen") -> DataFrame:
    return candidates.join(folded.select(key).distinct(), key, "left_anti")


def unsent(requests: DataFrame, results: DataFrame, in_flight: DataFrame) -> DataFrame:
    """Requests without a good result that no batch is working on."""
    good = results.filter("error is null or error = ''").select("id")
    return requests.join(good, "id", "left_anti").join(in_flight.select("id"), "id", "left_anti")


def failures(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(id, error) of requests that have no good result."""
    met = requests.select("id").join(results.select("id", "error"), "id", "left")
    known = results.select("id").withColumn("_there", F.lit(True))
    return met.join(known, "id", "left").filter("_there is null or error <> ''").select("id", F.when(F.col("_there").isNull(), "missing").otherwise(F.col("error")).alias("error"))


def generation_status(generations: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """(gen, requests, missing, failed, next_status): extracted once all is there, or after the last attempt.

    Until then a sent generation stays as it is, and failed requests are sent again.

    ``generations``: (gen, status, attempts); ``requests``: (gen, id).
    """
    state = requests.join(results.select("id", F.coalesce("error", F.lit("")).alias("error"), F.lit(True).alias("there")), "id", "left")
    counts = state.groupBy("gen").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("there").isNull()).alias("missing"), F.count_if(F.col("error") != "").alias("failed"))
    met = generations.join(counts, "gen", "left").fillna(0, ["requests", "missing", "failed"])
    done = (F.col("missing") == 0) & ((F.col("failed") == 0) | (F.col("attempts") + 1 >= ATTEMPTS))
    following = F.when((F.col("status") == "submitted") & done, "extracted").otherwise(F.col("status"))
    return met.select("gen", "status", "requests", "missing", "failed", following.alias("next_status"))


def status(generations: DataFrame) -> DataFrame:
    """One row: chunks, pending and extracted generations."""
    return generations.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("status") != "extracted").alias("pending"), F.count_if(F.col("status") == "extracted").alias("extracted"))
