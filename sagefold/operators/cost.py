"""What model calls will cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

OUTPUT_TOKENS, BATCH_FACTOR, SYNTHESIS_SHARE = 5000, 0.5, 0.15


def estimate(requests: DataFrame, prices: DataFrame, by: list[str], ratio: float = 1.0, batch: bool = True) -> DataFrame:
    """(by..., model, requests, input_tokens, output_tokens, known_price, extract_usd, synth_usd, total_usd).

    ``requests``: (by..., model, text); ``prices``: (model, input_price, output_price) a million tokens.
    """
    tokens = F.floor(X.est_tokens(F.col("text")) * F.lit(ratio)).cast("long")
    sums = requests.groupBy(*by, "model").agg(F.count(F.lit(1)).alias("requests"), F.sum(tokens).alias("input_tokens")).withColumn("output_tokens", F.col("requests") * OUTPUT_TOKENS)
    priced = sums.join(prices, "model", "left")
    cost = F.col("input_tokens") / 1e6 * F.col("input_price") + F.col("output_tokens") / 1e6 * F.col("output_price")
    extract, synth = F.coalesce(cost * (BATCH_FACTOR if batch else 1.0), F.lit(0.0)), F.coalesce(cost * SYNTHESIS_SHARE, F.lit(0.0))
    return priced.select(*by, "model", "requests", "input_tokens", "output_tokens", F.col("input_price").isNotNull().alias("known_price"), extract.alias("extract_usd"), synth.alias("synth_usd"), (extract + synth).alias("total_usd"))


def total(estimates: DataFrame, by: list[str]) -> DataFrame:
    """The sum of estimates; the price is known where each one's is."""
    sums = [F.sum(c).alias(c) for c in ("requests", "input_tokens", "output_tokens", "extract_usd", "synth_usd", "total_usd")]
    return estimates.groupBy(*by).agg(*sums, F.bool_and("known_price").alias("known_price"))


def allowed(estimates: DataFrame, cap: float) -> DataFrame:
    """Estimates with ``approved``: the price is known and no more than the cap."""
    return estimates.withColumn("approved", F.col("known_price") & (F.col("total_usd") <= cap))
