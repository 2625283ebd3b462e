"""Secret scan: known forms, and a battery of randomness tests.

Known forms (``assign``, ``access``, ``hex``) are regular expressions.  Besides,
every token of 20 or more characters of an encoding's alphabet is a candidate:

* its encoding is inferred from its characters: decimal, hex, base32, letters of
  one case, base62, base64;
* three tests ask how usual it would be for random characters of that encoding:
  chi-squared for equal frequencies, the number of runs above and below the
  middle of the alphabet, and the correlation of neighbours.  The smallest of
  the three probabilities, corrected for taking the smallest, is the token's p;
* for random tokens p is uniform, for words it is near 0.  So twice the number
  of tokens with p over 1/2 estimates how many random ones there are, and for
  any cut the false ones among those above it.  For each stratum of encoding and
  length the lowest cut whose estimated false-discovery rate is at most ``rate``
  decides, with histograms over all candidates of the corpus.  A stratum of few
  candidates takes in the nearest lengths of its encoding, and the estimate counts
  one token more than it sees, so that a lone random token is not ruled out.

Candidates that overlap a known form stay with that form.  All of it runs as
built-in expressions.

Null and empty texts have no spans.  Repeated rows each have their spans (and
count each in the histograms).  Spans that begin together come in the order of
KINDS.  Time is linear in texts and spans, also for very long texts.  Of the
input's columns only the id and the text are read.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, span_text, spans_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"

KINDS = ["assign", "access", "hex", "random"]
#: Alphabets in the order in which encodings are tried.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Bins of the histogram of p.
BINS = 200
#: Candidates of a stratum from which its own histogram decides; below, neighbouring lengths are added.
LEAST = 50


def _as(spans: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["m"].alias("m")))


def known(text: Column) -> Column:
    """array<struct<s, k, e, kind, m>>: the known forms."""
    assign = F.filter(spans_of(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    return F.concat(_as(assign, "assign"), _as(spans_of(text, ACCESS, "AKIA"), "access"), _as(spans_of(text, HEX), "hex"))


def normal_tail(z: Column) -> Column:
    """1 - the normal distribution at z; error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, upper).otherwise(1 - upper)


def measure(candidates: DataFrame, token: str = "m") -> DataFrame:
    """``candidates`` with encoding, n, p_chi, p_runs, p_serial and p of the column ``token``."""
    body = F.regexp_replace(F.col(token), "=+$", "")
    inferred, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, letters in reversed(ALPHABETS.items()):
        fits = F.translate("_body", letters, "") == ""
        inferred, alphabet = F.when(fits, name).otherwise(inferred), F.when(fits, letters).otherwise(alphabet)
    df = candidates.withColumn("_body", body).withColumns({"encoding": inferred, "_alphabet": alphabet, "n": F.length("_body").cast("double")})
    df = df.withColumn("_size", F.length("_alphabet").cast("double"))
    # chi-squared over the alphabet; its cube root is nearly normal
    squares = F.aggregate(F.split("_alphabet", ""), F.lit(0.0), lambda s, c: s + F.pow((F.length("_body") - F.length(F.replace(F.col("_body"), c, F.lit("")))).cast("double"), F.lit(2.0)))
    df = df.withColumn("_chi", squares * F.col("_size") / F.col("n") - F.col("n"))
    freedom = F.col("_size") - 1
    z_chi = (F.pow(F.col("_chi") / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    # runs above and below the middle of the alphabet
    codes = F.transform(F.split("_body", ""), lambda c: F.instr(F.col("_alphabet"), c).cast("double"))
    df = df.withColumn("_codes", codes)
    middle = (F.col("_size") + 1) / 2
    sides = F.array_join(F.transform("_codes", lambda x: F.when(x > middle, "h").otherwise("l")), "")
    df = df.withColumn("_sides", sides)
    high = F.length(F.replace("_sides", F.lit("l"), F.lit(""))).cast("double")
    low = F.col("n") - high
    runs = F.length(F.regexp_replace("_sides", "h+|l+", "x")).cast("double")
    expected = 2 * high * low / F.col("n") + 1
    variance = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    z_runs = F.when(variance > 0, (runs - expected) / F.sqrt(variance)).otherwise(F.lit(9.0))
    # correlation of neighbours
    mean = F.aggregate("_codes", F.lit(0.0), lambda s, x: s + x) / F.col("n")
    df = df.withColumns({"_mean": mean, "_z_runs": z_runs, "_z_chi": z_chi})
    spread = F.aggregate("_codes", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    last = F.col("n").cast("int") - 1
    together = F.aggregate(F.zip_with(F.slice("_codes", F.lit(1), last), F.slice("_codes", F.lit(2), last), lambda x, y: (x - F.col("_mean")) * (y - F.col("_mean"))), F.lit(0.0), lambda s, x: s + x)
    df = df.withColumns({"_spread": spread, "_together": together})
    z_serial = F.when(F.col("_spread") > 0, (F.col("_together") / F.col("_spread") + 1 / F.col("n")) * F.sqrt("n")).otherwise(F.lit(9.0))
    two_sided = lambda z: F.least(F.lit(1.0), 2 * normal_tail(F.abs(z)))
    df = df.withColumns({"p_chi": F.greatest(F.lit(0.0), F.least(F.lit(1.0), normal_tail(F.col("_z_chi")))), "p_runs": two_sided(F.col("_z_runs")), "p_serial": two_sided(z_serial)})
    df = df.withColumn("p", 1 - F.pow(1 - F.least("p_chi", "p_runs", "p_serial"), F.lit(3.0)))
    return df.drop("_body", "_alphabet", "_size", "_chi", "_codes", "_sides", "_mean", "_z_runs", "_z_chi", "_spread", "_together")


def length_bin(n: Column) -> Column:
    """Strata of length: powers of the square root of 2."""
    return F.floor(2 * F.log2(n)).cast("int")


def cuts(measured: DataFrame, rate: float) -> dict[tuple[str, int], float]:
    """For each stratum the lowest p from which tokens count as random.

    The histograms have a row for each encoding, stratum and bin: some thousands,
    whatever the input.
    """
    bins = F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int")
    rows = measured.groupBy("encoding", length_bin(F.col("n")).alias("stratum"), bins.alias("bin")).count().collect()
    by: dict[tuple[str, int], list[int]] = {}
    for r in rows:
        by.setdefault((r["encoding"], r["stratum"]), [0] * BINS)[r["bin"]] += r["count"]
    return {key: _cut(_pooled(by, key), rate) for key in by}


def _pooled(by: dict[tuple[str, int], list[int]], key: tuple[str, int]) -> list[int]:
    """The stratum's histogram; below LEAST candidates with those of the nearest lengths of its encoding."""
    encoding, stratum = key
    apart = sorted({abs(s - stratum) for e, s in by if e == encoding})
    counts = [0] * BINS
    for far in apart:
        for at in {stratum - far, stratum + far}:
            counts = [a + b for a, b in zip(counts, by.get((encoding, at), [0] * BINS), strict=True)]
        if sum(counts) >= LEAST:
            break
    return counts


def _cut(counts: list[int], rate: float) -> float:
    """The lowest p from which tokens of a histogram count as random."""
    # one more than is seen: no random token over 1/2 does not mean that there is none
    random = min(sum(counts), 2 * (sum(counts[BINS // 2 :]) + 1))
    cut, found = 1.0, 0
    for k in range(BINS - 1, -1, -1):
        found += counts[k]
        true = random * (BINS - k) / BINS
        if found and max(0.0, found - true) / found <= rate:
            cut = k / BINS
    # the lowest bin holds the words as well; a random token is there once in BINS
    return max(cut, 1 / BINS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05) -> DataFrame:
    """(id, base, spans): arrays of struct<s, k, e, kind> by start and kind; ``base`` has the known forms alone."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.select(F.col(f"`{id_col}`").alias(id_col), known(text).alias("base"), _as(spans_of(text, TOKEN), "random").alias("tokens"))
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    stored = materialise(found.withColumn("tokens", apart).withColumn("row", F.monotonically_increasing_id()), "secrets")
    measured = materialise(measure(stored.filter(F.size("tokens") > 0).select("row", F.explode("tokens").alias("t")).select("row", F.col("t.s").alias("s"), F.col("t.e").alias("e"), F.col("t.m").alias("m"))).select("row", "s", "e", "encoding", "n", "p"), "tokens")
    chosen = F.lit(False)
    for (encoding, stratum), cut in sorted(cuts(measured, rate).items()):
        chosen = chosen | ((F.col("encoding") == encoding) & (length_bin(F.col("n")) == stratum) & (F.col("p") >= cut))
    random = measured.filter(chosen).groupBy("row").agg(F.collect_list(F.struct("s", F.lit(KINDS.index("random")).alias("k"), "e", F.lit("random").alias("kind"))).alias("more"))
    bare = F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")))
    joined = stored.select(id_col, "row", bare.alias("base")).join(random, "row", "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")
    return joined.select(id_col, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))


def digest(spans: Column) -> Column:
    return span_text(spans)
