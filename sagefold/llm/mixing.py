"""Mixing sources to target weights by a low-discrepancy schedule.

* Sources, in the order of their code points with null last, weigh 1, 2, 3 and
  so on, repeating.  They share all words by weight; a target stops at ``most``
  times its source's words, what is left over is shared again.
* Each source's documents are shuffled (by a hash) and laid end to end; the line
  is cut into blocks of equal numbers of words, the last one being shorter.
* Slot i of the schedule has the point i * golden ratio, modulo 1.  Cumulative
  weights map points to sources, so that every stretch of the schedule has its
  share of each source.  The slot's rank among its source's slots, modulo the
  source's blocks, is its block; the joined blocks are the mix.

Prefix sums go over two levels, each of about the square root of the rows: no
task holds a whole source.  All of it runs as built-in expressions, in integers:
reruns agree.

Null and empty texts have size 0 and take no part: 0 words are taken.  Repeated
rows are rows of their own.  Documents with equal hashes lie in the order of their ids and
sizes.  A very long text reaches over several blocks.  Of the input's columns only
the id, the text and the source are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, materialise, word_count

WEIGHTS = (1, 2, 3)
#: Blocks of a source at least, and words of a block at most.
BLOCKS, BLOCK_WORDS = 2048, 65_536
#: Points are multiples of 2**-31; the golden ratio as such a multiple, made odd.
ONE, GOLDEN = 1 << 31, 1_327_217_885
#: Rows up to which a table (of sources, of sums, of blocks) is broadcast.
MOST_BROADCAST = 100_000


def targets(sizes: dict[str | None, int], most: int = 3) -> dict[str | None, float]:
    """Each source's target in words."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[k % len(WEIGHTS)] for k, s in enumerate(order)}
    total, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        left, shares = total - sum(out.values()), sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / shares > most * sizes[s]]
        if not above:
            out.update({s: left * weight[s] / shares for s in open_})
            break
        out.update({s: float(most * sizes[s]) for s in above})
        open_ = [s for s in open_ if s not in set(above)]
    return {s: out[s] for s in order}


def _root(n: int) -> int:
    return max(64, math.isqrt(max(n, 1)))


def plan(documents: DataFrame, most: int = 3) -> DataFrame:
    """(source, no, source_size, target, width, blocks, groups, lo, hi) of each source.

    ``documents``: (source, size).  One row per source goes to the driver.
    ``width``: words of a block; ``groups``: of the two-level sums; ``lo``,
    ``hi``: the source's points.
    """
    spark = documents.sparkSession
    rows = documents.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    sizes, many = {r["source"]: r["size"] for r in rows}, {r["source"]: r["n"] for r in rows}
    wanted = targets(sizes, most)
    width = {s: min(BLOCK_WORDS, max(1, sizes[s] // BLOCKS)) for s in sizes}
    slots = {s: wanted[s] / width[s] for s in sizes}
    total, at, out = sum(slots.values()), 0.0, []
    for no, s in enumerate(wanted):
        lo, at = at, at + slots[s]
        out.append((s, no, sizes[s], wanted[s], width[s], -(-sizes[s] // width[s]), max(1, many[s] // _root(many[s])), round(lo / total * ONE) if total else 0, round(at / total * ONE) if total else 0, slots[s]))
    return local_table(spark, out, "source string, no int, source_size long, target double, width long, blocks long, groups long, lo long, hi long, slots double")


def _with(left: DataFrame, sources: DataFrame, on: Column | list[str], n: int) -> DataFrame:
    return left.join(F.broadcast(sources) if n <= MOST_BROADCAST else sources, on)


def _with_stored(left: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join with a stored table, by its number of rows: packed as it is on disk, its size there says little."""
    return left.join(F.broadcast(table) if table.count() <= MOST_BROADCAST else table.hint("merge"), on, how)


def schedule(spark, sources: DataFrame, most: int = 3) -> DataFrame:
    """(slot, no, rank, block, pass): the mix in its order.  Slots beyond ``most`` passes of a source fall away."""
    listed = sources.select("no", "blocks", "lo", "hi", "slots").collect()
    n = round(sum(r["slots"] for r in listed))
    cells = 1 << max(1, (4 * len(listed)).bit_length())
    step = ONE // cells
    grid = [(c, r["no"], r["blocks"], r["lo"], r["hi"]) for r in listed if r["hi"] > r["lo"] for c in range(r["lo"] // step, (r["hi"] - 1) // step + 1)]
    table = local_table(spark, grid, "cell long, no int, blocks long, lo long, hi long")
    group = _root(n)
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(ONE)) * F.lit(GOLDEN), F.lit(ONE)).alias("u"))
    slots = _with(slots.withColumn("cell", F.expr(f"u div {step}")), table, ["cell"], len(grid)).filter("lo <= u and u < hi").select("slot", "no", "blocks", F.expr(f"slot div {group}").alias("part"))
    slots = materialise(slots, "slots")
    counted = slots.groupBy("no", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counted.select("no", "part", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = slots.withColumn("in_part", F.row_number().over(Window.partitionBy("no", "part").orderBy("slot")) - 1).join(before, ["no", "part"])
    ranked = ranked.select("slot", "no", "blocks", (F.col("before") + F.col("in_part")).alias("rank"))
    return ranked.filter(F.col("rank") < most * F.col("blocks")).select("slot", "no", "rank", F.pmod("rank", "blocks").alias("block"), F.expr("rank div blocks").alias("pass"))


def _times(spark, sources: DataFrame, most: int) -> DataFrame:
    """(no, block, times): how often the mix has a block."""
    return materialise(schedule(spark, sources, most).groupBy("no", "block").agg(F.count(F.lit(1)).alias("times")), "times")


def lines(documents: DataFrame, sources: DataFrame, n_sources: int, seed: int = 0) -> DataFrame:
    """``documents`` (id, source, size) with their source's columns and ``at``, where they begin in their source's line.

    The sums of parts are stored: their plan and the one that uses them are not on
    the driver at once.
    """
    hashed = _with(documents.filter("size > 0").withColumnRenamed("source", "_source"), sources, F.col("_source").eqNullSafe(F.col("source")), n_sources)
    hashed = hashed.withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(seed))).withColumn("part", F.pmod("h", "groups")).drop("_source")
    sums = hashed.groupBy("no", "part").agg(F.sum("size").alias("n"))
    before = sums.select("no", "part", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = materialise(before, "sums")
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("no", "part").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _with_stored(hashed.withColumn("inner", inner), before, ["no", "part"]).withColumn("at", F.col("before") + F.col("inner")).drop("inner", "before", "h", "part")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every row: the words of it that the mix takes."""
    spark = docs.sparkSession
    documents = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    sources = plan(documents, most)
    n_sources = len(sources.collect())
    times = _times(spark, sources, most)
    placed = lines(documents, sources, n_sources)
    last = F.col("at") + F.col("size")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr("at div width"), F.expr("(at + size - 1) div width"))))
    overlap = F.least(last, (F.col("block") + 1) * F.col("width")) - F.greatest("at", F.col("block") * F.col("width"))
    met = _with_stored(pieces, times, ["no", "block"], "left").groupBy("id", "no", "source", "size", "source_size", "target", "at").agg(F.sum(overlap * F.coalesce("times", F.lit(0))).alias("taken"))
    none = _with(documents.filter("size = 0").withColumnRenamed("source", "_source"), sources, F.col("_source").eqNullSafe(F.col("source")), n_sources)
    columns = ["id", "source", "size", "source_size", "target", "taken"]
    return met.select(columns).unionByName(none.withColumn("taken", F.lit(0).cast("long")).select(columns)).withColumnRenamed("id", id_col)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3) -> DataFrame:
    """(id, times): how often the mix takes a document, where blocks hold whole documents.

    A document belongs to the block of its first word.  Documents without words
    are taken once.  Rows with the same id get the times of the first of them.
    """
    spark = docs.sparkSession
    documents = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size")), "sizes")
    sources = plan(documents, most)
    times = _times(spark, sources, most)
    placed = lines(documents, sources, len(sources.collect())).withColumn("block", F.expr("at div width"))
    met = _with_stored(placed, times, ["no", "block"], "left").select("id", "at", F.coalesce("times", F.lit(0)).alias("times"))
    return met.groupBy("id").agg(F.min_by("times", "at").alias("times")).withColumnRenamed("id", id_col)
