"""N-gram Jaccard join by chosen paths (as in CPSJoin).

1. A document's set has its shingles of five words.  Documents with equal sets
   are copies of each other: one represents them from here on, with their number.
2. Each set gets a signature of 128 minima; two sets share a place of it with
   the probability of their Jaccard similarity.
3. Chosen paths: a node of the tree picks places of the signature at random (1/t
   on average for threshold t); a set goes down to the child that belongs to its
   value there, so that similar sets stay together and others part.  A child
   with one set ends; one with few sets is a leaf; others go on, down to
   ``depth``.  ``runs`` trees repeat it until the target recall: at the
   threshold a pair stays together with probability 0.84 a level at depth one,
   and with eight runs over 0.99 of them meet at the last level.  ``runs_for``
   gives the number for the depth that trees may reach.
4. Leaves are compared by brute force: signatures first, then the sets
   themselves, exactly.  Leaves that stay large at the last depth (near copies of
   each other) are cut into blocks, and each two blocks are compared.  A pair
   that meets in several leaves counts in the smallest common one.  A leaf
   returns for each set how many partners it has, and a spanning star of what is
   linked: never the pairs themselves.
5. Connected components are the classes.

One row for each document: its class, which is the class's smallest id, and its
number of links, that is of other documents with a similarity of the threshold
or more.

Classes and links do not depend on the order of rows; of equal ids the smallest
hash of a text stands for a class.  Null ids come last.  Of the input's columns
only the id and the text are read.  Texts of fewer than five words have one
shingle of all their words.  Texts
without words (null too) are copies of each other.  Repeated rows are copies.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .common import Scratch, map_columns, small_batches, texts

WORDS, THRESHOLD = 5, 0.8
PLACES = 128
LEAF, DEPTH = 192, 6
#: Sets, and shingles, of a block of a large leaf.
BLOCK_SETS, BLOCK_SHINGLES = 256, 2_000_000
#: Signatures that share fewer places cannot reasonably belong to a pair: four deviations below the threshold.
#: Leaves compare their low bytes, where other places share one by chance once in 256.
LEAST_SHARED = math.floor(PLACES * THRESHOLD - 4 * math.sqrt(PLACES * THRESHOLD * (1 - THRESHOLD)))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, codes: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles.  ``codes`` keeps words' hashes."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    for w in words:
        if w not in codes:
            codes[w] = zlib.crc32(w) << 32 | zlib.adler32(w)
    ids = _mix(np.array([codes[w] for w in words], np.uint64))
    n = max(1, len(words) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(words))):
        out = out * _ODD + ids[k : k + n]
    return np.unique(_mix(out + np.uint64(len(words) if len(words) < WORDS else 0)))


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 32, PLACES, np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, PLACES, np.uint64).astype(np.uint32)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of 128 hash functions over the set, cut to 16 bits."""
    low = np.full(PLACES, 0xFFFFFFFF, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 1024):
        low = np.minimum(low, (x[at : at + 1024, None] * a + b).min(0))
    return ((low * np.uint32(2654435769)) >> np.uint32(16)).astype("<u2")


def least(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shingles that hash functions make smallest."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    return found[(x[:, None] * a + b).argmin(0)]


def _kept(codes: dict) -> dict:
    if len(codes) > 400_000:
        codes.clear()
    return codes


def signatures(docs: DataFrame, runs: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, key, n, low, high, first): h is a hash of the text, key one of its set.

    ``low`` and ``high`` have the bytes of the signature, ``first`` the set's nodes
    at the first level of ``runs`` trees.  There a node stands for a shingle with all its
    64 bits: by the signature's 16 bits, sets that share nothing would meet, the
    more the larger the corpus.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("h", F.xxhash64("text"))

    def make():
        a, b = _multipliers()
        paths, places = _first(runs)
        codes: dict[bytes, int] = {}

        def step(column: pa.Array) -> list:
            keys, sizes, low, high, first = [], [], [], [], []
            for x in texts(column):
                found = shingles(x, _kept(codes))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sizes.append(len(found))
                made = signature(found, a, b)
                low.append(made.astype("u1").tobytes())
                high.append((made >> 8).astype("u1").tobytes())
                first.append(_mix(paths + least(found, a[places], b[places])).view(np.int64) if len(found) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, first)]).astype("i4")
            return [keys, sizes, low, high, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*first, np.zeros(0, np.int64)])))]

        return step

    add = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("low", T.BinaryType()), T.StructField("high", T.BinaryType()), T.StructField("first", T.ArrayType(T.LongType()))])
    return map_columns(source, ["id", "h"], ["text"], add, make)


def survival(similarity: float, depth: int) -> float:
    """The probability that a pair stays together somewhere in one tree down to ``depth``."""
    extra = 1 / THRESHOLD - 1
    alive = 1.0
    for _ in range(depth):
        one = similarity * alive
        alive = (1 - extra) * one + extra * (1 - (1 - one) ** 2)
    return alive


def runs_for(recall: float, similarity: float = THRESHOLD, depth: int = 3) -> int:
    """Trees so that a pair of that similarity meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, depth)))


def _chosen(paths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, places, seeds of the children's paths): one chosen place for each node, a second one for a quarter of the nodes."""
    extra = int((1 / THRESHOLD - 1) * (1 << 32))
    out = []
    for k in range(2):
        random = _mix(paths + np.array([k + 1], np.uint64) * _ODD)
        place = random % np.uint64(PLACES)
        rows = np.arange(len(paths)) if k == 0 else np.flatnonzero((random >> np.uint64(32)) < np.uint64(extra))
        out.append((rows, place[rows].astype(np.int64), paths[rows] * _ODD + (place[rows] << np.uint64(16))))
    return out


def _first(runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, places) of the nodes below the roots of ``runs`` trees."""
    made = _chosen(_mix(np.arange(1, runs + 1, dtype=np.uint64)))
    return np.concatenate([_mix(x[2]) for x in made]), np.concatenate([x[1] for x in made])


_PATHS = T.StructType([T.StructField("path", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])


def _extend(nodes: DataFrame) -> DataFrame:
    """(path, key, n): the children of (path, key, n, low, high)."""
    small_batches(nodes.sparkSession, 4096)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, PLACES) for c in ("low", "high"))
            keys, sizes = batch.column("key"), batch.column("n")
            for rows, place, seed in _chosen(batch.column("path").to_numpy().view(np.uint64)):
                at = pa.array(rows)
                child = _mix(seed + (high[rows, place].astype(np.uint64) << np.uint64(8)) + low[rows, place])
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), keys.take(at), sizes.take(at)], names=_PATHS.names)

    return nodes.mapInArrow(run, _PATHS)


def _grouped(df: DataFrame, keys: list[str], schema: T.StructType, work: Callable[[pa.Table], pa.RecordBatch], parts: int) -> DataFrame:
    """``work`` on each group of ``keys``, whose size the caller bounds; rows of a group meet by a shuffle and a sort.

    Small groups by the thousand cost no start-up each, as grouped maps would.
    """
    small_batches(df.sparkSession, 2048)

    def run(batches):
        left: list[pa.RecordBatch] = []

        def groups(table: pa.Table, whole: bool):
            n = table.num_rows
            if not n:
                return
            change = np.zeros(n, bool)
            for k in keys:
                column = table.column(k).to_numpy()
                change[1:] |= column[1:] != column[:-1]
            starts = [0, *np.flatnonzero(change).tolist(), n]
            stop = len(starts) - (1 if whole else 2)
            for i in range(stop):
                yield table.slice(starts[i], starts[i + 1] - starts[i])
            if not whole:
                left[:] = table.slice(starts[-2]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            last = left[-1] if left else None
            left.append(batch)
            if last is not None and all(last.column(k)[-1] == batch.column(k)[-1] for k in keys):
                continue  # still one group: nothing to hand out yet
            for group in groups(pa.Table.from_batches(left), False):
                yield from filter(None, [work(group)])
        for group in groups(pa.Table.from_batches(left) if left else pa.table({}), True):
            yield from filter(None, [work(group)])

    return df.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _common(mine: list[np.ndarray], here: int) -> Callable[[int, int], bool]:
    """Whether ``here`` is the smallest leaf that two sets have in common."""
    before = [set(x[x < here].tolist()) for x in mine]
    return lambda i, j: before[i].isdisjoint(before[j])


def _sides(table: pa.Table) -> tuple[np.ndarray, bool]:
    """Each row's block, and whether the cell compares two blocks."""
    block = table.column("block").to_numpy()
    return block, bool(table.column("across")[0].as_py())


_ACTIVE = T.StructType([T.StructField("path", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("block", T.LongType()), T.StructField("across", T.BooleanType()), T.StructField("key", T.BinaryType()), T.StructField("paths", T.ArrayType(T.LongType()))])


def _promising(table: pa.Table) -> pa.RecordBatch | None:
    """The rows of a cell that have a partner by their signatures, for which this is the smallest common leaf."""
    n = table.num_rows
    if n < 2:
        return None
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), "u1").reshape(n, PLACES)
    block, across = _sides(table)
    hit = np.zeros(n, bool)
    meets = None
    for i in range(n - 1):
        near = np.flatnonzero((sigs[i + 1 :] == sigs[i]).sum(1) >= LEAST_SHARED) + i + 1
        if across:
            near = near[block[near] != block[i]]
        if len(near):
            meets = meets or _common([x.values.to_numpy() for x in table.column("paths")], table.column("path")[0].as_py())
            for j in near.tolist():
                if not (hit[i] and hit[j]) and meets(i, j):
                    hit[i] = hit[j] = True
    if not hit.any():
        return None
    kept = table.filter(pa.array(hit)).select(_ACTIVE.names).combine_chunks()
    return kept.to_batches()[0]


_LINKED = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("root", T.BinaryType())])


def _verified(table: pa.Table) -> pa.RecordBatch | None:
    """Each set's partners in a cell, by the sets themselves, and the root of its star."""
    keys = table.column("key").to_pylist()
    first = np.sort(np.unique(np.array([keys.index(k) for k in keys]) if len(keys) < 50 else np.unique(np.array([k.hex() for k in keys]), return_index=True)[1]))
    if len(first) < len(keys):
        table = table.take(pa.array(first))
        keys = [keys[i] for i in first]
    n = len(keys)
    if n < 2:
        return None
    sets = [np.frombuffer(x, "<u4") for x in table.column("set").to_pylist()]
    sizes = np.array([len(x) for x in sets], np.int64)
    copies = table.column("copies").to_numpy()
    block, across = _sides(table)
    meets = _common([x.values.to_numpy() for x in table.column("paths")], table.column("path")[0].as_py())
    owner = np.repeat(np.arange(n), sizes)
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(flat, kind="stable")
    owners = owner[order]
    begin = np.searchsorted(flat[order], np.arange(flat.max() + 2)) if len(flat) else np.zeros(1, np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    links, root = np.zeros(n, np.int64), list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        mine = flat[bounds[i] : bounds[i + 1]]
        lists = [owners[begin[s] : begin[s + 1]] for s in mine.tolist()]
        if not lists:
            continue
        shared = np.bincount(np.concatenate(lists), minlength=n)
        shared[: i + 1] = 0
        near = np.flatnonzero(shared >= THRESHOLD * (sizes[i] + sizes - shared) - 1e-9)
        near = near[shared[near] > 0]
        if across:
            near = near[block[near] != block[i]]
        for j in near.tolist():
            if meets(i, j):
                links[i] += copies[j]
                links[j] += copies[i]
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    tops = [top(i) for i in range(n)]
    use = [i for i in range(n) if links[i] or tops[i] != i]
    if not use:
        return None
    return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in use], pa.binary()), pa.array(links[use]), pa.array([keys[tops[i]] for i in use], pa.binary())], names=_LINKED.names)


def _cells(leaves: DataFrame) -> DataFrame:
    """Each row of a leaf with its cells: one for a small leaf; for a large one those of its block with every block."""
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK_SETS), F.ceil(F.col("t") / BLOCK_SHINGLES), F.lit(1)).cast("long")
    df = leaves.withColumn("blocks", F.when(F.col("c") <= LEAF, F.lit(1).cast("long")).otherwise(blocks)).withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return df.withColumn("cell", low * F.col("blocks") + high).withColumn("across", low != high).drop("other", "blocks", "c", "t")


def _met(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus: shuffled at every size, never broadcast below one."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of (a, b): each node's smallest reachable one, by large and small stars."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.store(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if before == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored apart, so that the join below has its own exchanges and can split a star's centre
        low = scratch.store(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.filter("b > a").join(low, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.store(large, "large")
        least = scratch.store(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.store(small.distinct(), "stars")
        scratch.clear(now)


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.99) -> DataFrame:
    """(id, class_id, n_links, class_size, text_hash, chosen) of every row.

    ``chosen``: the text under that id is the one that stands for its class: that
    with the smallest id (null last), of several with that id the one with the
    smallest hash.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs_for(recall, THRESHOLD, DEPTH)
    scratch = Scratch(spark, "jaccard")
    signed = scratch.store(signatures(docs, runs, id_col, text_col), "signed")
    ids = scratch.store(signed.select("id", "h", "key"), "ids")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n", "low", "high", "first")).alias("x")
    sets = scratch.store(signed.groupBy("key").agg(one, F.count(F.lit(1)).alias("copies")).select("key", "x.id", "x.h", "x.n", "x.low", "x.high", "x.first", "copies"), "sets")
    scratch.drop(signed)
    children, leaves = sets.select(F.explode("first").alias("path"), "key", "n"), []
    for depth in range(1, DEPTH + 1):
        counts = scratch.store(children.groupBy("path").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).filter("c > 1"), "counts")
        met = _met(children.drop("n"), counts, "path")
        done = F.lit(True) if depth == DEPTH else F.col("c") <= LEAF
        leaves.append(met.filter(done))
        if depth == DEPTH or counts.filter(F.col("c") > LEAF).isEmpty():
            break
        frontier = met.filter(~done).select("path", "key")
        if depth == 1:  # what goes deeper is few: its signatures are looked up once among all
            frontier = scratch.store(frontier, "frontier")
            deep = scratch.store(_met(sets.select("key", "n", "low", "high"), frontier.select("key").distinct(), "key", "left_semi"), "deep")
        children = scratch.store(_extend(_met(frontier, deep, "key").select("path", "key", "n", "low", "high")), "paths")
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    own = every.groupBy("key").agg(F.collect_set(F.struct("path", "c", "t")).alias("leaves"))
    own = scratch.store(_met(sets.select("key", F.col("low").alias("sig")), own, "key"), "leaves")
    rows = own.select("key", "sig", F.sort_array("leaves.path").alias("paths"), F.explode("leaves").alias("leaf")).select("key", "sig", "paths", "leaf.path", "leaf.c", "leaf.t")
    active = scratch.store(_grouped(_cells(rows), ["path", "cell"], _ACTIVE, _promising, parts), "active")
    nodes = scratch.store(sets.select("key", "id", "h", "copies"), "nodes")
    wanted = scratch.store(_met(nodes, active.select("key").distinct(), "key", "left_semi"), "wanted")
    scratch.clear(ids, nodes, active, wanted)
    held = scratch.store(_sets_of(docs, wanted, id_col, text_col), "held")
    linked = scratch.store(_grouped(_met(active, held, "key"), ["path", "cell"], _LINKED, _verified, parts), "linked")
    links = linked.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")))
    node = _met(_met(nodes, roots.withColumnRenamed("node", "key"), "key", "left"), links, "key", "left")
    node = node.select("key", "id", "h", "copies", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    classes = node.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("least"), F.sum("copies").alias("class_size"))
    known = scratch.store(_met(node, classes, "root").select("key", "least", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links")), "classes")
    scratch.clear(ids, known)
    whole = _met(ids, known, "key")
    return whole.select(F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "n_links", "class_size", F.col("h").alias("text_hash"), (F.col("id").eqNullSafe(F.col("least.id")) & (F.col("h") == F.col("least.h"))).alias("chosen"))


def _sets_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, copies, set) of the sets in ``wanted`` (key, id, h, copies): hashes of 32 bits, sorted."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    # few texts are wanted: a filter of bounded size keeps the others from travelling
    blocks = bloom.block_count(wanted.count())
    some = bloom.passing(source, F.col("_h"), bloom.build(wanted, F.col("h"), blocks), blocks)
    met = _met(some, wanted, (F.col("_h") == F.col("h")) & F.col("_id").eqNullSafe(F.col("id")))

    def make():
        codes: dict[bytes, int] = {}
        return lambda column: [[np.unique((shingles(x, _kept(codes)) & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes() for x in texts(column)]]

    return map_columns(met, ["key", "copies"], ["text"], T.StructType([T.StructField("set", T.BinaryType())]), make)


def keep_one(docs: DataFrame, linked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class: the row that ``link`` chose; of repeated rows one.

    Documents are told apart by their id and text, so that several texts under one
    id, or under none, each have the place that their class gives them.
    """
    kept = linked.filter("chosen").groupBy(F.col(id_col).alias("_kept"), F.col("text_hash").alias("_hash")).agg(F.count(F.lit(1)).alias("_n"))
    hashed = docs.withColumn("_own", F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    joined = hashed.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col("_kept")) & (F.col("_own") == F.col("_hash"))).drop("_kept", "_hash")
    again = joined.filter("_n > 1").dropDuplicates([id_col, "_own"])
    return joined.filter("_n = 1").unionByName(again).drop("_n", "_own")
