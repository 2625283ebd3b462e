"""A content-addressed store of token ids.

* Every text is encoded, an end id is appended.
* A rolling hash over the last 16 ids cuts a document's ids into chunks: the
  cuts follow the content, so that copies and shared passages give equal chunks.
* ``chunks``: each unique chunk once, under its SHA-256.
* ``recipes``: per document, in ascending order of ids, the chunks' hashes and a
  Merkle root over them.  The files are range-partitioned by document.
* ``manifest``: per part the number of documents and ids and a Merkle root over
  its documents; the store's root is that over the parts.

Reading back checks each chunk against its address, each document against its
root and each part's documents against the manifest, and gives the ids; ``start``
counts the ids of all documents before one.

Null and empty texts have the end id alone.  Repeated rows are documents of
their own; among equal document ids the recipes' order decides.  Null document
ids come first.  A very long text is cut into chunks like any other; its recipe has a
hash for each.  An empty table gives an empty store.  Columns besides the id and
the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_columns, small_batches

WINDOW = 16
SHORTEST, LONGEST, MEAN_BITS = 128, 4096, 9
#: Entries of a process's table of distinct segments (about 80 MB).
TABLE_SIZE = 1_000_000
#: Bytes of a long segment that the table keeps.
KEPT = 200
#: New segments that go to the library at once.
RUN = 200

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Classes of bytes: letters and digits, marks, blank, line feed, the apostrophe, first bytes of characters that are no blanks.
_OTHER, _WORD, _MARK, _BLANK, _LINE, _APOSTROPHE, _FIRST = range(7)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[33:127] = [_WORD if chr(b).isalnum() else _MARK for b in range(33, 127)]
    # first bytes C2, E1, E2 and E3 may begin a blank beyond ASCII
    out[[b for b in range(0xC3, 0xF5) if b not in (0xE1, 0xE2, 0xE3)]] = _FIRST
    out[[32, 10, 39]] = _BLANK, _LINE, _APOSTROPHE
    return out


_CLASS = _classes()
_SOLID = np.isin(np.arange(7), (_WORD, _MARK, _APOSTROPHE))
_BEGINS = _SOLID | (np.arange(7) == _FIRST)


def segments(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where segments begin in texts that lie one behind the other as UTF-8, with ``bounds`` between them.

    A token never reaches over these places: before a blank that something other
    than a blank follows (it belongs to what follows); between letters or digits
    and marks (an apostrophe may be part of "'s" and does not count); around a
    line feed that stands alone between ASCII characters that are no blanks.
    """
    kind = _CLASS[data]
    begins = np.zeros(len(data) + 1, bool)
    here, after = kind[:-1], kind[1:]
    begins[:-2] = (here == _BLANK) & _BEGINS[after]
    begins[1:-1] |= ((here == _WORD) & (after == _MARK)) | ((here == _MARK) & (after == _WORD))
    lone = np.flatnonzero(kind == _LINE)
    lone = lone[(lone > 0) & (lone < len(data) - 1)]
    lone = lone[_SOLID[kind[lone - 1]] & _SOLID[kind[lone + 1]]]
    lone = lone[~np.isin(lone, bounds) & ~np.isin(lone + 1, bounds)]
    begins[lone] = begins[lone + 1] = True
    # what ends a text has nothing behind it
    last = bounds[1:][np.diff(bounds) > 0] - 1
    begins[last[kind[last] == _BLANK]] = False
    begins[bounds] = True
    return np.flatnonzero(begins[:-1])


class SegmentTable:
    """Ids of segments of up to 23 bytes: an open hash table whose keys are the bytes themselves, in three words with the length on top."""

    MOST = 23

    def __init__(self, size: int, dtype: str):
        self.size, self.dtype = size, dtype
        self.bits = max(8, int(2 * size - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.rows = np.zeros((1 << self.bits, 4), np.uint64)
        self.pool, self.used, self.held = np.zeros(1 << 16, self.dtype), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    @staticmethod
    def keys(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``data`` needs 24 bytes more than the segments reach."""
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        low = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.zeros((len(begin), 3), np.uint64)
        out[:, 0] = words[begin] & low[np.minimum(length, 8)]
        for k in (1, 2):
            at = np.flatnonzero(length > 8 * k)
            out[at, k] = words[begin[at] + 8 * k] & low[np.minimum(length[at] - 8 * k, 8 if k == 1 else 7)]
        out[:, 2] |= length.astype(np.uint64) << np.uint64(56)
        return out

    def hashes(self, keys: np.ndarray) -> np.ndarray:
        out = keys[:, 0] * _MULTIPLIER
        for k in (1, 2):
            out ^= out >> np.uint64(32)
            out = (out + keys[:, k]) * _MULTIPLIER
        return out ^ (out >> np.uint64(29))

    def find(self, keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Each key's value (place in the pool times 2**28, plus the number of ids); 0 where it is not there."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = hashes & mask
        rows = self.rows.take(slot.view(np.int64), axis=0)
        same = (rows[:, 0] == keys[:, 0]) & (rows[:, 1] == keys[:, 1]) & (rows[:, 2] == keys[:, 2])
        out = np.where(same, rows[:, 3], 0)
        open_ = np.flatnonzero(~same & (rows[:, 2] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
            rows = self.rows.take(slot[open_].view(np.int64), axis=0)
            same = (rows[:, :3] == keys[open_]).all(1)
            out[open_[same]] = rows[same, 3]
            open_ = open_[~same & (rows[:, 2] != 0)]
        return out

    def store(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Values of segments whose ids lie one behind the other up to ``ends``."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = np.concatenate([[0], ends[:-1]])
        out = ((begin + self.used).astype(np.uint64) << np.uint64(28)) + (ends - begin).astype(np.uint64)
        self.used += len(ids)
        return out

    def add(self, keys: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once."""
        mask = np.uint64((1 << self.bits) - 1)
        slot = (hashes & mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.rows[at, 2] == 0
            self.rows[at[free], 3] = left[free] + 1  # of those that want a slot one gets it
            won = free & (self.rows[at, 3] == left + 1)
            self.rows[at[won], :3], self.rows[at[won], 3] = keys[left[won]], values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & int(mask)
        self.held += len(keys)


class WordEncoder:
    """Ids by the tokenizers library, each distinct segment once as long as the table holds it.

    New segments go to the library one behind the other, so that they part again:
    those that begin with a blank as they stand in a text, others with line feeds
    between them.  The bytes that each id stands for tell where a segment's end.

    Texts with a token that was added to the vocabulary (``<|endoftext|>``), and
    all texts where the library normalises or splits otherwise, go to it whole.
    """

    def __init__(self, path: str, size: int = TABLE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.dtype = "<u2" if len(vocabulary) <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():
            self.lengths[k] = len(token)  # a character of a token is one byte
        added = list(self.library.get_added_tokens_decoder().values())
        self.added = [x.content.encode() for x in added]
        rules = json.loads(self.library.to_str())
        splits = rules["pre_tokenizer"] or {}
        self.separable = rules["normalizer"] is None and splits.get("type") == "ByteLevel" and bool(splits.get("use_regex")) and not splits.get("add_prefix_space") and not any(x.normalized or x.single_word for x in added)
        self.table = SegmentTable(size, self.dtype)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.dtype) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, parts: list[bytes]) -> np.ndarray:
        """Values of segments that the table does not have."""
        out = np.zeros(len(parts), np.uint64)
        blank = [k for k, x in enumerate(parts) if x[0] == 32 and len(x) > 1 and _BEGINS[_CLASS[x[1]]]]
        solid = [k for k, x in enumerate(parts) if _SOLID[_CLASS[x[0]]] and _SOLID[_CLASS[x[-1]]]] if self.separable else []
        blank = blank if self.separable else []
        alone = sorted({*range(len(parts))}.difference(blank, solid))
        runs = [(blank[at : at + RUN], b"", 0) for at in range(0, len(blank), RUN)] + [(solid[at : at + RUN], b"\n", 1) for at in range(0, len(solid), RUN)] + [([k], b"", 0) for k in alone]
        made = self._ids([gap.join([parts[k] for k in run]).decode() for run, gap, _ in runs])
        for (run, _, gap), ids in zip(runs, made, strict=True):
            ends = np.array([len(ids)])
            if len(run) > 1:
                bytes_ = np.cumsum([len(parts[k]) + gap for k in run]) - gap
                reach = np.cumsum(self.lengths[ids])
                ends = np.searchsorted(reach, bytes_) + 1
                if gap:  # an id for each line feed
                    ids = np.delete(ids, ends[:-1])
                    ends = ends - np.arange(len(ends))
            out[run] = self.table.store(ids, ends)
        return out

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with ``end`` behind it, one behind the other, and where each text's stop.

        ``data``: the texts as UTF-8, up to ``bounds``, and 24 bytes more.
        """
        table = self.table
        if table.held + len(table.long) > table.size or table.used > 16 * table.size:
            table.clear()
        body = data[: bounds[-1]]
        begin = segments(body, bounds) if len(body) else np.zeros(0, np.int64)
        whole = np.full(len(bounds) - 1, not self.separable)
        found = data.tobytes()
        for token in self.added:
            at = found.find(token, 0, len(body))
            while at >= 0:
                whole[np.searchsorted(bounds, at, "right") - 1] = True
                at = found.find(token, at + 1, len(body))
        if whole.any():
            doc = np.searchsorted(bounds, begin, "right") - 1
            begin = begin[~whole[doc] | (begin == bounds[doc])]
        length = np.diff(begin, append=len(body))
        values = np.zeros(len(begin), np.uint64)
        short = length <= table.MOST
        if whole.any():
            short &= ~whole[np.searchsorted(bounds, begin, "right") - 1]
        short = np.flatnonzero(short)
        keys = table.keys(data, begin[short], length[short])
        hashes = table.hashes(keys)
        values[short] = table.find(keys, hashes)
        lacking = np.flatnonzero(values[short] == 0)
        lacking = lacking[np.argsort(hashes[lacking], kind="stable")]
        if len(lacking):
            mine = keys[lacking]
            first = np.ones(len(mine), bool)
            first[1:] = (mine[1:] != mine[:-1]).any(1)
            new = lacking[first]
            starts = begin[short[new]].tolist()
            made = self._new([found[a : a + n] for a, n in zip(starts, length[short[new]].tolist(), strict=True)])
            table.add(keys[new], hashes[new], made)
            values[short[lacking]] = made[np.cumsum(first) - 1]
        rest = np.flatnonzero(values == 0)
        if len(rest):
            parts = [found[a : a + n] for a, n in zip(begin[rest].tolist(), length[rest].tolist(), strict=True)]
            new = [x for x in dict.fromkeys(parts) if x not in table.long]
            now = dict(zip(new, self._new(new).tolist(), strict=True))
            values[rest] = [table.long.get(x) or now[x] for x in parts]
            table.long.update((x, v) for x, v in now.items() if len(x) <= KEPT)
        # an end behind each text: a value of its own
        of = np.searchsorted(begin, bounds[1:])
        values = np.insert(values, of, table.store(np.array([end], self.dtype), np.array([1]))[0])
        sizes = (values & np.uint64((1 << 28) - 1)).astype(np.int64)
        stops = np.cumsum(sizes)
        place = np.repeat((values >> np.uint64(28)).astype(np.int64) - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)
        return table.pool[place], stops[of + np.arange(len(of))]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts of a column as UTF-8 one behind the other with 24 bytes more, and the bounds between them; null counts as empty."""
    parts = column.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    data = np.zeros(int(bounds[-1] - bounds[0]) + 24, np.uint8)
    if len(data) > 24:
        data[:-24] = np.frombuffer(parts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a vocabulary: tasks that share a worker share the table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """For documents that lie one behind the other in ``ids``, up to ``ends``: where each one's chunks end."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MULTIPLIER
    rolling = mixed.copy()
    for k in range(1, WINDOW):
        rolling[k:] += mixed[:-k] << np.uint64(k)
    # the top bits, which the oldest ids of the window reach too
    marks = np.flatnonzero(rolling >> np.uint64(64 - MEAN_BITS) == 0)
    out, begin = [], 0
    bounds = np.searchsorted(marks, ends)
    lo = 0
    for end, hi in zip(ends, bounds, strict=True):
        found, at = [], begin
        for mark in [*(marks[lo:hi] + 1).tolist(), end]:
            while mark - at > LONGEST:
                at += LONGEST
                found.append(at)
            if mark - at >= SHORTEST and mark < end:
                at = mark
                found.append(at)
        if at < end:
            found.append(end)
        out.append(found)
        begin, lo = end, hi
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """The root over ``leaves``; an odd one rises as it is; no leaf: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256().digest()


class Mountains:
    """The roots over a long sequence in memory of its logarithm: full trees, then their joint root."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == height:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            height += 1
        self.peaks.append((height, node))

    def root(self) -> bytes:
        return merkle([x for _, x in self.peaks])


_PIECES = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("doc", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("kind", T.StringType()),
    ]
)


def _pieces(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of kind recipe (payload: the chunks' hashes) and chunk (payload: ids).  A task gives each of its chunks once."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))

    def run(batches):
        words = encoder(tokenizer)
        width = words.width
        seen: set[bytes] = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, stops = words.encode(*joined(batch.column(1)), end_id)
            data, ends = ids.tobytes(), stops.tolist()
            rows: list[tuple] = []
            begin = 0
            for doc, chunk_ends in zip(batch.column(0).to_pylist(), cuts(ids, ends), strict=True):
                keys, first = [], begin
                for stop in chunk_ends:
                    payload = data[begin * width : stop * width]
                    keys.append(key := hashlib.sha256(payload).digest())
                    if key not in seen:
                        seen.add(key)
                        rows.append((key, None, stop - begin, payload, "chunk"))
                    begin = stop
                rows.append((merkle(keys), doc, begin - first, b"".join(keys), "recipe"))
            if len(seen) > 500_000:
                seen = set()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=_PIECES.names)

    return source.mapInArrow(run, _PIECES)


def _unique(pieces: DataFrame, parts: int) -> DataFrame:
    """Each chunk once: rows of a hash meet in a partition, sorted, and the first of a run stays.

    A task remembers one hash, whatever its partition holds.
    """

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, kind = batch.column("key"), batch.column("kind")
            differs = np.ones(batch.num_rows, bool)
            differs[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            differs[0] = last is None or last != key[0].as_py()
            recipe = pc.equal(kind, "recipe").to_numpy(zero_copy_only=False)
            # recipes come behind all chunks, so that the hash before is a chunk's
            last = key[-1].as_py()
            yield batch.filter(pa.array(differs | recipe))

    spread = F.when(F.col("kind") == "chunk", F.col("key")).otherwise(F.sha2(F.concat(F.col("key"), F.coalesce(F.col("doc"), F.lit(-1)).cast("string").cast("binary")), 256).cast("binary"))
    return pieces.repartition(parts, spread).sortWithinPartitions("kind", "key").mapInArrow(run, _PIECES)


_RECIPES = T.StructType(
    [
        T.StructField("doc", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("row", T.LongType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("chunks", T.ArrayType(T.BinaryType())),
        T.StructField("root", T.BinaryType()),
        T.StructField("kind", T.StringType()),
    ]
)


def _ordered(recipes: DataFrame, parts: int) -> DataFrame:
    """Recipes in ascending order with places within their part, and a manifest row for each part."""

    def run(batches):
        part, row, start, tree = TaskContext.get().partitionId(), 0, 0, Mountains()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for root, doc, n, payload in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows.append((doc, part, row, start, n, [payload[i : i + 32] for i in range(0, len(payload), 32)], root, "recipe"))
                row, start = row + 1, start + n
                tree.add(root)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_RECIPES.names)
        if row:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((None, part, row, None, start, None, tree.root(), "manifest"), types, strict=True)], names=_RECIPES.names)

    return recipes.select("key", "doc", "n_tokens", "payload").repartitionByRange(parts, "doc", "key").sortWithinPartitions("doc", "key").mapInArrow(run, _RECIPES)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` into a store below ``path``, which all executors must share."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = _unique(_pieces(docs, tokenizer, end_id, id_col, text_col), parts)
    pieces.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/data")
    recipes = _read(spark, f"{path}/data", _PIECES).filter(F.col("kind") == "recipe")
    _ordered(recipes, parts).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/order")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _wide(payload: bytes, n: int) -> np.ndarray:
    """A chunk's ids as 32-bit integers; the file gives their number, and so how many bytes each has."""
    return np.frombuffer(payload, f"<u{len(payload) // n}").astype("<u4")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(key, n, crc, intact) of each stored chunk: the number of ids, the CRC-32 of them as 32-bit integers, and whether the address is right."""

    def make():
        def step(keys, sizes, payloads):
            keys, payloads = keys.to_pylist(), payloads.to_pylist()
            wide = [_wide(x, n).tobytes() for x, n in zip(payloads, sizes.to_pylist(), strict=True)]
            return [[len(x) // 4 for x in wide], [zlib.crc32(x) for x in wide], [hashlib.sha256(x).digest() == k for k, x in zip(keys, payloads, strict=True)]]

        return step

    chunks = _read(spark, f"{path}/data", _PIECES).filter(F.col("kind") == "chunk")
    add = T.StructType([T.StructField("n", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("intact", T.BooleanType())])
    return map_columns(chunks, ["key"], ["key", "n_tokens", "payload"], add, make)


_PARTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n_found", T.LongType()), T.StructField("root_found", T.BinaryType())])


def _found_parts(stored: DataFrame, parts: int) -> DataFrame:
    """(part, n_found, root_found): ids and Merkle root of each part, anew from its recipes in their order.

    A row that is lost, doubled or out of its place gives another root.
    """
    small_batches(stored.sparkSession, 4096)

    def run(batches):
        part, ids, tree = None, 0, Mountains()
        out: list[tuple] = []
        for batch in batches:
            for p, n, root in zip(*(batch.column(k).to_pylist() for k in ("part", "n_tokens", "root")), strict=True):
                if p != part:
                    if part is not None:
                        out.append((part, ids, tree.root()))
                    part, ids, tree = p, 0, Mountains()
                ids += n
                tree.add(root)
        if part is not None:
            out.append((part, ids, tree.root()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=_PARTS.names)

    rows = stored.filter(F.col("kind") == "recipe").select("part", "row", "n_tokens", "root")
    return rows.repartition(parts, "part").sortWithinPartitions("part", "row").mapInArrow(run, _PARTS)


def starts(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """(part, before, sound) and the store's root.

    ``before``: the ids of all earlier parts, by the manifest, which has a row
    for each part; ``sound``: whether the part's recipes agree with it.
    """
    stored = _read(spark, f"{path}/order", _RECIPES)
    listed = stored.filter(F.col("kind") == "manifest").select("part", "n_tokens", "root").orderBy("part").collect()
    found = {r["part"]: (r["n_found"], bytes(r["root_found"])) for r in _found_parts(stored, max(1, len(listed))).collect()}
    if lacking := found.keys() - {r["part"] for r in listed}:
        raise ValueError(f"no manifest for parts {sorted(lacking)} of {path}")
    before = [0, *accumulate(r["n_tokens"] for r in listed)]
    rows = [(r["part"], b, found.get(r["part"]) == (r["n_tokens"], bytes(r["root"]))) for r, b in zip(listed, before, strict=False)]
    return spark.createDataFrame(rows, "part int, before long, sound boolean"), merkle([bytes(r["root"]) for r in listed])


def recipes(spark: SparkSession, path: str) -> DataFrame:
    """(doc, part, row, start, n_tokens, chunks, root, sound) of every document."""
    before, _ = starts(spark, path)
    rows = _read(spark, f"{path}/order", _RECIPES).filter(F.col("kind") == "recipe")
    return rows.join(F.broadcast(before), "part").select("doc", "part", "row", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "chunks", "root", "sound")


class CrcJoiner:
    """The CRC-32 of two byte strings one behind the other, from theirs and the second's length.

    Appending zero bytes is linear over bits.  For each power of two there is a
    table of what it makes of each of a sum's four bytes; a length takes one step
    for each of its bits.
    """

    def __init__(self, powers: int = 48):
        matrix = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
        square = lambda m: [self._times(m, x) for x in m]
        for _ in range(3):
            matrix = square(matrix)
        self.tables = []
        for _ in range(powers):
            self.tables.append([[self._times(matrix, x << 8 * k) for x in range(256)] for k in range(4)])
            matrix = square(matrix)

    @staticmethod
    def _times(matrix: list[int], vector: int) -> int:
        out, k = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[k]
            vector >>= 1
            k += 1
        return out

    def join(self, first: int, second: int, length: int) -> int:
        k = 0
        while length:
            if length & 1:
                a, b, c, d = self.tables[k]
                first = a[first & 255] ^ b[first >> 8 & 255] ^ c[first >> 16 & 255] ^ d[first >> 24]
            length >>= 1
            k += 1
        return first ^ second


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32, verified) of every document, from the files.

    Chunks are read once, where they lie; only their hashes, lengths and sums
    travel to the documents.  ``verified``: every chunk is there and intact, the
    lengths add up and the Merkle root is right, and so is that of the part over
    all its documents.
    """
    used = recipes(spark, path).select("doc", "part", "row", "start", "n_tokens", "root", "sound", F.posexplode("chunks").alias("pos", "key"))
    met = used.join(read_chunks(spark, path), "key", "left")
    whole = met.groupBy("part", "row").agg(
        F.first("doc").alias("doc"),
        F.first("start").alias("start"),
        F.first("n_tokens").alias("n_tokens"),
        F.first("root").alias("root"),
        F.first("sound").alias("sound"),
        F.array_sort(F.collect_list(F.struct("pos", "key", "n", "crc", "intact"))).alias("chunks"),
    )

    def make():
        joiner = CrcJoiner()

        def step(roots, sound, lengths, chunks):
            sums, good = [], []
            for root, whole, n, rows in zip(roots.to_pylist(), sound.to_pylist(), lengths.to_pylist(), chunks.to_pylist(), strict=True):
                total = 0
                for x in rows:
                    total = joiner.join(total, x["crc"] or 0, 4 * (x["n"] or 0))
                sums.append(total)
                good.append(whole and all(x["intact"] for x in rows) and sum(x["n"] or 0 for x in rows) == n and merkle([x["key"] for x in rows]) == root)
            return [sums, good]

        return step

    add = T.StructType([T.StructField("ids_crc32", T.LongType()), T.StructField("verified", T.BooleanType())])
    return map_columns(whole, ["doc", "start", "n_tokens"], ["root", "sound", "n_tokens", "chunks"], add, make)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, start, ids array<long>) of every document, put together from its recipe."""
    used = recipes(spark, path).select("doc", "part", "row", "start", F.posexplode("chunks").alias("pos", "key"))
    stored = _read(spark, f"{path}/data", _PIECES).filter(F.col("kind") == "chunk").select("key", "payload", F.col("n_tokens").alias("n"))
    whole = used.join(stored, "key").groupBy("part", "row").agg(F.first("doc").alias("doc"), F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "n", "payload"))).alias("parts"))

    def make():
        return lambda column: [[np.concatenate([_wide(x["payload"], x["n"]) for x in rows]).tolist() for rows in column.to_pylist()]]

    return map_columns(whole, ["doc", "start"], ["parts"], T.StructType([T.StructField("ids", T.ArrayType(T.LongType()))]), make)
