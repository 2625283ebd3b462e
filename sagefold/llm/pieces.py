"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model crosses a whitespace marker or holds a line feed, a
text can be cut before each run of markers and each line feed, each distinct
word segmented once and its ids joined back by position.  Distinct words grow with the corpus, so the table has
two parts:

* the head, words that are frequent somewhere, as many as ``HEAD_BYTES`` allow: a
  broadcast of bounded size;
* the tail, all other words: each block of texts sends every one of its own once
  to the task of the word's part, where a word is segmented once for all blocks,
  and the ids go back to the block.  No word of the tail has ``OFTEN`` occurrences
  in any block of words, unless the head is full of more frequent ones.

Blocks travel as numbers of words.  Two passes cut the texts, one to ask for words
and one to send the numbers, which takes time but no disk; both check that they saw
the same words.  Input that is not plainly that of files is stored first, so that
its rows keep their order.

Which words are in the head changes time, never an id.  Where a model lacks these
properties (normalisation, pieces across markers), whole texts go to the library.

Null and empty texts have no ids and decode to the empty text.  Repeated rows
are encoded each by itself.  Very long texts are cut like others; a word without
an end is a word of the table.  Ties between equally frequent words go by the
word.  Of the input's columns only the id and the text are read.  An empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, map_columns, small_batches, texts

MARK = "▁"
#: Bytes of the head: those of its words and WORD_BYTES for each.
HEAD_BYTES, WORD_BYTES = 24 << 20, 40
#: Occurrences in a block of words from which a word may be in the head.
OFTEN = 2
#: Bytes of texts that are cut at once, and distinct words that are counted together.
TEXT_BYTES, BLOCK_WORDS = 2 << 20, 400_000


class Chunks:
    """Cuts texts into words and segments words as the library does.

    A word begins with a marker, which is left out, or with a line feed.
    """

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.width = "<u2" if self.library.get_piece_size() <= 1 << 16 else "<u4"
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        rules = spec.normalizer_spec
        crossing = any(MARK in p.piece.lstrip(MARK) for p in spec.pieces)
        user_defined = any(p.type == p.USER_DEFINED for p in spec.pieces)
        self.separable = (
            not crossing
            and not user_defined
            and not rules.precompiled_charsmap
            and rules.add_dummy_prefix
            and not rules.remove_extra_whitespaces
            and rules.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix
            and spec.trainer_spec.model_type == spec.trainer_spec.BPE
            and MARK in {p.piece for p in spec.pieces}
            # else a line feed is one unknown piece together with others beside it
            and spec.trainer_spec.byte_fallback
            and not any("\n" in p.piece for p in spec.pieces)
        )

    @staticmethod
    def of(text: str) -> list[str]:
        """The words of one text; the library puts a marker before any text but the empty one."""
        found = re.findall(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*", MARK + text.replace(" ", MARK)) if text else []
        return [x.removeprefix(MARK) for x in found]

    @classmethod
    def of_all(cls, column: pa.Array) -> pa.Array:
        """A list of words for each text; null counts as empty."""
        column = column.cast(pa.large_string()).fill_null("")
        plain = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        odd = pc.or_(pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARK)), pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
        odd = np.flatnonzero(pc.or_(odd, pc.equal(column, "")).to_numpy(zero_copy_only=False))
        if not len(odd):
            return plain
        cut = pa.array([cls.of(column[i].as_py()) for i in odd.tolist()], plain.type)
        places = np.arange(len(column))
        places[odd] = len(column) + np.arange(len(odd))
        return pa.concat_arrays([plain, cut]).take(pa.array(places))

    def segment(self, words: list[str]) -> pa.Array:
        """The ids of each word, as little-endian integers of ``width`` in a binary."""
        made = self.library.encode(words, num_threads=1)
        for at, word in enumerate(words):
            if not word:
                made[at] = [self.library.piece_to_id(MARK)]
            elif word[0] == "\n":
                del made[at][0]  # the marker that the library puts before any text
        ends = np.cumsum([0, *map(len, made)], dtype=np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(made), self.width, int(ends[-1]))
        return pa.Array.from_buffers(pa.large_binary(), len(made), [None, pa.py_buffer(ids.itemsize * ends), pa.py_buffer(ids)]).cast(pa.binary())


def _grouped(batches, size: int = TEXT_BYTES):
    """Batches put together until they have ``size`` bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table.column(name)
    return found.chunk(0) if found.num_chunks == 1 else pa.concat_arrays(found.chunks) if found.num_chunks else pa.array([], found.type)


def _frequent(batches):
    """(_word, _n) of words that occur OFTEN in a block of words."""

    def often(held: list[pa.Table]) -> pa.RecordBatch:
        total = pa.concat_tables(held).group_by("_word").aggregate([("_n", "sum")]).rename_columns(["_word", "_n"])
        total = total.filter(pc.greater_equal(total.column("_n"), OFTEN))
        return pa.RecordBatch.from_arrays([_column(total, "_word").cast(pa.string()), _column(total, "_n")], names=["_word", "_n"])

    held, n = [], 0
    for table in _grouped(batches):
        found = pc.value_counts(Chunks.of_all(_column(table, "_text")).flatten())
        held.append(pa.table({"_word": found.field("values"), "_n": found.field("counts")}))
        n += len(found)
        if n >= BLOCK_WORDS:
            yield often(held)
            held, n = [], 0
    if held:
        yield often(held)


def _head(docs: DataFrame, model: str, scratch: Scratch, head_bytes: int) -> tuple[pa.Array, pa.Array]:
    """The most frequent words, as many as ``head_bytes`` allow, and their ids."""
    counts = docs.select("_text").mapInArrow(_frequent, "_word string, _n long").groupBy("_word").agg(F.sum("_n").alias("_n"))
    counts = scratch.store(counts.withColumn("_level", F.floor(F.log2("_n") * 8).cast("int")), "counts")
    weights = counts.groupBy("_level").agg(F.sum(F.octet_length("_word") + WORD_BYTES).alias("w")).collect()  # 8 rows for each doubling
    least, left = math.inf, head_bytes
    for level, weight in sorted(weights, reverse=True):
        left -= weight
        if left < 0:
            break
        least = level
    if least == math.inf:
        scratch.drop(counts)
        return pa.array([], pa.large_string()), pa.array([], pa.binary())

    def segment(batches):
        chunks = Chunks(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, chunks.segment(batch.column(0).to_pylist())], names=["_word", "_n", "_ids"])

    head = counts.filter(F.col("_level") >= least).select("_word", "_n").mapInArrow(segment, "_word string, _n long, _ids binary").toArrow()
    scratch.drop(counts)
    head = head.sort_by([("_n", "descending"), ("_word", "ascending")]).combine_chunks()
    return _column(head, "_word").cast(pa.large_string()), _column(head, "_ids").cast(pa.binary())


def _packed(array: pa.Array, name: str) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([(name, array.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([array], names=[name]))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    return _column(pa.ipc.open_stream(data).read_all(), pa.ipc.open_stream(data).schema.names[0])


def _binary(array: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """The integers of all binaries one behind the other, and the number in each."""
    array = array.cast(pa.large_binary())
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    body = np.frombuffer(array.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return np.frombuffer(body.tobytes(), width), np.diff(bounds) // np.dtype(width).itemsize


class Block:
    """The words of a block of texts as numbers: those of the head, then the block's other words by their part.

    What a block is made of depends on its texts, the head and the number of parts
    only, so that two passes over the same rows give the same blocks.
    """

    def __init__(self, table: pa.Table, head: dict[str, int], parts: int):
        lists = Chunks.of_all(_column(table, "_text"))
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        numbers = np.fromiter((head.get(x, -1) for x in words), np.int64, len(words))
        rest = np.flatnonzero(numbers < 0)
        part = np.fromiter((zlib.crc32(words[i].encode()) % parts for i in rest.tolist()), np.int64, len(rest))
        order = np.argsort(part, kind="stable")
        numbers[rest[order]] = len(head) + np.arange(len(rest))
        self.parts, firsts = np.unique(part[order], return_index=True)
        bounds = [*firsts.tolist(), len(rest)]
        words_ = [words[i] for i in rest[order].tolist()]
        #: For each part with words, these; no word holds a blank.
        self.tails = [" ".join(words_[a:b]).encode() for a, b in itertools.pairwise(bounds)]
        self.check = zlib.crc32(b"  ".join(self.tails))
        self.numbers = numbers[coded.indices.to_numpy()].astype("<u4")
        self.sizes = pc.list_value_length(lists).to_numpy().astype(np.int32)


def _blocks(docs: DataFrame, shared, parts: int, schema: T.StructType, row) -> DataFrame:
    """What ``row`` makes of each block: (number of the block, its rows, itself), as a batch."""

    def run(batches):
        head = {x: i for i, x in enumerate(_unpacked(shared.value).to_pylist())}
        at = TaskContext.get().partitionId() << 32
        for table in _grouped(batches):
            yield row(at, table, Block(table, head, parts))
            at += 1

    return docs.mapInArrow(run, schema)


def _asked(docs: DataFrame, shared, parts: int) -> DataFrame:
    """(_k, _block, _check, _data): the words of a block that are not in the head, packed by the part that segments them."""

    def row(at: int, table: pa.Table, block: Block) -> pa.RecordBatch:
        import zstandard

        packer = zstandard.ZstdCompressor(6)
        n = len(block.tails)
        data = [packer.compress(x) for x in block.tails]
        return pa.RecordBatch.from_arrays([pa.array(block.parts, pa.int32()), pa.array([at] * n, pa.int64()), pa.array([block.check] * n, pa.int64()), pa.array(data, pa.binary())], names=["_k", "_block", "_check", "_data"])

    return _blocks(docs, shared, parts, "_k int, _block long, _check long, _data binary", row)


def _answered(asked: DataFrame, model: str, parts: int) -> DataFrame:
    """``asked`` with the ids of the words in place of the words; a part meets all its words in one task, which segments each once."""

    def run(batches):
        import zstandard

        chunks = Chunks(model)
        packer, unpacker = zstandard.ZstdCompressor(6), zstandard.ZstdDecompressor()
        known: dict[str, bytes] = {}
        for batch in batches:
            lists = [unpacker.decompress(x).decode().split(" ") for x in batch.column(3).to_pylist()]
            new = [x for x in dict.fromkeys(itertools.chain.from_iterable(lists)) if x not in known]
            known.update(zip(new, chunks.segment(new).to_pylist(), strict=True))
            data = []
            for words in lists:
                made = [known[x] for x in words]
                sizes = np.fromiter(map(len, made), "<u4", len(made))
                data.append(packer.compress(sizes.view(np.uint8).reshape(-1, 4).T.tobytes() + b"".join(made)) + len(made).to_bytes(4, "little"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=batch.schema.names)

    return asked.repartitionById(parts, F.col("_k")).mapInArrow(run, asked.schema)


def _joined(docs: DataFrame, answers: DataFrame, shared_words, shared_ids, parts: int, width: str, id_col: str) -> DataFrame:
    """(id, ids) of documents: blocks meet the answers to what they asked."""
    id_field = docs.schema["_id"]
    id_type = to_arrow_type(id_field.dataType)
    sent = T.StructType([*answers.schema.fields, T.StructField("_ids", T.ArrayType(id_field.dataType)), T.StructField("_sizes", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField(id_col, id_field.dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def row(at: int, table: pa.Table, block: Block) -> pa.RecordBatch:
        import zstandard

        # bytes of one significance stand together: they pack better
        data = zstandard.ZstdCompressor(6).compress(block.numbers.view(np.uint8).reshape(-1, 4).T.tobytes())
        one = [0, len(table)]
        ids = pa.ListArray.from_arrays(pa.array(one, pa.int32()), _column(table, "_id"))
        sizes = pa.ListArray.from_arrays(pa.array(one, pa.int32()), pa.array(block.sizes))
        return pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([at]), pa.array([block.check], pa.int64()), pa.array([data], pa.binary()), ids, sizes], names=sent.names)

    def run(batches):
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        pool, many = _binary(_unpacked(shared_ids.value), width)
        first = np.cumsum(many) - many
        item = np.dtype(width).itemsize

        def whole(block: dict, answers: list[bytes]) -> pa.RecordBatch:
            extra, sizes = [np.zeros(0, width)], [np.zeros(0, np.int64)]
            for answer in answers:
                n = int.from_bytes(answer[-4:], "little")
                data = unpacker.decompress(answer[:-4])
                sizes.append(np.frombuffer(data[: 4 * n], np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64) // item)
                extra.append(np.frombuffer(data[4 * n :], width))
            extra, sizes = np.concatenate(extra), np.concatenate(sizes)
            numbers = np.frombuffer(unpacker.decompress(block["_data"]), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
            if max(int(numbers.max(initial=-1)) + 1, len(many)) != len(many) + len(sizes):
                raise ValueError(f"a block lacks words of its own among {len(sizes)} that came back")
            length = np.concatenate([many, sizes])[numbers]
            begin = np.concatenate([first, len(pool) + np.cumsum(sizes) - sizes])[numbers]
            stops = np.cumsum(length)
            place = np.repeat(begin - stops + length, length) + np.arange(stops[-1] if len(stops) else 0)
            ids = np.concatenate([pool, extra])[place].astype(np.int32)
            ends = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(block["_sizes"], dtype=np.int64)])].astype("i4")
            return pa.RecordBatch.from_arrays([block["_ids"].cast(id_type), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=schema.names)

        key, block, answers = None, None, []
        for batch in batches:
            ks, blocks, checks, data, ids, sizes = batch.columns
            for i, (k, *mine) in enumerate(zip(ks.to_pylist(), blocks.to_pylist(), checks.to_pylist(), strict=True)):
                if k >= 0:
                    if mine != key:
                        raise ValueError("words came back for a block that is not there: the input's rows changed between two passes")
                    answers.append(data[i].as_py())
                    continue
                if block:
                    yield whole(block, answers)
                key, answers = mine, []
                block = {"_data": data[i].as_py(), "_ids": ids[i].values, "_sizes": sizes[i].values.to_numpy()}
        if block:
            yield whole(block, answers)

    asking = _blocks(docs, shared_words, parts, sent, row)  # the union's first, so that its partitions keep their numbers
    rows = asking.unionByName(answers, allowMissingColumns=True)
    return rows.repartition("_block").sortWithinPartitions("_block", "_check", "_k").mapInArrow(run, schema)


def _repeatable(docs: DataFrame) -> bool:
    """Whether the rows are those of files, with columns chosen and rows filtered: they come in the same order each time."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = {line.lstrip(" :+-").split(" ")[0] for line in plan.toString().splitlines()}
    return plan.deterministic() and nodes <= {"Project", "Filter", "Relation"}


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(id, ids array<int>) of every row, without begin or end ids."""
    spark = docs.sparkSession
    chunks = Chunks(model)
    if not chunks.separable:
        return _by_library(docs, model, id_col, text_col)
    small_batches(spark)
    docs = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    scratch = Scratch(spark, "pieces")
    if not _repeatable(docs):
        docs = scratch.store(docs, "texts")
    words, ids = _head(docs, model, scratch, head_bytes)
    shared_words, shared_ids = (spark.sparkContext.broadcast(_packed(x, "x")) for x in (words, ids))  # bounded by head_bytes
    # a part has as many words as a partition of the input, so that a task can know all of its own
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs._jdf.queryExecution().toRdd().getNumPartitions())
    answers = _answered(_asked(docs, shared_words, parts), model, parts)
    return _joined(docs, answers, shared_words, shared_ids, parts, chunks.width, id_col)


def _by_library(docs: DataFrame, model: str, id_col: str, text_col: str) -> DataFrame:
    def make():
        library = Chunks(model).library

        def step(column: pa.Array) -> list:
            return [library.encode(texts(column), num_threads=1)]

        return step

    return map_columns(docs, [id_col], [text_col], T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))]), make)


def decode_documents(encoded: DataFrame, model: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``decoded``, the library's text of the ids."""

    def make():
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=model)

        def step(column: pa.Array) -> list:
            return [[library.decode(x.values.to_numpy().tolist()) if x.is_valid and len(x.values) else "" for x in column]]

        return step

    return map_columns(encoded, keep, [ids_col], T.StructType([T.StructField("decoded", T.StringType())]), make)
