"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..workspace import shared_dir, ship

#: Characters that separate words: blank, tab, line feed, vertical tab, form
#: feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a class for Java's regular expressions.
WORD_CHAR = r"[^\x20\x09-\x0D]"

#: Rows of an Arrow batch that goes to Python: with texts of 100 kB it has 25 MB.
ROWS_PER_BATCH = 256


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    It cuts the lineage: what comes after a loss of executors starts from these
    files, which any executor can read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run, in a folder of their own below the shared one.

    A table may go once what is made of it is stored: nothing that comes later
    needs it, also after a loss of executors.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.tables: dict[int, str] = {}

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once as Parquet and read from there."""
        path = f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = path
        out._scratch = self  # keeps id(out) from being used again
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(self.tables.pop(id(df)))

    def clear(self, *but: DataFrame) -> None:
        """Drop all tables except those in ``but``."""
        left = {id(df) for df in but}
        for k in [k for k in self.tables if k not in left]:
            self._delete(self.tables.pop(k))

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows that the driver holds as a part of the plan: neither a job nor a Python worker makes them."""
    fields = T.StructType.fromDDL(schema)
    columns = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=fields.names), fields)


def hand_back(spark: SparkSession) -> bool:
    """Give the system what the driver has freed; whether its JVM could.

    Arrow's pool keeps what Python frees, and the C library what the JVM frees
    beside its heap (compiler, threads, buffers): in a driver that runs many plans
    that is more than 200 MB.  JVMs without the command keep it.
    """
    pa.default_memory_pool().release_unused()
    jvm = spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's class is hidden: its interface has the method
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        arguments[0], arguments[1] = name, "systemTrimNativeHeap"
        invoke.invoke(server, arguments)
    except Py4JError:
        return False
    return True


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Give executors this package and keep Arrow batches small, so that a Python worker's memory is bounded with long texts."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, rows)


def map_columns(
    df: DataFrame,
    keep: Sequence[str],
    take: Sequence[str],
    add: T.StructType,
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Rows of ``keep`` with the columns ``add``, computed in Python from ``take``.

    ``make()`` runs once in each task; what it returns gets one Arrow array for
    each column of ``take`` and returns one array or list for each of ``add``.
    No other column of ``df`` is read, so that further columns cannot clash.
    """
    small_batches(df.sparkSession)
    columns = list(dict.fromkeys([*keep, *take]))
    source = df.select(*(F.col(f"`{c}`") for c in columns))
    types = [to_arrow_type(f.dataType) for f in add.fields]
    names = [*keep, *add.names]

    def run(batches):
        step = make()
        for batch in batches:
            made = step(*(batch.column(columns.index(c)) for c in take))
            made = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)) for c in keep), *made], names=names)

    kept = [T.StructField(c, source.schema[c].dataType, True) for c in keep]
    return source.mapInArrow(run, T.StructType([*kept, *add.fields]))


def texts(column: pa.Array) -> list[str]:
    """The column's texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


#: Values that a prefix is folded over at most; prefixes of groups of them are kept.
STEP = 64


def prefixes(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value, ``op`` over all values before it (``zero`` for the first).

    Three levels: groups of 64 values, groups of 64 of those.  A value costs some
    64 steps, however many there are; appending to an array would copy it each time.
    """
    fold = lambda a: F.aggregate(a, zero, op)
    first = lambda i: F.floor(i / STEP).cast("int")
    groups = lambda v: F.transform(F.sequence(F.lit(0), first(F.greatest(F.size(v) - 1, F.lit(0)))), lambda g: fold(F.slice(v, g * STEP + 1, F.lit(STEP))))
    upto = lambda v, before: F.transform(v, lambda x, i: op(before[first(i)], fold(F.slice(v, first(i) * STEP + 1, i % STEP))))
    top = lambda v: F.transform(v, lambda x, i: fold(F.slice(v, F.lit(1), i)))
    return bound(values, lambda v: bound(groups(v), lambda one: bound(groups(one), lambda two: bound(top(two), lambda x: bound(upto(one, x), lambda y: upto(v, y))))))


def spans_of(text: Column, pattern: str | Column, hint: str | None = None) -> Column:
    """array<struct<s int, e int, m string>>: the leftmost non-overlapping matches of ``pattern``.

    Offsets are code points, the end is exclusive.  What lies between matches
    comes from ``split``, the matches from ``regexp_extract_all``: both run the
    same search, so that lengths add up to offsets without Python.  Time is linear
    in text and matches.  ``hint``: what every match holds; texts without it are
    not searched.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"))

    def placed(x: Column) -> Column:
        lengths = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m))
        return bound(prefixes(lengths, F.lit(0), lambda a, n: a + n), lambda at: F.transform(x["m"], lambda m, i: bound(at[i] + F.length(x["g"][i]), lambda s: F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")))))

    there = F.rlike(text, pattern) if hint is None else F.contains(text, F.lit(hint)) & F.rlike(text, pattern)
    return F.when(there, bound(parts, placed)).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


#: Characters of a block of text.
BLOCK = 1024


def blocks_of(text: Column) -> Column:
    """The text in blocks, from which ``piece`` cuts without going through all of it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def piece(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` (0-based, exclusive) of a text in blocks."""
    first = F.floor(begin / BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, F.greatest(F.lit(0), F.floor((end - 1) / BLOCK).cast("int") - first + 1)), "")
    return F.when(end > begin, F.substr(some, begin - first * BLOCK + 1, end - begin)).otherwise("")


def span_text(spans: Column) -> Column:
    """kind:start:end of array<struct<s, k, e, kind>> by start, then the kind's place; comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def word_count(text: Column) -> Column:
    """The number of words (runs of other characters than the six blanks); null: 0."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_CHAR + "++", "w")
    return F.length(F.translate(marks, BLANKS, "")).cast("long")
