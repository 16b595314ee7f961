"""What the operators share: scratch tables, bounded Arrow slices and byte-level text kernels."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import InheritableThread

#: White space of every contract: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"

#: Python-side work takes at most this many text bytes at a time (a longer text stands alone).
SLICE_BYTES = 1 << 19

#: Share of its bound from which the driver's heap is given back, and seconds between two looks at it.
HEAP_SHARE, LOOK_S = 1 / 3, 10


# ---------------------------------------------------------------- scratch tables


def _local(spark: SparkSession) -> bool:
    return bool(re.match(r"local(\[|$)", spark.sparkContext.master))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where the master is local."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/inkfield"


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder's owner sweeps it then
        pass


def _give_back_jvm(spark: SparkSession, always: bool = False) -> None:
    """Collects the garbage of the driver's JVM and returns what is free then to the system, heap and C library's arenas,
    if its heap has grown beyond HEAP_SHARE of the most it may have (or always)."""
    sc = spark.sparkContext
    jvm, new_array = sc._jvm, sc._gateway.new_array
    runtime = jvm.java.lang.Runtime.getRuntime()
    if not always and runtime.totalMemory() < HEAP_SHARE * runtime.maxMemory():
        return
    jvm.System.gc()
    try:
        kind, names = jvm.java.lang.Class, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
        types, args = new_array(kind, 4), new_array(jvm.java.lang.Object, 4)
        for k, name in enumerate(names):
            types[k] = kind.forName(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args)
    except Exception:  # not every JVM has this command
        pass


@contextmanager
def _giving_back(spark: SparkSession) -> Iterator[None]:
    """While a query runs, its tasks' events make garbage in the driver, upon which the heap grows to its bound although
    little of it is in use; a thread looks every LOOK_S seconds and gives back."""
    over = threading.Event()

    def look() -> None:
        while not over.wait(LOOK_S):
            try:
                _give_back_jvm(spark)
            except Exception:  # the session may be gone; the query says so itself
                return

    thread = InheritableThread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()


def materialise(df: DataFrame, tag: str, clean: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, and survives lost
    executors because the files have no owner. Deleted by release(), or when the driver ends. clean: the driver of a
    cluster collects its garbage then, upon which Spark drops the shuffle files that only led to this table; else it
    does so, then and meanwhile, where its heap has grown."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{tag}-{uuid.uuid4().hex}"
    with nullcontext() if _local(spark) else _giving_back(spark):
        df.write.parquet(path)
    atexit.register(_delete, spark, path)
    if not _local(spark):
        _give_back_jvm(spark, clean)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._scratch)  # type: ignore[attr-defined]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it apart from df's columns (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct: beside it, no name can clash. `row.*` gives them back."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")


def sieve(rows: DataFrame, key: Column, wanted: DataFrame, bits: int = 22) -> DataFrame:
    """Rows that may have a key among those wanted (one column), without moving any: a bitmap of 2 ** bits hashes in
    words of 64, at most 2 ** (bits - 6) rows however many keys there are. It lets some others pass, the more the
    fuller it is, and never drops a wanted one; an exact join of what passes follows."""
    at, word, mask = fresh(rows, "at", "word", "mask")

    def place(k: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(k), 64 - bits)

    one = F.expr(f"shiftleft(1L, cast({at} % 64 as int))")
    words = wanted.select(place(F.col(wanted.columns[0])).alias(at)).groupBy(F.floor(F.col(at) / 64).alias(word)).agg(F.bit_or(one).alias(mask))
    marked = rows.withColumn(at, place(key)).withColumn(word, F.floor(F.col(at) / 64))
    return marked.join(F.broadcast(words), word).filter(F.col(mask).bitwiseAND(one) != 0).select(*map(quoted, rows.columns))


#: Groups that hold at least one row in so many are joined by broadcast: there are never more of them.
HOT_SHARE = 256


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined with groups on keys, one group for each key, `count` its number of rows of `total`. A group of
    more than a 256th of all rows is sent to the rows instead of its rows to one task: at most 256 such groups exist."""
    hot = F.broadcast(groups.filter(F.col(count) * HOT_SHARE >= total))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(groups.filter(F.col(count) * HOT_SHARE < total), keys)
    return rows.join(hot, keys).unionByName(rest)


def ranks(values: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct values of a column, nulls last, each with its number from 0 in their order: value (named as before) and
    `name`. Sorted in ranges, numbered within them, and moved on by what the ranges before hold: no global window."""
    from pyspark.sql import Window

    part, k, first, n = fresh(values.select(column), "part", "k", "first", "n")
    order = F.col(quoted(column)).asc_nulls_last()
    d = values.select(F.col(quoted(column))).distinct().repartitionByRange(order)
    d = materialise(d.withColumn(part, F.spark_partition_id()), "ranks")
    d = d.withColumn(k, F.row_number().over(Window.partitionBy(part).orderBy(order)))
    # one row for each range
    starts = d.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    starts = starts.withColumn(first, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop(n)
    return d.join(starts, part).select(F.col(quoted(column)), (F.col(k) + F.col(first) - 1).cast("long").alias(name))


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of long texts stay small: a batch is held whole on both sides of the pipe. Workers find this
    package where the driver found it, wherever they are started."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def give_back_memory() -> None:
    """Returns what fitting a model has freed to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters, JVM-side; null counts as none."""
    runs = F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x")
    return F.when(text.rlike(f"[^{SPACE}]"), F.length(runs)).otherwise(F.lit(0)).cast("long")


# ---------------------------------------------------------------- Arrow slices


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of one slice have at most `limit` bytes, or one row."""
    for batch in batches:
        a = batch.column(column)
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(a), 0)).astype(np.int64)
        total, start = np.concatenate([[0], np.cumsum(size)]), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty; offsets start at 0."""
    a = pc.fill_null(a, "").cast(pa.large_binary())
    n = len(a)
    _, off, data = a.buffers()
    off = np.frombuffer(off, np.int64, n + 1, a.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


# ---------------------------------------------------------------- byte kernels

_rng = np.random.default_rng(20240229)
#: One odd 64-bit value for each byte, and the base of the polynomial hash.
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 1 << 23:
            _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on all."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = hash of data[i:j] times BASE ** i."""
    p = np.empty(len(data) + 1, np.uint64)
    p[0] = 0
    np.cumsum(BYTE_KEY[data] * powers(BASE, len(data)), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:stop], from prefix_hash(data)."""
    inv = powers(BASE_INV, len(p))
    return mix((p[stop] - p[start]) * inv[start] + (stop - start).astype(np.uint64))


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of each word; a word never crosses rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~IS_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = word[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = word[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(off, start, "right") - 1


def segment_sum(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)
