"""What the operators share: written intermediate tables, joins that check sizes, free column names."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast when its rows times their width are no more than this; else the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Most bits of a bitmap of keys (8 MB, however many keys there are).
BITMAP_BITS = 1 << 26
#: Rows of an Arrow batch of texts where the session has Spark's own number; ten thousand texts take too much memory on
#: both sides of the pipe.
BATCH_ROWS, SPARK_BATCH_ROWS = 1000, "10000"
_own: dict[str, str] = {}
_scopes: list[list[Tables]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or in a single local process an own temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if named:
        return f"{named.rstrip('/')}/{app}"
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        folder = tempfile.TemporaryDirectory(prefix="textquarry-")
        atexit.register(folder.cleanup)
        spark.sparkContext.setCheckpointDir(folder.name)
        _own[app] = folder.name
    return f"{_own[app]}/{app}"


class Tables:
    """Intermediate tables of one operator call, in the shared folder; each cuts the lineage before it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        for scope in _scopes[-1:]:
            scope.append(self)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int | None = None) -> None:
        """Deletes table n, or all; only for tables that no result still reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path if n is None else f"{self.path}/{n}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes at its end what operators called inside have written; by then their results have to be written elsewhere."""
    made: list[Tables] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for tables in made:
            tables.drop()


def small(df: DataFrame, row_bytes: int, most: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted size allows. df should be a written table, as it is counted."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def maybe_in(keys: DataFrame, value: Column, most_bits: int = BITMAP_BITS) -> Column:
    """Whether the 64-bit number `value` may be among those of the one column of keys: true for all that are, and for few
    others as long as keys are fewer than bits.

    It thins out wide rows before a join that decides, so that a join shuffles what it needs at every size and nothing
    that grows with the data is broadcast: a bitmap has at most most_bits, and at most a word each 64 of them comes to
    the driver. keys should be a written table, as it is counted.
    """
    bits = 64
    wanted = 16 * keys.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits).cast("long"))
    word = lambda c: F.shiftright(place(c), 6).cast("int")
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (place(c) % 64).cast("int"))
    key = F.col(keys.columns[0])
    found = keys.select(word(key).alias("word"), bit(key).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    one = keys.sparkSession.createDataFrame(pa.table({"bits": pa.array([table], pa.list_(pa.int64()))}))
    return one.scalar()[word(value)].bitwiseAND(bit(value)) != 0


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that clash with none of the taken ones, whatever the case."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def content_id(text: str | Column) -> Column:
    """64 bits that stand for a text; null for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.when(col.isNotNull(), F.xxhash64(col))


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the parts; DuckDB computes the same from the same strings."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def unit_sql(*parts: str) -> str:
    return f"((('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT + 0.5) / {float(1 << 52)!r})"


def key_string(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("\\N"))


def release() -> None:
    """Gives freed memory of this worker back: it stays for later tasks while others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Sets the session's rows of an Arrow batch to BATCH_ROWS, unless it was set to something else than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == SPARK_BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str, *, chars: int = 4_000_000, text: str = "text") -> DataFrame:
    """mapInArrow with batches cut so that each holds about `chars` bytes of the text column (a longer text is one)."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            begin = total = 0
            for i, n in enumerate(sizes.tolist() + [0]):
                last = i == len(sizes)
                if i > begin and (last or total + n > chars):
                    out = fn(batch.slice(begin, i - begin))
                    if isinstance(out, pa.RecordBatch):
                        yield out
                    elif out is not None:
                        yield from out
                    begin, total = i, 0
                total += n
        release()

    return df.mapInArrow(run, schema)
