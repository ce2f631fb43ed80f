"""Shared plumbing of the corpus operators: tables, checkpoints, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of anything but ASCII white space; bytes.split() cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch: texts are a few KB, so a batch is a few MB.
BATCH_ROWS = 256
#: Rows up to which a table by key is broadcast; a larger one is joined over SALTS copies, as a key can have a third of all rows.
BROADCAST_ROWS, SALTS = 200_000, 16
#: Bits of a bitmap of hashes (4 MB), in rows of 32 768.
BITMAP_BITS = 1 << 25
#: Seconds from which the driver's unused memory is given back again, and when it last was.
RELEASE_S = 5
_released = [float("-inf")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: that of ``spark.checkpoint.dir``. Only a local session may do without, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        place = context.getConf().get("spark.checkpoint.dir")
        if not place:
            if not context.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = tempfile.mkdtemp(prefix="ledgerloom-")
        context.setCheckpointDir(place)
    return context._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if time.monotonic() - _released[0] >= RELEASE_S:
        release_driver(df.sparkSession)
    return out


def attach(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", most: int | None = None) -> DataFrame:
    """Join with a table of one row for each key, without bringing a key's rows together; `most`: rows that `small` has at most, if known."""
    if most is None:
        small = stored(small)
        most = small.count()
    if most <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(SALTS)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def _cell(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(BITMAP_BITS))


def bitmap(rows: DataFrame, key: str) -> DataFrame:
    """(_cells, _bits): which hashes the keys have, nulls too. It is broadcast whatever the number of keys, in place of a table of them."""
    cell = _cell(key)
    return stored(rows.groupBy(F.bitmap_bucket_number(cell).alias("_cells")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("_bits")))


def maybe_among(rows: DataFrame, key: str, bits: DataFrame, flag: str) -> DataFrame:
    """Rows with a flag that is true for all keys of the bitmap and for few others."""
    cells, bit = unused("_in_cells", rows), unused("_in_bits", rows)
    known = bits.select(F.col("_cells").alias(cells), F.col("_bits").alias(bit))
    at = F.bitmap_bit_position(_cell(key)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bit), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(known), F.bitmap_bucket_number(_cell(key)) == F.col(cells), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False)).alias(flag))


def release_memory() -> None:
    """Give back what a Python worker no longer uses: it idles between tasks beside the JVM and the next task's worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> str:
    """Give back what the driver no longer uses; what its JVM says of it, empty where it cannot.

    Jobs, compilers and broadcasts of each plan run in threads of their own (some 600), whose freed native memory stays with the allocator:
    over many plans a driver grows by that, and not by its heap.
    """
    release_memory()
    said = ""
    with contextlib.suppress(Exception):  # other JVMs, and old ones, have no such command
        jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        given = [command, "systemTrimNativeHeap", array(jvm.Object, 0), array(jvm.String, 0)]
        kinds, values = array(jvm.Class, len(given)), array(jvm.Object, len(given))
        for i, x in enumerate(given):
            kinds[i], values[i] = jvm.java.lang.Class.forName("java.lang.String") if isinstance(x, str) else x.getClass(), x
        # by the interface's method: the server's own class is not open to reflection
        call = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        said = str(call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values))
    _released[0] = time.monotonic()
    return said


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: Arrow batches are counted in rows, and texts can be long. Never raises what the session has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(df: DataFrame, text: str, keep: list[str], function: Callable[[pa.RecordBatch], pa.RecordBatch], more: str) -> DataFrame:
    """Run `function` over Arrow batches of the kept columns and `text` as bytes (column ``_text``); it returns the kept ones and `more`."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield function(batch)
        release_memory()

    rows = df.select(*keep, F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(more).fields]))


def unused(name: str, *frames: DataFrame) -> str:
    """A name like the given one that no column of the frames has, whatever its case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def crc_bucket(doc_id: str, mod: int):
    """crc32 of the id written as text, modulo `mod`; null ids count as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(mod))
