"""What the operators share: tables kept in the cluster's shared folder, column hygiene, bounded fingerprint filters.

Scale notes: tables are written once as Parquet below ``spark.checkpoint.dir``, which every executor can read, so that
a lost executor costs the tasks that ran on it and never a whole lineage; they are deleted when no later step reads them. The
fingerprint filter grows with its keys up to a bound: beyond some millions of keys it fills up and saves less work, and it
never decides a result.
"""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

#: A filter has sixteen bits a key, within these bounds: 8 MB is the most that is ever broadcast.
FILTER_BITS = (1 << 16, 1 << 26)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillgraph/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that no later step reads: what depends on them must have been settled itself."""
    for t in tables:
        hadoop = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.settled_in)
        hadoop.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Asks the driver to collect garbage, upon which Spark's cleaner deletes the shuffle files of plans that are done with: what was
    shuffled for a settled table would else stay on the executors' disks until the driver's memory fills up. Its heap, which grows
    with each plan that it makes, and the free memory of its Python go back to the system, and so does what the JVM's threads
    (compilers, broadcasts, compression) have allocated outside the heap and freed, which the C library would else keep."""
    spark.sparkContext._jvm.System.gc()
    _trim_jvm(spark)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def _trim_jvm(spark: SparkSession) -> None:
    """jcmd's System.trim_native_heap, asked of the driver's JVM from within. The server's class is hidden, its interface isn't."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    asked = new(jvm.Object, 4)
    asked[0], asked[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)
    except Py4JJavaError:  # a JVM without that command keeps its free memory
        pass


def whole_id(column: F.Column) -> F.Column:
    """An id as a 64-bit integer; null where it is none."""
    return column.try_cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have yet, one for each of names."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _column(column: str | F.Column) -> F.Column:
    return F.col(column) if isinstance(column, str) else column


def _places(column, bits: int) -> list:
    """Two bit numbers for each value of a column."""
    return [F.pmod(F.xxhash64(F.lit(k), column), F.lit(bits)) for k in (1, 2)]


def fingerprint_filter(df: DataFrame, column: str | F.Column, bits: int | None = None) -> np.ndarray:
    """A Bloom filter of a column of a settled table, as packed bits; tasks' filters are OR-ed on executors, in a few tasks."""
    if bits is None:
        bits = min(max(FILTER_BITS[0], 1 << (16 * df.count()).bit_length()), FILTER_BITS[1])

    def part(batches):
        held = np.zeros(bits, dtype=bool)
        for batch in batches:
            for k in (0, 1):
                held[batch.column(k).to_numpy()] = True
        yield pa.RecordBatch.from_pydict({"packed": [np.packbits(held, bitorder="little").tobytes()]})

    def union(batches):
        held = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            for packed in batch.column(0):
                held |= np.frombuffer(packed.as_buffer(), dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"packed": [held.tobytes()]})

    one, two = _places(_column(column), bits)
    held = np.zeros(bits // 8, dtype=np.uint8)
    for row in df.select(one.alias("one"), two.alias("two")).mapInArrow(part, "packed binary").repartition(8).mapInArrow(union, "packed binary").collect():
        held |= np.frombuffer(row[0], dtype=np.uint8)
    return held


def may_hold(df: DataFrame, column: str | F.Column, packed: np.ndarray, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be in a filter; with left_anti those whose key surely isn't. Without Python.

    The filter travels as one broadcast row of its fixed size, as an array of 64-bit words that is read in place. It reaches the
    driver's JVM by Arrow: as a list it would be a million objects on both sides.
    """
    words = pa.ListArray.from_arrays(pa.array([0, len(packed) // 8], pa.int32()), pa.array(packed.view("<i8")))
    bits = df.sparkSession.createDataFrame(pa.table({"filter_bits": words}), "filter_bits array<bigint>")
    found = F.lit(True)
    for place in _places(_column(column), len(packed) * 8):
        word = F.get(F.col("filter_bits"), F.floor(place / 64).cast("int"))
        found = found & (F.getbit(word, (place % 64).cast("int")) == 1)
    return df.join(F.broadcast(bits), found, how)


def split_by(df: DataFrame, column: str | F.Column, packed: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """The rows whose key may be in a fingerprint filter, and the rows whose key surely isn't."""
    return may_hold(df, column, packed), may_hold(df, column, packed, "left_anti")


def first_by_hash(df: DataFrame, key: str, id_col: str, per: int) -> DataFrame:
    """(key, id, n): of each key the per ids whose hashes come first, with their place n.

    Keys are few (labels, languages: a model holds weights for each), so their counts are broadcast. Ids whose hash lies beyond
    twice the share that is wanted go before anything is shuffled: few rows of a key meet, however many it has.
    """
    counted = df.groupBy(F.col(key).alias("key_")).agg(F.approx_count_distinct(id_col).alias("ids_"))
    place = F.xxhash64(id_col) / F.lit(float(1 << 64)) + 0.5  # uniform in 0..1, in the order of the hash
    near = df.join(F.broadcast(counted), df[key] == F.col("key_")).filter(place * F.col("ids_") <= 2.0 * per + 50).select(key, id_col).distinct()
    return near.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(id_col), id_col))).filter(F.col("n") <= per)
