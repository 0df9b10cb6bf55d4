"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.sources.scratch import new_path, remove


def written(df: DataFrame, name: str, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, a lost executor recomputes nothing before it, and
    every reader sees the same rows. spent: tables of this function that nothing but df reads; they are removed now, all
    others when the process ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    remove(df.sparkSession, *(table._written_at for table in spent))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. One that is stored in fewer parts than there are cores, so a small one, is dealt out to all of
    them; a large one is read as it lies, without a shuffle."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Bits of the bitmap of `only`.
HASH_BITS = 1 << 24


def only(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not among the wanted ones: those stay whose hash is one of theirs. The bitmap
    of hashes is of fixed size, so it is sent to all tasks, and rows that nobody wants are never shuffled. A null key is one like any."""
    at = F.pmod(F.xxhash64(key), F.lit(HASH_BITS))
    chunk, bit, bits = (free(c, rows.columns) for c in ("_chunk", "_bit", "_bits"))
    spread = lambda some: some.withColumns({chunk: F.floor(at / 32768).cast("int"), bit: (at % 32768).cast("int")})
    table = spread(wanted.select(key)).groupBy(chunk).agg(F.bitmap_construct_agg(bit).alias(bits))
    met = spread(rows).join(F.broadcast(table), chunk)
    byte = F.conv(F.hex(F.expr(f"substring(`{bits}`, `{bit}` div 8 + 1, 1)")), 16, 10).cast("int")
    return met.filter(F.getbit(byte, F.col(bit) % 8) == 1).select(*rows.columns)


def free(name: str, taken: Iterable[str]) -> str:
    """This name, with underscores before it until none of the taken columns has it in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


def share_of(sample: int, rows: int, *by: Column | str) -> Column:
    """Whether a row falls into a sample of about so many of the rows, by a hash of these columns."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 40)) < int(min(1.0, sample / max(1, rows)) * (1 << 40))


def portions(batch: pa.RecordBatch, column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """batch in slices whose strings of this column hold about so many bytes; a longer string is a slice of its own."""
    data = batch.column(batch.schema.get_field_index(column))
    sizes = data.cast(pa.large_string() if pa.types.is_string(data.type) else pa.large_binary())
    ends = np.cumsum(np.nan_to_num(np.array(pc.binary_length(sizes).to_pylist(), dtype=float)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
