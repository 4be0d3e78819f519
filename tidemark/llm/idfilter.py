"""Which rows may have an id from a set, told without a shuffle.

The ids' hashes set bits of a bitmap of fixed size, 4 MB however many ids there are, so it can always be
broadcast. A row whose bit is unset surely isn't in the set; the others (those in it, and by chance as
many more as the bitmap is full) still need a join. Past some ten million ids the bitmap fills up and
stops helping, but never errs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 25
#: Bits of one row of the bitmap, by Spark's bitmap functions.
ROW = 32768


def mark_possible(df: DataFrame, key: str, ids: DataFrame, out: str = "_possible") -> DataFrame:
    """``df`` with ``out``: false only where ``key`` is null or surely not among the first column of ``ids``."""
    (name,) = ids.columns[:1]
    bit = F.pmod(F.xxhash64(F.col(name).cast("bigint")), F.lit(BITS))
    bitmap = ids.where(F.col(name).isNotNull()).select(F.floor(bit / ROW).cast("int").alias("_row"), (bit % ROW).alias("_bit"))
    bitmap = bitmap.groupBy("_row").agg(F.expr("bitmap_construct_agg(_bit)").alias("_bits"))
    mine = F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(BITS))
    df = df.withColumn("_at", F.when(F.col(key).isNotNull(), mine))
    df = df.withColumn("_key_row", F.floor(F.col("_at") / ROW).cast("int"))
    df = df.join(F.broadcast(bitmap), F.col("_key_row") == F.col("_row"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast((_at % 32768) div 8 AS int) + 1, 1)")), 16, 10).cast("int")
    df = df.withColumn("_byte", byte).withColumn(out, F.coalesce(F.expr("shiftright(_byte, cast(_at % 8 AS int)) & 1 = 1"), F.lit(False)))
    return df.drop("_at", "_key_row", "_row", "_bits", "_byte")
