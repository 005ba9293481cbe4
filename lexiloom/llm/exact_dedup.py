"""Exact dedup by progressive refinement, in built-in functions only.

Rows are told apart by ever dearer keys, and only rows that share a key go on
to the next one:

1. length of the text in bytes;
2. length and a hash of the first ``PREFIX`` characters;
3. SHA-256 of the whole text, taken only of rows whose first two keys are shared.

Keys are counted with partial aggregation.  Shared keys come back to the rows as
a bitmap of one bit for a hashed key, at most ``MOST_BITS`` of them: its size is
bounded whatever the input, so it is broadcast, and texts are never shuffled.  A
row that hits a bit by chance only has its text read in vain: the last key
decides.  Eight bits a key (up to ``MOST_BITS``) leave one such row in eight.

Keepers come back to their copies in a join, but for groups that hold more than
a ``1 / (SPREAD * shuffle partitions)`` part of all rows: there are at most
``SPREAD * shuffle partitions`` of those, and they are broadcast, so that no
task gets a large group.

Defined cases: a null text is an empty one; of equal texts the row with the
largest id stays, a null id being smaller than any other; where the largest id
repeats, exactly one of its rows stays; an empty table gives an empty result;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import drop_path, durable, shuffle_width

#: Characters of the prefix key.
PREFIX = 128
#: Most bits of a broadcast bitmap (32 MB), and bits for each key below that.
MOST_BITS, BITS_A_KEY = 1 << 28, 8
#: Bits in a row of a bitmap, as Spark's bitmap functions have it.
ROW_BITS = 1 << 15
#: Groups are broadcast that are larger than this part of the mean shuffle partition.
SPREAD = 4


def _bits_for(keys: int, most: int) -> int:
    bits = ROW_BITS
    while bits < min(most, keys * BITS_A_KEY):
        bits *= 2
    return bits


def shared_keys(rows: DataFrame, key: Column, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """The hashed keys that two or more rows have, as a bitmap, and its bits."""
    return key_bitmap(rows.groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n > 1").select("k"), most_bits)


def key_bitmap(keys: DataFrame, most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """Hashed keys (``k``) as a bitmap (``bucket, bitmap``), and its bits."""
    held_keys, path = durable(keys, "keys")
    bits = _bits_for(held_keys.count(), most_bits)
    slot = F.pmod("k", F.lit(bits)) + 1  # Spark counts bits from 1
    bitmap = held_keys.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bitmap"))
    held, _ = durable(bitmap.coalesce(1), "bitmap")  # at most MOST_BITS / ROW_BITS rows
    drop_path(keys.sparkSession, path)
    return held, bits


def with_hits(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int) -> DataFrame:
    """``rows`` with ``hit``: is the bit of the row's key set?  No key that is shared is missed."""
    slot = F.pmod(key, F.lit(bits)) + 1
    found = rows.withColumn("slot", slot).join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    place = F.bitmap_bit_position("slot")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return found.withColumn("hit", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("slot", "bucket", "bitmap")


def equal_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept`` of every row of ``df``.

    ``carry`` names further small columns, expressions over ``df``, that are
    taken along where the text is read.
    """
    spark, carry = df.sparkSession, carry or {}
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    shape = [F.octet_length(text).cast("long").alias("n"), F.xxhash64(F.substring(text, 1, PREFIX)).alias("p")]
    length, prefix = F.xxhash64("n"), F.xxhash64("n", "p")

    shapes, shapes_path = durable(df.select(*shape), "shapes")
    lengths, length_bits = shared_keys(shapes, length, most_bits)
    prefixes, prefix_bits = shared_keys(with_hits(shapes, length, lengths, length_bits).where("hit"), prefix, most_bits)

    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"), *shape, F.struct(*[c.alias(name) for name, c in carry.items()]).alias("more") if carry else F.lit(None).cast("int").alias("more"))
    read = with_hits(rows, prefix, prefixes, prefix_bits).select("doc_id", F.when(F.col("hit"), F.unhex(F.sha2("t", 256))).alias("full"), "more", F.monotonically_increasing_id().alias("row"))
    held, _ = durable(read, "refined")
    drop_path(spark, shapes_path)

    of = held.where("full is not null")
    groups, _ = durable(of.groupBy("full").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")).where("group_size > 1"), "groups")
    limit = max(1, held.count() // (SPREAD * shuffle_width(spark)))
    large, small = groups.where(F.col("group_size") > limit), groups.where(F.col("group_size") <= limit)
    met = of.join(F.broadcast(large), "full", "left")  # at most SPREAD rows for each shuffle partition
    alone = held.where("full is null").withColumns({"group_size": F.lit(1).cast("long"), "keep": F.struct("doc_id", "row")})
    found = met.where("keep is not null").unionByName(met.where("keep is null").drop("group_size", "keep").join(small, "full", "left")).unionByName(alone)
    kept = F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True))
    keep_id = F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), kept.alias("kept"), *[F.col(f"more.`{name}`").alias(name) for name in carry])


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose texts differ, every column as it is: of equal texts the row with the largest id stays.

    Of rows that repeat id and text together one stays for each id.
    """
    kept = equal_texts(df, id_col, text_col).where("kept").select(F.col("doc_id").alias(id_col))
    null_safe = df[f"`{id_col}`"].eqNullSafe(kept[f"`{id_col}`"])
    return df.join(kept, null_safe, "left_semi")
