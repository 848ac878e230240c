"""Exact dedup by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each step looks only at the groups that the one before left with two rows or more. The steps on length and prefix work
on a narrow table of numbers. Which (length, prefix) groups survive is kept as a bitmap of fixed size, so that the scan
for the full hash can skip the other texts without moving any text; a false hit there costs one hash, nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

WHITE = r"[\x20\x09-\x0D]+"
BITMAP_BITS = 1 << 26
_SLICE = 32768  # bits in one row of bitmap_construct_agg


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, prefix_chars: int = 256, digest: bool = False) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, keep_id, group_size, kept, and text_sha256 if `digest`.

    Texts are equal when they are identical after replacing each run of white space by one space; a null text is empty.
    Of equal texts the row with the smallest doc_id stays; a null doc_id comes last, and of rows that repeat a doc_id one
    stays. keep_id is the doc_id of the row that stays. An empty table gives an empty table; other columns aren't read.
    """
    norm = normalised(F.col("text"))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).select("doc_id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))
    narrow = written(keys.select("len", "prefix"), "keys")
    # Written, so that the join can split a length that many texts have.
    lengths = written(narrow.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "lengths")
    alike = narrow.join(lengths.hint("merge"), "len", "left_semi").groupBy("len", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    bit = lambda: F.pmod(F.xxhash64("len", "prefix"), F.lit(BITMAP_BITS))
    # At most BITMAP_BITS / 8 = 8 MB, whatever the input, hence the broadcast.
    # The bits are dealt by slice before they are joined, as a number each, not as a bitmap of each task.
    dealt = alike.select(bit().alias("bit")).withColumn("slice", F.bitmap_bucket_number("bit")).repartition("slice")
    bitmap = written(dealt.groupBy("slice").agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), "bitmap")
    with_bit = keys.withColumn("bit", bit()).join(F.broadcast(bitmap), F.bitmap_bucket_number("bit") == F.col("slice"), "left")
    place = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_bit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (place % 8 + 1).cast("int"))) != 0, F.lit(False))
    full = F.when(set_bit, F.sha2(F.encode("norm", "UTF-8"), 256))
    if digest:
        rows = with_bit.select("doc_id", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), set_bit.alias("alike"))
        rows = rows.withColumn("full", F.when(F.col("alike"), F.col("text_sha256"))).drop("alike")
    else:
        rows = with_bit.select("doc_id", full.alias("full"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "hashes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    groups = rows.where("full is not null").groupBy("full").agg(F.count("*").alias("n"), first.alias("stay")).where("n > 1")
    groups = written(groups.select("full", "n", F.col("stay.doc_id").alias("keep_id"), F.col("stay.row").alias("stay")), "groups")
    # Texts that no step found alike have no hash to join by; they go by, so that they aren't one key.
    alike = rows.where("full is not null").join(groups.hint("merge"), "full", "left")
    lonely = rows.where("full is null").withColumns({"n": F.lit(None).cast("long"), "keep_id": F.lit(None).cast("long"), "stay": F.lit(None).cast("long")})
    out = alike.unionByName(lonely.select(alike.columns))
    alone = F.col("n").isNull()
    columns = [
        F.col("doc_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("stay"))).alias("kept"),
    ]
    return out.select(*columns, *(["text_sha256"] if digest else []))
