"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash of what survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import BLANKS, Scratch, if_small

#: Normalised code points that the second level hashes; bits for each shared cell, and of the whole bitmap at most.
PREFIX, EACH, BITS = 64, 16, 1 << 26
#: Bits of a bitmap row, as Spark's bitmap functions have them.
ROW = 32768


def marked(cells: DataFrame, key: Column) -> DataFrame:
    """Rows (row, bits) of a bitmap that has a cell's bit set; at most BITS / ROW rows, 8 MB."""
    bits = min(BITS, max(ROW, 1 << max(0, cells.count() * EACH - 1).bit_length()))
    place = F.pmod(key, F.lit(bits))
    rows = cells.select(F.bitmap_bucket_number(place).alias("row"), F.bitmap_bit_position(place).alias("bit"))
    return rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).withColumn("of", F.lit(bits))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of docs, built from DataFrame functions only.

    Texts are equal if identical after deleting ASCII white space. The row of a group with the most code points in its
    original text stays, then the smallest id; null ids sort last.

    Level 1 counts rows by normalised length and level 2 counts the rows of shared lengths by a hash of their first
    PREFIX code points; both work on a table of ids and small numbers. Level 3 hashes whole contents with SHA-256, but
    only of rows whose (length, prefix) cell has company; digest_all asks for everyone's digest, else it is null for
    rows that an earlier level has already told apart. Texts are never shuffled: shared cells go to the scan as a bitmap
    of at most 8 MB. Other cells that meet a set bit (one in EACH at most, up to BITS / EACH cells; more beyond) only cost
    a needless hash.

    Null text counts as empty, and all empty texts are one group. Repeated rows (same id, same text) belong to one
    group and are all kept if their id is the one that stays. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("points"), F.regexp_replace(text, BLANKS, "").alias("norm"))
    rows = rows.select("id", "points", F.char_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), "norm")

    sig = scratch.write(rows.select("len", "prefix"), "sig")
    shared = F.col("n") > 1
    lengths = scratch.write(sig.groupBy("len").agg(F.count("*").alias("n")).where(shared).select("len"), "lengths")
    inside = sig.join(if_small(lengths, lengths.count(), 16), "len", "left_semi")
    cells = scratch.write(inside.groupBy("len", "prefix").agg(F.count("*").alias("n")).where(shared).select("len", "prefix"), "cells")

    key = F.xxhash64("len", "prefix")
    bitmap = scratch.write(marked(cells, key), "bitmap")
    bits = bitmap.agg(F.max("of")).first()[0] or ROW
    place = F.pmod(key, F.lit(bits))
    flagged = rows.withColumn("place", place).join(F.broadcast(bitmap.select("row", "bits")), F.bitmap_bucket_number("place") == F.col("row"), "left")
    # The bit's byte as a number, shifted to the bit.
    bit = F.bitmap_bit_position("place")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    live = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), bit % 8)), F.lit(2)) == 1, F.lit(False))
    digest = F.unhex(F.sha2("norm", 256))
    hashed = scratch.write(flagged.select("id", "points", live.alias("live"), (digest if digest_all else F.when(live, digest)).alias("digest")), "hashed")

    first = F.min(F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("none"), F.col("id"))).alias("first")
    groups = hashed.where("live").groupBy("digest").agg(first, F.count("*").alias("n")).where(shared)
    groups = scratch.write(groups.select("digest", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size")), "groups")
    single = hashed.where(~F.col("live")).withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long")})
    several = hashed.where("live").join(groups.withColumn("found", F.lit(True)), "digest", "left")
    several = several.withColumns({"keep_id": F.when(F.col("found"), F.col("keep_id")).otherwise(F.col("id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})
    scratch.drop("sig", "lengths", "cells", "bitmap")
    out = ["id", "keep_id", "group_size", "digest"]
    both = single.select(out).unionByName(several.select(out))
    return both.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
