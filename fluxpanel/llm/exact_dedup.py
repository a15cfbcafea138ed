"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 counts how often each filter place is hit (a counting filter whose counters end at two, summed on the map side
first) and keeps the places hit twice as a bitmap. Pass 2 tests each row: a row with a place that was hit once is
unique and passes straight through; the others, every true repeat among them, are shuffled on their digest, reduced on
the map side to one row a digest and task, and joined back, so that a group of any size never meets in one task. False
positives cost a shuffled row and nothing else. The bitmap is broadcast: it has ``BITS_A_ROW`` bits a row, ``MAX_BITS`` bits
(64 MB) at most. Where all rows need more, they are written by ranges of their digest, each with a filter of its own, one range after
the other, so that unique rows pass straight through at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .shared import has_files, new_path, written

BITS_A_ROW, MAX_BITS = 16, 1 << 29
SEGMENT = 1 << 15


def normalised(text: Column) -> Column:
    """Each run of U+0020 and U+0009..U+000D is one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def repeated_places(digests: DataFrame, digest: str, bits: int, hashes: int) -> DataFrame:
    """(segment, bitmap) of the places that two rows or more hit."""
    places = digests.select(F.explode(F.array(*[_place(digest, i, bits) for i in range(hashes)])).alias("p"))
    twice = places.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy(F.shiftright("p", 15).alias("segment")).agg(F.bitmap_construct_agg(F.col("p") % SEGMENT).alias("bitmap"))


def out_schema(table: DataFrame) -> StructType:
    """Columns of ``judged`` rows."""
    fields = [f for f in table.schema.fields if f.name != "row"]
    return StructType([*fields, StructField("keep_id", table.schema["id"].dataType), StructField("group_size", LongType()), StructField("kept", BooleanType())])


def _place(digest: str, i: int, bits: int) -> Column:
    return F.xxhash64(F.lit(i), F.col(digest)).bitwiseAND(F.lit(bits - 1))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, max_bits: int = MAX_BITS, hashes: int = 2) -> DataFrame:
    """The rows of ``docs`` (columns ``carry``, the id by default) with keep_id, group_size, kept and text_sha256.

    Equal texts form a group; its row with the smallest id is kept (a null id comes last; of rows that tie, repeated rows
    among them, one is kept). A null text is an empty one, and all empty texts are equal. Texts are normalised and digested whole,
    however long; rows carry the digest from then on. An empty table gives no rows. Columns of the
    input named like an output column are left out of ``carry``.
    """
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    carry = [c for c in (carry or [id_col]) if c not in made]
    kept_cols = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    table = docs.select(*kept_cols, F.col(f"`{id_col}`").alias("id"), F.sha2(normalised(F.col(f"`{text_col}`")), 256).alias("digest"), F.monotonically_increasing_id().alias("row"))
    table = written(table, "dedup")
    n = table.count()
    bits = max(SEGMENT, 1 << (BITS_A_ROW * max(n, 1) - 1).bit_length())
    ranges = max(1, bits // max_bits)
    if ranges == 1:
        out = judged(table, bits, hashes)
    else:
        spark, path = docs.sparkSession, new_path(docs.sparkSession, "ranges")
        table.withColumn("range", F.pmod(F.xxhash64(F.lit(-1), "digest"), F.lit(ranges))).write.partitionBy("range").parquet(path)
        parts = [new_path(spark, "judged") for _ in range(ranges)]
        for r, part in enumerate(parts):
            judged(spark.read.schema(table.schema).parquet(f"{path}/range={r}") if has_files(spark, f"{path}/range={r}") else table.limit(0), max_bits, hashes).write.parquet(part)
        out = spark.read.schema(out_schema(table)).parquet(*parts)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def marked(table: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The rows with ``maybe``: whether all places of the digest are hit by two rows or more. The bitmap of ``bits`` bits is broadcast."""
    cols = table.columns
    bitmap = F.broadcast(written(repeated_places(table, "digest", bits, hashes), "bloom"))
    for i in range(hashes):
        seg = bitmap.select(F.col("segment").alias(f"s{i}"), F.col("bitmap").alias(f"b{i}"))
        table = table.withColumn(f"p{i}", _place("digest", i, bits)).join(seg, F.shiftright(f"p{i}", 15) == F.col(f"s{i}"), "left")
    hit = [F.expr(f"coalesce(shiftright(cast(conv(hex(substring(b{i}, cast(p{i} % {SEGMENT} div 8 as int) + 1, 1)), 16, 10) as int), cast(p{i} % 8 as int)) & 1, 0) = 1") for i in range(hashes)]
    maybe = hit[0]
    for h in hit[1:]:
        maybe = maybe & h
    return table.select(*cols, maybe.alias("maybe"))


def judged(table: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The rows of one range of digests with keep_id, group_size and kept."""
    cols = [c for c in table.columns if c != "row"]
    rows = marked(table, bits, hashes)
    alone = rows.filter("not maybe").select(*cols, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    again = rows.filter("maybe").drop("maybe")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    groups = again.groupBy(F.col("digest").alias("g")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    # read back from a table, so that both sides of the join are plain exchanges and a hot digest's rows can be split
    groups = written(groups, "groups")
    joined = again.join(groups, F.col("digest") == F.col("g")).select(*cols, F.col("first.id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    return alone.unionByName(joined)
