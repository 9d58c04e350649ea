"""Sharding by jump consistent hashing (Lamping and Veach, 2014), in DataFrame functions alone.

A row's shard depends on its key and the shard count only, no ring table is kept, and one
more shard takes rows only into itself. The 64-bit linear congruential generator of the paper
is carried in three limbs of 22, 22 and 20 bits, since products of 64-bit numbers overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS = 40
#: Parts of a shard within which slots are counted; a task holds one part of one shard, not a shard.
PARTS = 1024
#: The multiplier of the paper's generator (fixed value).
MULTIPLIER = 2862933555777941757
_M22, _M20 = (1 << 22) - 1, (1 << 20) - 1
_BLOCK = 1 << 16


def jump_shards(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shards of a BIGINT key among `shards` and among one more.

    Each jump goes to a higher number, so shards + 1 steps always end it. A null key gives nulls.
    """
    a0, a1, a2 = MULTIPLIER & _M22, (MULTIPLIER >> 22) & _M22, MULTIPLIER >> 44
    zero = F.lit(0).cast("long")
    limbs = lambda k: (k.bitwiseAND(F.lit(_M22)), F.shiftrightunsigned(k, 22).bitwiseAND(F.lit(_M22)), F.shiftrightunsigned(k, 44))
    k0, k1, k2 = limbs(key.cast("long"))
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("at"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        p0 = s["k0"] * F.lit(a0) + 1
        p1 = s["k0"] * F.lit(a1) + s["k1"] * F.lit(a0) + F.shiftright(p0, 22)
        p2 = s["k0"] * F.lit(a2) + s["k1"] * F.lit(a1) + s["k2"] * F.lit(a0) + F.shiftright(p1, 22)
        n1, n2 = p1.bitwiseAND(F.lit(_M22)), p2.bitwiseAND(F.lit(_M20))
        high = F.shiftleft(n2, 11) + F.shiftright(n1, 11)
        jump = F.floor((at + 1) * (F.lit(2147483648.0) / (high + 1)))
        return F.struct(
            F.when(at < shards, at).otherwise(s["shard"]).alias("shard"),
            F.when(at <= shards, at).otherwise(s["grown"]).alias("grown"),
            F.when(at <= shards, jump).otherwise(at).alias("at"),
            p0.bitwiseAND(F.lit(_M22)).alias("k0"), n1.alias("k1"), n2.alias("k2"),
        )

    end = F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))
    return F.when(key.isNotNull(), end)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs.

    Slots number the rows of a shard from 0 without gaps, in parts of the shard (by id and
    checksum), then by id, checksum and size. Rows that agree in all three are counted once
    before the shuffle and spread out again after it, so copies of one row are no hot group.
    Null text: size 16, checksum 0. Null id: as id 0. Repeated rows each get a slot. No rows:
    no rows. Other columns are left out, whatever their names.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce(F.col("doc_id"), F.lit(0).cast("long"))
    placed = (
        counted.withColumn("to", jump_shards(key, shards))
        .withColumn("part", F.pmod(F.pmod(key, F.lit(PARTS)) + F.col("text_crc32"), F.lit(PARTS)).cast("int"))
        .select("doc_id", "size", "text_crc32", "n", F.col("to.shard").alias("shard"), F.col("to.grown").alias("grown_shard"), "part")
    )
    placed = written(placed, "shards")
    # A row for each part of each shard: at most shards * PARTS rows, whatever the input.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("shard", "part").agg(F.sum("n").alias("of_part")).select("shard", "part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, ["shard", "part"]).withColumn("base", F.col("first") + F.col("ahead"))
    # Copies in blocks, so that no array grows with their number.
    blocks = first.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _BLOCK))))
    end = F.least(F.col("n"), (F.col("block") + 1) * _BLOCK) - 1
    return blocks.withColumn("copy", F.explode(F.sequence(F.col("block") * _BLOCK, end))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("copy")).alias("slot"), "grown_shard"
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), SHARDS)


#: CRC-32 is not among DuckDB's functions: its table is made from the polynomial, and folded over the bytes.
OP1_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))),
docs AS (SELECT coalesce(doc_id, 0) AS key, doc_id, coalesce(text, '') AS text FROM documents),
bytes AS (SELECT key, doc_id, octet_length(encode(text)) + 16 AS size, hex(encode(text)) AS h FROM docs),
checked AS (
  SELECT key, doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(size - 16), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT) AS crc
  FROM bytes, crc_table),
jump AS (
  SELECT DISTINCT key, CASE WHEN key < 0 THEN key::HUGEINT + 18446744073709551616 ELSE key::HUGEINT END AS k, 0::BIGINT AS pos, 0::BIGINT AS shard, 0::BIGINT AS grown FROM docs
  UNION ALL
  SELECT key, k2, floor((pos + 1) * (2147483648::DOUBLE / ((k2 // 8589934592)::DOUBLE + 1)))::BIGINT,
    CASE WHEN pos < {SHARDS} THEN pos ELSE shard END, CASE WHEN pos <= {SHARDS} THEN pos ELSE grown END
  FROM (SELECT *, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM jump WHERE pos <= {SHARDS})),
ends AS (SELECT key, max(shard) AS shard, max(grown) AS grown FROM jump GROUP BY key)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ((key % {PARTS} + {PARTS}) % {PARTS} + crc) % {PARTS}, doc_id NULLS FIRST, crc, size) - 1 AS slot, grown::INTEGER AS grown_shard
FROM checked JOIN ends USING (key)
"""
