"""Sharding: a tree of weighted hash draws over region, rack and shard (law ``key``).

At each level a row goes to the child with the smallest ``-ln(u) / weight``, where u is a hash of doc_id
and the child's name in (0, 1]. A child's weight is the number of shards below it, so shards are even.
Adding a shard adds a region of its own: no other weight changes, so rows move into the new shard only
and every other subtree stays as it is.

Defined cases: null text counts as no bytes; repeated rows go to the same shard and have slots of their
own; a null doc_id hashes like any other value; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table


def tree(n_shards: int = 16, racks: int = 2, per_rack: int = 2, extra: int = 0) -> dict:
    """{region: {rack: [shards]}}: ``n_shards`` shards in full racks, then ``extra`` shards, each a region of its own."""
    out: dict = {}
    for s in range(n_shards):
        region, rack = s // (racks * per_rack), s // per_rack % racks
        out.setdefault(f"r{region}", {}).setdefault(f"r{region}k{rack}", []).append(s)
    for s in range(n_shards, n_shards + extra):
        out[f"x{s}"] = {f"x{s}k0": [s]}
    return out


def _draw(key: Column, children: list[tuple[str, int, Column]]) -> Column:
    """The value of the child that wins the weighted draw; children: (name, weight, value)."""
    if len(children) == 1:
        return children[0][2]
    costs = []
    for name, weight, value in children:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 1.0) / float(2**53)
        costs.append(F.struct((-F.log(u) / float(weight)).alias("cost"), value.alias("value")))
    return F.least(*costs)["value"]


def shard_of(key: Column, shape: dict) -> Column:
    """The shard (int) of ``key`` in ``shape``."""
    regions = []
    for region, racks in shape.items():
        inner = [(rack, len(shards), _draw(key, [(f"{rack}s{s}", 1, F.lit(s)) for s in shards])) for rack, shards in racks.items()]
        regions.append((region, sum(map(len, racks.values())), _draw(key, inner)))
    return _draw(key, regions)


def with_slots(rows: DataFrame, shard: str = "shard", order: str = "doc_id", bucket_rows: int = 2_000) -> DataFrame:
    """``rows`` with ``slot``: numbers from 0 without gaps in each shard.

    A shard is numbered in hash buckets of about ``bucket_rows`` rows: counts by bucket give each bucket's
    first number, so no task sorts a whole shard.
    """
    shape = rows.agg(F.count("*").alias("n")).first()
    n_buckets = max(1, -(-shape["n"] // (16 * bucket_rows)))
    b = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit("slot"), F.col(order)), F.lit(n_buckets)))
    counts = b.groupBy(shard, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    ranked = b.withColumn("_rank", F.row_number().over(Window.partitionBy(shard, "_bucket").orderBy(order)))
    return ranked.join(first, [shard, "_bucket"]).withColumn("slot", (F.col("_first") + F.col("_rank") - 1).cast("long")).drop("_bucket", "_first", "_rank")


def assign(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    raw = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), tree(n_shards)).cast("int").alias("shard"),
        shard_of(F.col("doc_id"), tree(n_shards, extra=1)).cast("int").alias("grown_shard"),
    )
    return with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
