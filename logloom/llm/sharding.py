"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters rows over memory-sized buckets by a seeded hash. Pass two shuffles each
bucket with Spark's ``shuffle`` (a Fisher-Yates permutation) and writes it. A row's place
in the whole order is its place in its bucket plus the sizes of the buckets before;
dealing places out in turn makes shards whose counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staging, prefix_sums, settings

#: Bytes of whole rows that a bucket holds on average; one bucket at a time is shuffled in a task's memory.
BUCKET_BYTES = 16 << 20
#: Buckets up to which their offsets are broadcast (16 bytes each).
BROADCAST_BUCKETS = 100_000


def text_size(text: str = "text"):
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def row_size(df: DataFrame) -> Column:
    """About the bytes of a whole row: texts and arrays by their lengths, other nested values by their JSON."""
    out = F.lit(64).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            n = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType):
            n = 8 * F.greatest(F.size(c), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            n = F.octet_length(F.to_json(F.struct(c.alias("x"))))
        else:
            n = F.lit(8)
        out = out + F.coalesce(n.cast("long"), F.lit(0))
    return out


def shuffled(df: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows in a random order: ``row`` (the input row as a struct), ``bucket``, ``place`` (gapless from 0).

    The hash takes in every row's place in its input partition, so no key, text or run of
    equal rows can fill a bucket: nulls, empty texts and repeated rows scatter like others
    and each stays a row of its own. Input columns live inside ``row``, so none can clash.
    An empty table gives no rows. Rows come sorted by bucket, so a task holds one bucket at
    a time, however many it is dealt.
    """
    total = df.select(F.sum(row_size(df))).first()[0]
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row") if df.columns else F.struct(F.lit(None).alias("_"))
    scattered = df.select(F.monotonically_increasing_id().alias("_at"), row)
    scattered = scattered.withColumn("_h", F.xxhash64(F.lit(seed), "_at")).withColumn("bucket", F.pmod("_h", F.lit(buckets)))
    mixed = (
        scattered.repartition("bucket")
        .sortWithinPartitions("bucket", "_h")  # so that the permutation starts from a known order
        .groupBy("bucket")
        .agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.posexplode(F.shuffle("rows", seed)).alias("_pos", "row"))
    )
    # aggregation by sorting ends each bucket before the next begins; the one by hashing would hold many
    with settings(df.sparkSession, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        staged = Staging(df.sparkSession, "shuffle").write(mixed, "buckets", codec="zstd")
    offsets = prefix_sums(staged.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")), "bucket", "_n", "_before").select("bucket", "_before")
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    return staged.join(offsets, "bucket").select("row", "bucket", (F.col("_before") + F.col("_pos")).alias("place"))


def shard(df: DataFrame, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``row``, ``shard`` and ``slot`` (its place there, gapless from 0); shards' counts are at most one apart."""
    out = shuffled(df, seed, bucket_bytes)
    return out.select("row", F.pmod("place", F.lit(shards)).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the shards as Parquet under ``path``/shard=k, rows with their slot beside their columns in ``row``."""
    shard(df, shards, **options).write.partitionBy("shard").parquet(path)


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 16)
    text = F.col("row.text")
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
