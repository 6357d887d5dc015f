"""Signals out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, stream_id and 64 samples: one row for each vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), F.col("label").cast("long").alias("stream_id"), F.col("embedding").cast("array<double>").alias("samples"))


def stereo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, left and right: blocks 2k and 2k + 1."""
    blocks = pcm_blocks(spark, sf_dir)
    pair = F.floor(F.col("block") / 2).alias("pair")
    side = lambda k: F.max(F.when(F.col("block") % 2 == k, F.col("samples")))
    return blocks.groupBy(pair).agg(side(0).alias("left"), side(1).alias("right")).where("left is not null and right is not null")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clip and 1152 samples: blocks 18k to 18k + 17, zero where one is missing."""
    blocks = pcm_blocks(spark, sf_dir).select(F.floor(F.col("block") / 18).alias("clip"), (F.col("block") % 18).cast("int").alias("place"), "samples")
    held = blocks.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("place", "samples"))).alias("held"))
    silence = F.array_repeat(F.lit(0.0), 64)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(17)), lambda k: F.coalesce(F.element_at("held", k), silence)))
    return held.select("clip", whole.alias("samples"))


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i and x: each user's events in order of time."""
    events = read(spark, sf_dir, "events").where("user_id is not null")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select("user_id", (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("value") / 500.0).alias("x"))


def frame_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, frame, payload bytes and costs: the lines of an order as frames of a stream."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stream_id"),
        (F.row_number().over(order) - 1).cast("long").alias("frame"),
        (F.col("l_quantity") * 8).cast("long").alias("payload"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )
