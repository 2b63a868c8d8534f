"""Graphs and point tables made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph, symmetrised
from ..work import shuffled, stage


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both(half: DataFrame) -> DataFrame:
    return half.unionAll(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "weight"))


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Part p is vertex p, supplier s vertex n_part + s; an edge weighs the quantity sold."""
    parts, suppliers = read(spark, sf_dir, "part").count(), read(spark, sf_dir, "supplier").count()
    half = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("i"), (F.col("l_suppkey") + parts).alias("j")).agg(F.sum("l_quantity").alias("weight"))
    return Graph(_both(half), parts + suppliers)


def nation_region(spark: SparkSession, sf_dir: str) -> Graph:
    """Region r is vertex r, nation n vertex 5 + n; edges weigh 1, so every region is a component."""
    nation, regions = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region").count()
    half = nation.select(F.col("n_regionkey").cast("long").alias("i"), (F.col("n_nationkey").cast("long") + regions).alias("j"), F.lit(1.0).alias("weight"))
    return Graph(_both(half), regions + nation.count())


def user_event(spark: SparkSession, sf_dir: str) -> Graph:
    """Users in order of their id, then event types in order of their name; an edge weighs the events."""
    events = read(spark, sf_dir, "events").filter("user_id is not null and event_type is not null").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("weight"))
    from ..operators.running import running_sums

    users = running_sums(events.select("user_id").distinct(), [F.asc("user_id")], []).select("user_id", (F.col("rank") - 1).alias("i"))
    n_users = users.count()
    types = events.select("event_type").distinct().withColumn("j", F.row_number().over(Window.orderBy("event_type")).cast("long") - 1 + n_users)  # a few names
    n_types = types.count()
    half = events.join(users, "user_id").join(F.broadcast(types), "event_type").select("i", "j", "weight")
    return Graph(_both(half), n_users + n_types)


def customer_rings(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer c is vertex c; the customers of a nation, in order, are linked to those 1, 2, 4, ... places further round. So each nation is a component, and regular."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    of = Window.partitionBy("c_nationkey")  # a nation's share of the customers
    placed = stage(customers.withColumn("place", F.row_number().over(of.orderBy("c_custkey")).cast("long") - 1).withColumn("size", F.count("*").over(of)), "customers-in-order")
    steps = F.explode(F.array(*(F.lit(1 << k).cast("long") for k in range(41))))
    links = placed.select("c_custkey", "c_nationkey", "size", "place", steps.alias("step")).filter("step < size")
    ends = placed.select(F.col("c_custkey").alias("j"), "c_nationkey", F.col("place").alias("to"))
    half = links.withColumn("to", (F.col("place") + F.col("step")) % F.col("size")).join(shuffled(ends), ["c_nationkey", "to"]).select(F.col("c_custkey").alias("i"), "j", F.lit(1.0).alias("weight"))
    return Graph(symmetrised(half), customers.count())


def customer_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x) of customers: the nation, far from others, and the account balance in units of ten thousand."""
    x = F.array(100.0 * F.col("c_nationkey"), F.col("c_acctbal") / 10_000)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), x.alias("x"))


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def label_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quality and toxicity of labelled documents as two labellings (id, label)."""
    labels = read(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label")), labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("long").alias("label"))
