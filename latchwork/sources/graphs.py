"""Edges projected from the star schema of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """
definition user {}
definition region {
  relation admin: user                  // user_id = r_regionkey
  permission manage = admin
}
definition nation {
  relation region: region
  relation manager: user                // user_id = n_nationkey
  permission manage = manager + region->manage
  permission audit = region->admin
}
definition account {
  relation nation: nation
  relation owner: user                  // user_id = c_custkey
  permission manage = owner + nation->manage
  permission view = manage
}
definition order {
  relation account: account
  permission view = account->view
}
definition folder {
  relation owner: user                  // user u owns folder 3u
  relation parent: folder               // half the number, and an edge that closes a cycle
  permission view = owner + parent->view
  permission edit = owner + parent->share
  permission share = owner + parent->edit
}
"""


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject_type, subject_id, relation, resource_type, resource_id) with the tables' own numbers as ids."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def edge(df: DataFrame, subject_type: str, subject, relation: str, resource_type: str, resource) -> DataFrame:
        return df.select(
            F.lit(subject_type).alias("subject_type"), subject.cast("long").alias("subject_id"), F.lit(relation).alias("relation"),
            F.lit(resource_type).alias("resource_type"), resource.cast("long").alias("resource_id"),
        )

    users = table("events").select(F.col("user_id").alias("u")).distinct()
    own = lambda df, key: df.join(users, F.col(key) == F.col("u"), "left_semi")
    regions, nations, customers, orders, parts = (table(t) for t in ("region", "nation", "customer", "orders", "part"))
    top = parts.agg(F.max("p_partkey").alias("top"))  # one row
    key = F.col("p_partkey")
    return (
        edge(own(regions, "r_regionkey"), "user", F.col("r_regionkey"), "admin", "region", F.col("r_regionkey"))
        .union(edge(own(nations, "n_nationkey"), "user", F.col("n_nationkey"), "manager", "nation", F.col("n_nationkey")))
        .union(edge(own(customers, "c_custkey"), "user", F.col("c_custkey"), "owner", "account", F.col("c_custkey")))
        .union(edge(nations, "region", F.col("n_regionkey"), "region", "nation", F.col("n_nationkey")))
        .union(edge(customers, "nation", F.col("c_nationkey"), "nation", "account", F.col("c_custkey")))
        .union(edge(orders, "account", F.col("o_custkey"), "account", "order", F.col("o_orderkey")))
        .union(edge(users.crossJoin(F.broadcast(top)).where(3 * F.col("u") <= F.col("top")), "user", F.col("u"), "owner", "folder", 3 * F.col("u")))
        .union(edge(parts.where(key > 1), "folder", F.floor(key / 2), "parent", "folder", key))
        .union(edge(top, "folder", F.col("top"), "parent", "folder", F.lit(1)))
    )
