"""Stand-ins for the domain's inputs, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palletry.operators.cases import classified
from palletry.operators.scoring import LinearModel
from palletry.sources.io import table

FEATURES = ["sku_counts", "total_quantity", "min_quantity", "max_quantity", "max_discount", "total_volume"]
#: A fixed linear model: feature, least, greatest, weight.
MODEL = LinearModel(
    (
        ("sku_counts", 1.0, 7.0, -1.25),
        ("total_quantity", 1.0, 300.0, 0.75),
        ("min_quantity", 1.0, 50.0, 0.5),
        ("max_quantity", 1.0, 50.0, -0.375),
        ("max_discount", 0.0, 0.1, 0.625),
        ("total_volume", 0.0, 100000.0, -0.25),
    ),
    0.125,
)
#: Nodes of an instance and members of a population: bounded, so work grows in proportion to the table.
NODES, MEMBERS = 50, 40
#: Rule texts in the supported language; the third refers to a column that no table has.
RULES = {
    "many_items": "def apply_rule_patch(svm_prob, features):\n    if features.get('sku_counts', 0) > 5 and svm_prob < 0.5:\n        return 1\n    return -1\n",
    "light_order": "def apply_rule_patch(svm_prob, features):\n    q = features.get('total_quantity', 0)\n    if q < 60:\n        if svm_prob >= 0.5:\n            return 0\n    return -1\n",
    "default_fill": "def apply_rule_patch(svm_prob, features):\n    if features.get('fill_ratio', 1.0) > 0.93 and features.get('sku_counts', 0) > 6:\n        return 0\n    return -1\n",
    "undefined": "def apply_rule_patch(svm_prob, features):\n    if 1 / (features.get('max_discount', 0) - features.get('max_discount', 0)) > 1:\n        return 1\n    return -1\n",
}


def item_rows(spark: SparkSession, d: str) -> DataFrame:
    """(dispatch_id, seq, length, width, height): one box for each line item."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    p = table(spark, d, "part").select("p_partkey", "p_size")
    seq = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("dispatch_id"), seq.alias("seq"), F.col("p_size").alias("length"), F.col("l_quantity").cast("int").alias("width"), (F.col("l_linenumber") + 4).alias("height")
    )


def order_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("dispatch_id"), (F.col("o_orderstatus") == "F").cast("int").alias("if_loaded"))


def order_table(spark: SparkSession, d: str) -> DataFrame:
    """One row of features and label for each order with items."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_linenumber")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("gt"))
    f = li.groupBy(F.col("l_orderkey").alias("row_id")).agg(
        F.count("*").alias("sku_counts"),
        F.sum("l_quantity").alias("total_quantity"),
        F.min("l_quantity").alias("min_quantity"),
        F.max("l_quantity").alias("max_quantity"),
        F.max("l_discount").alias("max_discount"),
        F.sum(F.col("l_quantity") * F.col("l_quantity") * (F.col("l_linenumber") + 4)).alias("total_volume"),
    )
    return f.join(o, "row_id")


def scored(spark: SparkSession, d: str, digits: int | None = 6) -> DataFrame:
    return MODEL.scored(order_table(spark, d), digits)


def cases(spark: SparkSession, d: str) -> DataFrame:
    return classified(scored(spark, d).drop("pred"))


def rule_columns() -> dict[str, Column]:
    from palletry.operators.rules import compiled

    return {k: compiled(v, FEATURES) for k, v in RULES.items()}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """(instance, node, x, y): the first two components of all embeddings, an instance for each `NODES` ids in a row."""
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 6)
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / NODES).alias("instance"), F.col("vec_id").alias("node"), at(0).alias("x"), at(1).alias("y"))


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """(instance, seq, item): items of 1 to 100 for each user, in order of events."""
    e = table(spark, d, "events").where("value is not null")
    return e.select(F.col("user_id").alias("instance"), F.col("event_id").alias("seq"), (F.pmod(F.floor(F.abs("value") * 100).cast("long"), F.lit(100)) + 1).alias("item"))
