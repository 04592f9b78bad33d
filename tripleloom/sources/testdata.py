"""Typed triplets derived from the relational test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUALIFIERS

#: Type forest of the test tables: child to parent; all other types are lone roots.
FOREST = {
    **dict.fromkeys(["standard", "small", "large", "medium"], "product"),
    **dict.fromkeys(["machinery", "automobile", "building", "supplier"], "industrial"),
    **dict.fromkeys(["furniture", "household"], "consumer"),
    **dict.fromkeys(["nation", "region"], "place"),
    **dict.fromkeys(["1-urgent", "2-high", "3-medium", "4-not specified", "5-low"], "order"),
    "industrial": "business",
    "consumer": "business",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, sample_id and the fields of a triplet.

    ``ord`` orders the triplets of a kind; with ``kind`` it is unique.
    """
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")}
    none = F.lit(None).cast(QUALIFIERS)

    def rows(df: DataFrame, kind: int, order, sample, s, st, r, o, ot, q=none) -> DataFrame:
        text = [c.cast("string") if not isinstance(c, str) else F.lit(c) for c in (s, st, r, o, ot)]
        return df.select(
            F.lit(kind).alias("kind"), order.cast("long").alias("ord"), sample.cast("long").alias("sample_id"), text[0].alias("subject"), text[1].alias("subject_type"),
            text[2].alias("relation"), text[3].alias("object"), text[4].alias("object_type"), q.cast(QUALIFIERS).alias("qualifiers"),
        )

    def one(relation: str, value, kind: str):
        return F.array(F.struct(F.lit(relation).alias("relation"), value.cast("string").alias("object"), F.lit(kind).alias("object_type")))

    c = F.col
    nation, part, supplier = t["nation"], t["part"], t["supplier"]
    customer = t["customer"].join(nation, c("c_nationkey") == c("n_nationkey"))
    orders = t["orders"].join(t["customer"], c("o_custkey") == c("c_custkey"))
    lines = t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(part, c("l_partkey") == c("p_partkey"))
    line = c("l_orderkey") * 10 + c("l_linenumber")
    supplies = lines.join(supplier, c("l_suppkey") == c("s_suppkey"))
    status = one("status", c("o_orderstatus"), "code")
    all_rows = [
        rows(customer, 1, c("c_custkey"), c("c_nationkey"), c("c_name"), c("c_mktsegment"), "located in", c("n_name"), "nation"),
        rows(supplier.join(nation, c("s_nationkey") == c("n_nationkey")), 2, c("s_suppkey"), c("s_nationkey"), c("s_name"), "supplier", "based in", c("n_name"), "nation"),
        rows(nation.join(t["region"], c("n_regionkey") == c("r_regionkey")), 3, c("n_nationkey"), c("n_nationkey"), c("n_name"), "nation", "part of", c("r_name"), "region"),
        rows(orders, 4, c("o_orderkey"), c("c_nationkey"), c("o_orderkey"), c("o_orderpriority"), "placed by", c("c_name"), c("c_mktsegment"), status),
        rows(orders, 5, c("o_orderkey"), c("c_nationkey"), c("c_name"), c("c_mktsegment"), "placed", c("o_orderkey"), c("o_orderpriority")),
        rows(lines, 6, line, c("l_orderkey") % 25, c("l_orderkey"), "order", "contains", c("p_name"), c("p_type"), one("ship year", F.year("l_shipdate"), "year")),
        rows(supplies, 7, line, c("s_nationkey"), c("s_name"), "supplier", "supplies", c("p_name"), c("p_type")),
        rows(t["events"], 8, c("event_id"), c("user_id") % 25, c("user_id"), "user", c("event_type"), F.get_json_object("props", "$.k"), "key"),
        rows(nation.filter("n_nationkey < 2"), 9, c("n_nationkey"), c("n_nationkey"), c("n_name"), "nation", "borders", c("n_name"), "nation"),
    ]
    out = all_rows[0]
    for more in all_rows[1:]:
        out = out.unionByName(more)
    return out


_NO_Q = "CAST(NULL AS STRUCT(relation VARCHAR, object VARCHAR, object_type VARCHAR)[])"
TRIPLETS_SQL = f"""
trip AS (
  SELECT 1 AS kind, CAST(c_custkey AS BIGINT) AS ord, CAST(c_nationkey AS BIGINT) AS sample_id, c_name AS subject, c_mktsegment AS subject_type, 'located in' AS relation, n_name AS object, 'nation' AS object_type, {_NO_Q} AS qualifiers
    FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 2, s_suppkey, s_nationkey, s_name, 'supplier', 'based in', n_name, 'nation', NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 3, n_nationkey, n_nationkey, n_name, 'nation', 'part of', r_name, 'region', NULL FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 4, o_orderkey, c_nationkey, CAST(o_orderkey AS VARCHAR), o_orderpriority, 'placed by', c_name, c_mktsegment, [{{'relation': 'status', 'object': o_orderstatus, 'object_type': 'code'}}] FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 5, o_orderkey, c_nationkey, c_name, c_mktsegment, 'placed', CAST(o_orderkey AS VARCHAR), o_orderpriority, NULL FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT 6, l_orderkey * 10 + l_linenumber, l_orderkey % 25, CAST(l_orderkey AS VARCHAR), 'order', 'contains', p_name, p_type, [{{'relation': 'ship year', 'object': CAST(year(l_shipdate) AS VARCHAR), 'object_type': 'year'}}] FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 7, l_orderkey * 10 + l_linenumber, s_nationkey, s_name, 'supplier', 'supplies', p_name, p_type, NULL FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT 8, event_id, user_id % 25, CAST(user_id AS VARCHAR), 'user', event_type, props ->> '$.k', 'key', NULL FROM events
  UNION ALL SELECT 9, n_nationkey, n_nationkey, n_name, 'nation', 'borders', n_name, 'nation', NULL FROM nation WHERE n_nationkey < 2
)"""


def forest_edges(spark: SparkSession) -> DataFrame:
    """The test forest over type labels (child, parent)."""
    values = ", ".join(f"('{c}', '{p}')" for c, p in FOREST.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(child, parent)")


FOREST_SQL = "forest AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}')" for c, p in FOREST.items()) + ") AS t(child, parent))"
