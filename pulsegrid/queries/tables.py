"""Upserts, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import upsert as U
from ..streaming.upserts import high_water_mark
from .registry import query, table

_OLD = "old AS (SELECT o_orderkey AS id, o_orderstatus AS s, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate < DATE '1998-01-01')"
_NEW = "new AS (SELECT o_orderkey AS id, 'N' AS s, CAST(o_orderdate AS DATE) AS day, o_custkey AS extra FROM orders WHERE o_orderdate >= DATE '1997-01-01')"


def _sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("extra"))
    return o.where("day < DATE '1998-01-01'").drop("extra"), o.where("day >= DATE '1997-01-01'").withColumn("s", F.lit("N"))


@query("k1_replace_keys", f"WITH {_OLD}, {_NEW} SELECT id, s, day, NULL::BIGINT AS extra FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, s, day, extra FROM new")
def k1(spark, sf_dir):
    return U.replace_keys(*_sides(spark, sf_dir), ["id"])


@query("k2_upsert", f"""WITH {_OLD}, {_NEW} SELECT CAST(id AS VARCHAR) AS id, s, day FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY side DESC) AS r FROM (SELECT id, s, day, 0 AS side FROM old UNION ALL SELECT id, s, day, 1 FROM new)) WHERE r = 1""")
def k2(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return U.upsert(old, new.drop("extra"), "id", ["day"], "day")


@query("u1_union_columns", f"WITH {_OLD}, {_NEW} SELECT id, s, day, NULL::BIGINT AS extra FROM old UNION ALL SELECT id, s, day, extra FROM new")
def u1(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return old.unionByName(new, allowMissingColumns=True)


@query("u2_set_difference", f"WITH {_OLD}, {_NEW} SELECT DISTINCT day FROM old EXCEPT SELECT day FROM new")
def u2(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return U.set_difference(old.select("day"), new.select("day"))


@query("u3_set_union", f"WITH {_OLD}, {_NEW} SELECT day FROM old UNION SELECT day FROM new")
def u3(spark, sf_dir):
    old, new = _sides(spark, sf_dir)
    return U.set_union(old.select("day"), new.select("day"))


@query("u4_keep_last", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def u4(spark, sf_dir):
    return U.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("u5_distinct_rows", "SELECT DISTINCT user_id, event_type FROM events")
def u5(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").dropDuplicates()


@query("u6_same_keys", f"WITH {_OLD}, {_NEW} SELECT id, 'left' AS only_in FROM (SELECT id FROM old EXCEPT SELECT id FROM new) UNION ALL SELECT id, 'right' FROM (SELECT id FROM new EXCEPT SELECT id FROM old)")
def u6(spark, sf_dir):
    return U.same_keys(*_sides(spark, sf_dir), ["id"])


@query("s19_s21_latest_row", "SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def s21(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("c21_high_water_mark", "SELECT o_custkey, (max(CAST(o_orderdate AS DATE)) - 2)::DATE AS from_day FROM orders GROUP BY 1")
def c21(spark, sf_dir):
    return high_water_mark(table(spark, sf_dir, "orders").withColumn("day", F.to_date("o_orderdate")), ["o_custkey"], "day")
