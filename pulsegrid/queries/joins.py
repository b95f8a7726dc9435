"""Joins in time and against calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import upsert as U
from .registry import DAILY, SAMPLES, core, query, rounded, samples_of, table


@query("j6_missing_days", f"""WITH {DAILY}, g AS (SELECT e.entity, unnest(generate_series(DATE '1995-01-01', DATE '1995-12-31', INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT entity FROM core WHERE clean) e)
SELECT entity, day FROM g WHERE NOT EXISTS (SELECT 1 FROM core c WHERE c.clean AND c.entity = g.entity AND c.day = g.day)""")
def j6(spark, sf_dir):
    return J.missing_days(core(spark, sf_dir).where("clean"), ["entity"], "day", "1995-01-01", "1995-12-31")


@query("j7_covered_days", f"WITH {DAILY} SELECT entity, day, n_orders FROM core c WHERE EXISTS (SELECT 1 FROM core b WHERE b.clean AND b.entity = '1-URGENT' AND b.day = c.day)")
def j7(spark, sf_dir):
    c = core(spark, sf_dir)
    return J.covered_days(c.select("entity", "day", "n_orders"), c.where("clean AND entity = '1-URGENT'"), ["day"])


@query("j8_same_or_previous", f"""WITH {DAILY}, r AS (SELECT entity, day, n_orders AS a, round(rmssd, 4) AS b FROM core WHERE clean)
SELECT c.entity, c.day, coalesce(s.a, p.a) AS a, coalesce(s.b, p.b) AS b FROM core c LEFT JOIN r s ON s.entity = c.entity AND s.day = c.day LEFT JOIN r p ON p.entity = c.entity AND p.day = c.day - 1""")
def j8(spark, sf_dir):
    c = core(spark, sf_dir)
    r = c.where("clean").select("entity", "day", F.col("n_orders").alias("a"), F.round("rmssd", 4).alias("b"))
    return J.same_or_previous(c.select("entity", "day"), r, ["entity"], "day", [["a"], ["b"]])


_MATCH = """a AS (SELECT user_id, ts::DATE AS day, event_id, epoch_us(ts) / 6e7 AS t, value AS z FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, ts::DATE AS day, event_id AS other_id, epoch_us(ts) / 6e7 AS u, value AS y FROM events WHERE event_type = 'click')"""


@query("j9_nearest_match", f"""WITH {_MATCH}, n AS (SELECT a.user_id, a.day, event_id, other_id, abs(t - u) AS delta, abs(z - y) AS size_gap, row_number() OVER (PARTITION BY event_id ORDER BY abs(t - u), abs(z - y), other_id) AS r
  FROM a JOIN b ON a.user_id = b.user_id AND a.day = b.day AND abs(t - u) <= 240) SELECT user_id, day, event_id, other_id, round(delta, 4) AS delta, round(size_gap, 4) AS size_gap FROM n WHERE r = 1""")
def j9(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("user_id", F.to_date("ts").alias("day"), F.col("event_id").alias(name), (F.unix_micros("ts") / 6e7).alias("t"), "value")
    n = J.nearest(side("purchase", "event_id"), side("click", "other_id"), ["user_id", "day"], "event_id", "t", "other_id", "t", 240.0, "value", "value")
    return rounded(n, digits=4)


@query("j10_positional_zip", """WITH l AS (SELECT o_custkey, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT o_custkey, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, position, a, b FROM l JOIN r USING (o_custkey, position)""")
def j10(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda s, n: o.where(F.col("o_orderstatus") == s).select("o_custkey", F.col("o_orderkey").alias(n))
    return J.zip_positions(side("O", "a"), side("F", "b"), ["o_custkey"], ["a"], ["b"], ["a"], ["b"]).withColumn("position", F.col("position").cast("long"))


@query("j11_interval_join", f"""WITH {SAMPLES}, w AS (SELECT DISTINCT entity, sec AS s, sec + z % 7 AS e FROM samples WHERE z % 5 = 0)
SELECT entity, sec, EXISTS (SELECT 1 FROM w WHERE w.entity = p.entity AND p.sec + 0.5 BETWEEN w.s AND w.e) AS inside FROM samples p""")
def j11(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    w = s.where("z % 5 = 0").select("entity", F.col("sec").cast("double").alias("s"), (F.col("sec") + F.col("z") % 7).cast("double").alias("e"))
    return J.in_any_interval(s.withColumn("c", F.col("sec") + F.lit(0.5)), w, ["entity"], "sec", "c", "s", "e", 5.0).select("entity", "sec", "inside")


@query("j12_asof_interpolation", f"""WITH {SAMPLES}, k AS (SELECT entity, sec, hr FROM samples WHERE z = 0), p AS (SELECT entity, sec + 0.25 AS pt FROM samples WHERE z = 5),
lo AS (SELECT p.entity, p.pt, k.sec AS s0, k.hr AS h0 FROM p ASOF LEFT JOIN k ON k.entity = p.entity AND k.sec <= p.pt), hi AS (SELECT p.entity, p.pt, k.sec AS s1, k.hr AS h1 FROM p ASOF LEFT JOIN k ON k.entity = p.entity AND k.sec >= p.pt)
SELECT lo.entity, lo.pt AS at_s, round(CASE WHEN s0 = s1 THEN h0 ELSE h0 + (h1 - h0) * (lo.pt - s0) / (s1 - s0) END, 6) AS hr FROM lo JOIN hi ON lo.entity = hi.entity AND lo.pt = hi.pt""")
def j12(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    p = s.where("z = 5").select("entity", (F.col("sec") + F.lit(0.25)).alias("at"))
    return rounded(J.interpolate(p, s.where("z = 0").select("entity", "sec", "hr"), ["entity"], "at", "sec", "hr").withColumnRenamed("at", "at_s"))


@query("j14_o6_grid_search", f"""WITH {SAMPLES}, b AS (SELECT entity, sec AS start, sec + 40 AS stop, hr AS target FROM samples WHERE sec % 60 = 20),
g AS (SELECT b.*, o FROM b, generate_series(-20, 20) t(o)), m AS (SELECT g.entity, o, g.start, g.target, avg(s.hr) AS m FROM g JOIN samples s ON s.entity = g.entity AND s.sec >= g.start + o AND s.sec < g.stop + o GROUP BY ALL),
c AS (SELECT entity, o, avg(abs(m - target)) AS score FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY round(score, 9), o) AS i FROM c)
SELECT entity, o::INTEGER AS best_offset, round(score, 6) AS score FROM r WHERE i = 1""")
def j14(spark, sf_dir):
    s = samples_of(spark, sf_dir)
    b = s.where("sec % 60 = 20").select("entity", F.col("sec").alias("start"), (F.col("sec") + 40).alias("stop"), F.col("hr").alias("target"))
    return rounded(J.grid_search(s, b, ["entity"], (-20, 20, 1), value="hr"))


@query("s13_first_source", f"""WITH {SAMPLES}, c AS (SELECT entity, sec, z % 3 AS prio, CASE WHEN NOT (z % 3 = 0 AND entity % 2 = 0) THEN hr END AS v FROM samples)
SELECT entity, sec, prio, round(v, 6) AS v FROM (SELECT *, min(CASE WHEN v IS NOT NULL THEN prio END) OVER (PARTITION BY entity) AS best FROM c) WHERE prio = best""")
def s13(spark, sf_dir):
    c = samples_of(spark, sf_dir).select("entity", "sec", (F.col("z") % 3).alias("prio"), F.when(~((F.col("z") % 3 == 0) & (F.col("entity") % 2 == 0)), F.col("hr")).alias("v"))
    return rounded(J.first_source(c, ["entity"], "prio", "v"))


@query("j3_j4_lookup_last", """WITH r AS (SELECT o_custkey, o_orderstatus, o_totalprice::DOUBLE AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders)
SELECT c_custkey, o_orderstatus, p FROM customer LEFT JOIN r ON o_custkey = c_custkey AND i = 1""")
def j3(spark, sf_dir):
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("p"))
    return J.lookup_last(table(spark, sf_dir, "customer").select("c_custkey"), right, ["c_custkey"], ["o_orderkey"])


@query("j1_j2_replace_columns", f"""WITH {DAILY}, b AS (SELECT entity, day, round(x * 2, 4) AS rmssd FROM daily WHERE k % 3 = 0) SELECT c.entity, c.day, b.rmssd, c.n_orders FROM core c LEFT JOIN b USING (entity, day)""")
def j1(spark, sf_dir):
    from .registry import daily

    b = daily(spark, sf_dir).where("k % 3 = 0").select("entity", "day", F.round(F.col("x") * 2, 4).alias("rmssd"))
    return J.replace_columns(core(spark, sf_dir), b, ["entity", "day"], ["rmssd"]).select("entity", "day", "rmssd", "n_orders")


@query("j5_compare_versions", """WITH a AS (SELECT o_orderkey, o_orderstatus AS s, CAST(o_custkey AS VARCHAR) AS c FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CAST(CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS VARCHAR) AS c FROM orders)
SELECT o_orderkey, 'o_orderstatus' AS "column", a.s AS before, b.s AS after FROM a JOIN b USING (o_orderkey) WHERE a.s IS DISTINCT FROM b.s
UNION ALL SELECT o_orderkey, 'o_custkey', a.c, b.c FROM a JOIN b USING (o_orderkey) WHERE a.c IS DISTINCT FROM b.c""")
def j5(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    b = a.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))).withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))
    return U.compare_versions(a, b, ["o_orderkey"], ["o_orderstatus", "o_custkey"])
