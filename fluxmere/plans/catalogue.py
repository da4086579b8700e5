"""One query per operator over the provided tables, with the SQL that must agree with it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import text
from ..operators import epochs as l1
from ..operators import graph, iterate
from ..operators.zset import Collection
from ..sources import io
from ..streaming import streams
from . import algorithms, deltas

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- tables --------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a frame: an epoch is a day."""
    return l1.with_epoch(table(spark, d, "events"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")))


def of_type(spark: SparkSession, d: str, kind: str, *cols: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type") == kind).select(*(cols or ("user_id",)), "epoch")


EV = "ev AS (SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch FROM events)"


def typed(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id, epoch FROM ev WHERE event_type = '{kind}')"


def changes(spark: SparkSession, d: str) -> Collection:
    """Users' events as a weighted collection: errors take one away."""
    weight = F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long")
    return Collection(events(spark, d).select("user_id", "event_type", weight.alias("weight"), "epoch"))


def side(spark: SparkSession, d: str, plus: str, minus: str) -> Collection:
    """user_id with weight +1 for events of one kind and -1 for those of another."""
    e = events(spark, d).filter(F.col("event_type").isin(plus, minus))
    return Collection(e.select("user_id", F.when(F.col("event_type") == plus, 1).otherwise(-1).cast("long").alias("weight"), "epoch"))


CH = EV + ", ch AS (SELECT user_id, event_type, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS weight, epoch FROM ev)"


def side_sql(name: str, plus: str, minus: str) -> str:
    return f"{name} AS (SELECT user_id, CASE WHEN event_type = '{plus}' THEN 1 ELSE -1 END AS weight, epoch FROM ev WHERE event_type IN ('{plus}', '{minus}'))"


A_SQL, B_SQL = side_sql("a", "click", "error"), side_sql("b", "view", "signup")


def side_a(spark, d):
    return side(spark, d, "click", "error")


def side_b(spark, d):
    return side(spark, d, "view", "signup")


def steps_sql(source: str, keys: str, sums: str, f: str) -> str:
    """f of running sums, as changes: what the weight functions must give."""
    inner = ", ".join(f"SUM({s}) AS {s}" for s in sums.split())
    outer = ", ".join(f"SUM({s}) OVER (PARTITION BY {keys} ORDER BY epoch) AS {s}" for s in sums.split())
    return (
        f", per AS (SELECT {keys}, epoch, {inner} FROM {source} GROUP BY {keys}, epoch), run AS (SELECT {keys}, epoch, {outer} FROM per), "
        f"now AS (SELECT {keys}, epoch, {f} AS v FROM run), step AS (SELECT {keys}, epoch, CAST(v - COALESCE(LAG(v) OVER (PARTITION BY {keys} ORDER BY epoch), 0) AS BIGINT) AS weight FROM now) "
        f"SELECT * FROM step WHERE weight <> 0"
    )


BOTH = ", ab AS (SELECT user_id, epoch, weight AS wa, 0 AS wb FROM a UNION ALL SELECT user_id, epoch, 0, weight FROM b)"


# --- epoch operators -----------------------------------------------------------------------------


@query(f"WITH {EV} SELECT event_id, upper(event_type) AS kind, ROUND(value * 2, 4) AS twice, epoch FROM ev")
def l1_select(spark, d):
    return l1.select(events(spark, d), "event_id", F.upper("event_type").alias("kind"), F.round(F.col("value") * 2, 4).alias("twice"))


@query(f"WITH {EV} SELECT event_id, value, epoch FROM ev WHERE value > 50")
def l1_where(spark, d):
    return l1.where(events(spark, d), F.col("value") > 50).select("event_id", "value", "epoch")


@query(r"SELECT conv_id, turn, word, CAST(0 AS INTEGER) AS epoch FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word FROM conversations)")
def l1_select_many(spark, d):
    return l1.select_many(l1.with_epoch(table(spark, d, "conversations")), F.split("text", " "), "word", "conv_id", "turn")


@query("SELECT user_id, COUNT(*) AS n, CAST(1 AS BIGINT) AS places FROM events GROUP BY user_id")
def l1_select_by_vertex(spark, d):
    """Once events are placed by user, all of a user's rows see one and the same place."""
    placed = l1.select_by_vertex(l1.partition_by(events(spark, d), "user_id"), lambda v: v, "place")
    return placed.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"))


@query(f"WITH {EV}, {typed('a', 'click')}, {typed('b', 'view')} SELECT * FROM a UNION ALL SELECT * FROM b")
def l1_concat(spark, d):
    return l1.concat(of_type(spark, d, "click"), of_type(spark, d, "view"))


@query(f"WITH {EV}, {typed('a', 'click')} SELECT DISTINCT * FROM a")
def l1_distinct(spark, d):
    return l1.distinct(of_type(spark, d, "click"))


@query(f"WITH {EV}, {typed('a', 'click')}, {typed('b', 'view')} SELECT * FROM a UNION SELECT * FROM b")
def l1_union(spark, d):
    return l1.union(of_type(spark, d, "click"), of_type(spark, d, "view"))


@query(f"WITH {EV}, {typed('a', 'click')}, {typed('b', 'view')} SELECT * FROM a INTERSECT SELECT * FROM b")
def l1_intersect(spark, d):
    return l1.intersect(of_type(spark, d, "click"), of_type(spark, d, "view"))


@query(f"WITH {EV}, {typed('a', 'click')}, {typed('b', 'view')} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.epoch = a.epoch)")
def l1_except(spark, d):
    return l1.except_(of_type(spark, d, "click"), of_type(spark, d, "view"))


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS error_id, b.event_id AS purchase_id, a.epoch FROM ev a JOIN ev b ON a.epoch = b.epoch AND a.user_id = b.user_id WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def l1_join(spark, d):
    a = of_type(spark, d, "error", "user_id", "event_id").withColumnRenamed("event_id", "error_id")
    b = of_type(spark, d, "purchase", "user_id", "event_id").withColumnRenamed("event_id", "purchase_id")
    return l1.join(a, b, ["user_id"], "user_id", "error_id", "purchase_id")


@query(f"WITH {EV}, {typed('a', 'click')}, {typed('b', 'purchase')} SELECT a.* FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.user_id = a.user_id AND b.epoch = a.epoch)")
def l1_semi_join(spark, d):
    return l1.semi_join(of_type(spark, d, "click"), of_type(spark, d, "purchase"), ["user_id"])


def _first_last(pdf: pd.DataFrame) -> pd.DataFrame:
    s = pdf.sort_values("event_id")
    return pd.DataFrame({"epoch": s.epoch.iloc[:1].to_numpy(), "event_type": s.event_type.iloc[0], "first_id": s.event_id.iloc[0], "last_id": s.event_id.iloc[-1]})


@query(f"WITH {EV} SELECT epoch, event_type, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM ev GROUP BY epoch, event_type")
def l1_group_by(spark, d):
    e = events(spark, d).select("epoch", "event_type", "event_id")
    return l1.group_by(e, ["event_type"], _first_last, "epoch int, event_type string, first_id long, last_id long")


@query(f"WITH {EV} SELECT epoch, event_type, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS users FROM ev GROUP BY epoch, event_type")
def l1_group_lists(spark, d):
    g = l1.group_lists(events(spark, d), ["event_type"], F.col("user_id"))
    return g.select("epoch", "event_type", F.array_join(F.array_distinct("values").cast("array<string>"), ",").alias("users"))


def _sides(kind: str) -> str:
    return f"(SELECT epoch, user_id, COUNT(*) AS n FROM ev WHERE event_type = '{kind}' GROUP BY 1, 2)"


@query(f"WITH {EV} SELECT epoch, user_id, l.n AS \"left\", r.n AS \"right\" FROM {_sides('click')} l FULL JOIN {_sides('error')} r USING (epoch, user_id)")
def l1_co_group(spark, d):
    return l1.co_group(of_type(spark, d, "click"), of_type(spark, d, "error"), ["user_id"], F.count("*"), F.count("*"))


def _net(a: pd.DataFrame, b: pd.DataFrame) -> list[tuple]:
    some = a if len(a) else b
    return [(some["epoch"].iat[0], some["user_id"].iat[0], len(a) - len(b))]


@query(f"WITH {EV} SELECT epoch, user_id, COALESCE(l.n, 0) - COALESCE(r.n, 0) AS net FROM {_sides('click')} l FULL JOIN {_sides('error')} r USING (epoch, user_id)")
def l1_co_group_by(spark, d):
    return l1.co_group_by(of_type(spark, d, "click"), of_type(spark, d, "error"), ["user_id"], _net, "epoch int, user_id long, net long")


@query(f"WITH {EV} SELECT epoch, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM ev GROUP BY epoch, event_type")
def l1_aggregate(spark, d):
    return l1.aggregate(events(spark, d), ["event_type"], F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {EV} SELECT epoch, user_id, bit_xor(event_id) AS parity FROM ev GROUP BY epoch, user_id")
def l1_fold(spark, d):
    return l1.fold(events(spark, d), ["user_id"], F.col("event_id"), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x), name="parity")


@query(f"WITH {EV} SELECT user_id, epoch, COUNT(*) AS count FROM ev GROUP BY user_id, epoch")
def l1_count(spark, d):
    return l1.count(events(spark, d).select("user_id", "epoch"))


@query(f"WITH {EV} SELECT epoch, user_id, MIN(value) AS value FROM ev GROUP BY epoch, user_id")
def l1_min(spark, d):
    return l1.minimum(events(spark, d), ["user_id"], F.col("value"))


@query(f"WITH {EV} SELECT epoch, user_id, MAX(value) AS value FROM ev GROUP BY epoch, user_id")
def l1_max(spark, d):
    return l1.maximum(events(spark, d), ["user_id"], F.col("value"))


def _tally(batches):
    total: dict = {}
    for b in batches:
        for k, n in b.groupby("user_id").size().items():
            total[k] = total.get(k, 0) + n
    yield pd.DataFrame({"user_id": list(total), "n": list(total.values())}, dtype="int64")


@query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id")
def l0_unary_expression(spark, d):
    return l1.unary_expression(events(spark, d).select("user_id"), _tally, "user_id long, n long", "user_id")


def _bucket_net(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    net = a.groupby("user_id").size().sub(b.groupby("user_id").size(), fill_value=0)
    return pd.DataFrame({"user_id": net.index.astype("int64"), "net": net.to_numpy().astype("int64")})


@query("SELECT user_id, CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) AS BIGINT) AS net FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def l0_binary_expression(spark, d):
    a, b = (of_type(spark, d, k).select("user_id") for k in ("click", "error"))
    return l1.binary_expression(a, b, ["user_id"], _bucket_net, "user_id long, net long", buckets=8)


@query("SELECT CAST(0 AS BIGINT) AS misplaced")
def l0_partition_by(spark, d):
    return l1.misplaced(l1.partition_by(events(spark, d), "user_id"), "user_id").agg(F.count("*").alias("misplaced"))


@query(f"WITH {EV}, n AS (SELECT epoch, user_id, COUNT(*) AS n FROM ev GROUP BY 1, 2) SELECT epoch, user_id, CAST(SUM(n) OVER (PARTITION BY user_id ORDER BY epoch) AS BIGINT) AS count FROM n")
def l0_running_count(spark, d):
    return l1.running_count(events(spark, d), ["user_id"])


@query(f"WITH {EV}, m AS (SELECT epoch, user_id, MAX(value) AS v FROM ev GROUP BY 1, 2), r AS (SELECT epoch, user_id, MAX(v) OVER (PARTITION BY user_id ORDER BY epoch) AS value FROM m), p AS (SELECT *, LAG(value) OVER (PARTITION BY user_id ORDER BY epoch) AS b FROM r) SELECT epoch, user_id, value FROM p WHERE b IS NULL OR value <> b")
def l0_running_extreme(spark, d):
    return l1.running_extreme(events(spark, d), ["user_id"], F.col("value"))


@query(f"""WITH {EV}, puts AS (SELECT epoch, user_id, arg_max(event_id, event_id) AS event_id FROM ev WHERE event_type = 'signup' GROUP BY 1, 2),
gets AS (SELECT epoch, user_id FROM ev WHERE event_type = 'view')
SELECT g.epoch, g.user_id, p.event_id FROM gets g ASOF JOIN puts p ON g.user_id = p.user_id AND g.epoch >= p.epoch""")
def l0_lookup(spark, d):
    puts = of_type(spark, d, "signup", "user_id", "event_id")
    return l1.lookup(puts, of_type(spark, d, "view"), "user_id", "event_id", F.col("event_id")).select("epoch", "user_id", "event_id")


@query(f"WITH {EV} SELECT epoch, user_id, COUNT(*) AS n FROM ev GROUP BY epoch, user_id")
def l0_local_reduce(spark, d):
    """Folded within partitions first, then across."""
    local = l1.local_reduce(events(spark, d).repartition(4), ["user_id"], F.count("*").alias("n"))
    return l1.aggregate(local, ["user_id"], F.sum("n").alias("n"))


@query(f"WITH {EV} SELECT epoch, event_id, COUNT(*) OVER (PARTITION BY epoch) AS n, MAX(value) OVER (PARTITION BY epoch) AS top FROM ev")
def l0_broadcast_reduce(spark, d):
    return l1.broadcast_reduce(events(spark, d).select("event_id", "value", "epoch"), F.count("*").alias("n"), F.max("value").alias("top")).drop("value")


@query(f"WITH {EV} SELECT event_type AS name, epoch, COUNT(value) AS n, ROUND(SUM(value), 4) AS total, MIN(value) AS least, MAX(value) AS greatest, ROUND(AVG(value), 6) AS mean FROM ev GROUP BY event_type, epoch")
def l0_report(spark, d):
    return l1.report(events(spark, d), "event_type", F.col("value")).withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6))


@query("SELECT conv_id, turn, word, CAST(0 AS INTEGER) AS epoch FROM (SELECT conv_id, turn, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM conversations)")
def l1_select_many_segments(spark, d):
    """Lines are segments of words."""
    segments = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return l1.select_many_segments(l1.with_epoch(table(spark, d, "conversations")), segments, "word", "conv_id", "turn")


@query("SELECT r_regionkey, n_nationkey, CAST(0 AS INTEGER) AS epoch FROM region, nation")
def l1_cross(spark, d):
    a, b = (l1.with_epoch(table(spark, d, t)).select(k, "epoch") for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey")))
    return l1.cross(a, b)


@query(f"WITH {EV} SELECT user_id, event_type, n_name, epoch FROM ev JOIN nation ON n_nationkey = user_id")
def l1_table_join(spark, d):
    """A table that holds for every epoch."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name")
    return l1.node_table_join(events(spark, d), nations, ["user_id"]).select("user_id", "event_type", "n_name", "epoch")


# --- collections ---------------------------------------------------------------------------------


@query(f"WITH {CH} SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM ch GROUP BY user_id, event_type, epoch HAVING SUM(weight) <> 0")
def z_consolidate(spark, d):
    return changes(spark, d).consolidate().df


@query(f"WITH {CH} SELECT user_id, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM ch GROUP BY user_id, epoch HAVING SUM(weight) <> 0")
def z_select(spark, d):
    return changes(spark, d).select("user_id").deltas()


@query(f"WITH {CH} SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM ch WHERE user_id > 75 GROUP BY ALL HAVING SUM(weight) <> 0")
def z_where(spark, d):
    return changes(spark, d).where("user_id > 75").deltas()


@query(f"WITH {CH}, u AS (SELECT unnest([user_id, -user_id]) AS node, weight, epoch FROM ch) SELECT node, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY node, epoch HAVING SUM(weight) <> 0")
def z_select_many(spark, d):
    return changes(spark, d).select_many(F.array("user_id", -F.col("user_id")), "node").deltas()


@query(f"WITH {EV}, {A_SQL}{steps_sql('a', 'user_id', 'weight', 'CASE WHEN weight > 0 THEN 1 ELSE 0 END')}")
def z_distinct(spark, d):
    return side_a(spark, d).distinct().df


@query(f"WITH {EV}, {A_SQL}{steps_sql('a', 'user_id', 'weight', 'ABS(weight)')}")
def z_abs(spark, d):
    return side_a(spark, d).abs().df


@query(f"WITH {EV}, {A_SQL}, {B_SQL}{BOTH}{steps_sql('ab', 'user_id', 'wa wb', 'GREATEST(wa, wb)')}")
def z_union(spark, d):
    return side_a(spark, d).union(side_b(spark, d)).df


@query(f"WITH {EV}, {A_SQL}, {B_SQL}{BOTH}{steps_sql('ab', 'user_id', 'wa wb', 'LEAST(wa, wb)')}")
def z_intersect(spark, d):
    return side_a(spark, d).intersect(side_b(spark, d)).df


@query(f"WITH {EV}, {A_SQL}, {B_SQL}{BOTH}{steps_sql('ab', 'user_id', 'wa wb', 'ABS(wa - wb)')}")
def z_symmetric_difference(spark, d):
    return side_a(spark, d).symmetric_difference(side_b(spark, d)).df


@query(f"WITH {EV}, {A_SQL}, {B_SQL}, u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT user_id, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, epoch HAVING SUM(weight) <> 0")
def z_concat(spark, d):
    return side_a(spark, d).concat(side_b(spark, d)).deltas()


@query(f"WITH {EV}, {A_SQL}, {B_SQL}, u AS (SELECT * FROM a UNION ALL SELECT user_id, -weight, epoch FROM b) SELECT user_id, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, epoch HAVING SUM(weight) <> 0")
def z_except(spark, d):
    return side_a(spark, d).except_(side_b(spark, d)).deltas()


@query(f"WITH {EV}, {A_SQL}, {B_SQL} SELECT a.user_id, CAST(SUM(a.weight * b.weight) AS BIGINT) AS weight, GREATEST(a.epoch, b.epoch) AS epoch FROM a JOIN b USING (user_id) GROUP BY a.user_id, GREATEST(a.epoch, b.epoch) HAVING SUM(a.weight * b.weight) <> 0")
def z_join(spark, d):
    return side_a(spark, d).join(side_b(spark, d), ["user_id"]).deltas()


def value_steps_sql(source: str, sums: str, value: str, keep: str, name: str) -> str:
    """Changes of one (user_id, value) row a key."""
    inner = ", ".join(f"SUM({s}) AS s{i}" for i, s in enumerate(sums.split("|")))
    outer = ", ".join(f"SUM(s{i}) OVER (PARTITION BY user_id ORDER BY epoch) AS s{i}" for i in range(len(sums.split("|"))))
    return (
        f", per AS (SELECT user_id, epoch, {inner} FROM {source} GROUP BY 1, 2), run AS (SELECT user_id, epoch, {outer} FROM per), "
        f"now AS (SELECT user_id, epoch, CASE WHEN {keep} THEN {value} END AS v FROM run), old AS (SELECT *, LAG(v) OVER (PARTITION BY user_id ORDER BY epoch) AS o FROM now), "
        f"d AS (SELECT * FROM old WHERE v IS DISTINCT FROM o) "
        f"SELECT user_id, CAST(v AS BIGINT) AS {name}, CAST(1 AS BIGINT) AS weight, epoch FROM d WHERE v IS NOT NULL UNION ALL SELECT user_id, CAST(o AS BIGINT), CAST(-1 AS BIGINT), epoch FROM d WHERE o IS NOT NULL"
    )


@query(f"WITH {EV}, {A_SQL}{value_steps_sql('a', 'weight', 's0', 's0 > 0', 'count')}")
def z_count(spark, d):
    return side_a(spark, d).count("user_id").df


def numbers(spark, d) -> Collection:
    e = events(spark, d)
    return Collection(e.select("user_id", F.floor("value").cast("long").alias("v"), F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long").alias("weight"), "epoch"))


NUM = EV + ", nu AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS v, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS weight, epoch FROM ev)"


@query(f"WITH {NUM}{value_steps_sql('nu', 'weight * v|weight', 's0', 's0 <> 0 OR s1 <> 0', 'sum')}")
def z_sum(spark, d):
    return numbers(spark, d).sum(["user_id"], F.col("v")).df


@query(f"WITH {NUM}{value_steps_sql('nu', 'weight * v * v|weight', '2 * s0', 's0 <> 0 OR s1 <> 0', 'value')}")
def z_aggregate(spark, d):
    return numbers(spark, d).aggregate(["user_id"], F.col("v") * F.col("v"), result=lambda v: v * 2).df


def extreme_sql(f: str) -> str:
    return (
        f"WITH {NUM}, w AS (SELECT DISTINCT user_id, epoch FROM nu), s AS (SELECT *, LEAD(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS until FROM w), "
        f"c AS (SELECT w.user_id, w.epoch, nu.v, SUM(nu.weight) AS weight FROM w JOIN nu ON nu.user_id = w.user_id AND nu.epoch <= w.epoch GROUP BY 1, 2, 3 HAVING SUM(nu.weight) > 0), "
        f"b AS (SELECT user_id, epoch, {f}(v) AS v FROM c GROUP BY 1, 2), h AS (SELECT b.*, s.until FROM b JOIN s USING (user_id, epoch)), "
        f"u AS (SELECT user_id, v, 1 AS weight, epoch FROM h UNION ALL SELECT user_id, v, -1, until FROM h WHERE until IS NOT NULL) "
        f"SELECT user_id, v, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, v, epoch HAVING SUM(weight) <> 0"
    )


@query(extreme_sql("MIN"))
def z_min(spark, d):
    return numbers(spark, d).min(["user_id"], F.col("v")).df


@query(extreme_sql("MAX"))
def z_max(spark, d):
    return numbers(spark, d).max(["user_id"], F.col("v")).df


GROUPED = (
    f"WITH {CH}, w AS (SELECT DISTINCT user_id, epoch FROM ch), s AS (SELECT *, LEAD(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS until FROM w), "
    f"c AS (SELECT w.user_id, w.epoch, ch.event_type, SUM(ch.weight) AS weight FROM w JOIN ch ON ch.user_id = w.user_id AND ch.epoch <= w.epoch GROUP BY 1, 2, 3 HAVING SUM(ch.weight) > 0), "
    f"b AS (SELECT user_id, epoch, CAST(SUM(weight) AS BIGINT) AS value FROM c GROUP BY 1, 2), h AS (SELECT b.*, s.until FROM b JOIN s USING (user_id, epoch)), "
    f"u AS (SELECT user_id, value, 1 AS weight, epoch FROM h UNION ALL SELECT user_id, value, -1, until FROM h WHERE until IS NOT NULL) "
    f"SELECT user_id, value, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, value, epoch HAVING SUM(weight) <> 0"
)


@query(GROUPED)
def z_group_by(spark, d):
    return changes(spark, d).group_by(["user_id"], F.col("event_type"), lambda v: F.array(F.size(v).cast("long"))).df


CO = (
    f"WITH {EV}, {A_SQL}, {B_SQL}, w AS (SELECT user_id, epoch FROM a UNION SELECT user_id, epoch FROM b), s AS (SELECT *, LEAD(epoch) OVER (PARTITION BY user_id ORDER BY epoch) AS until FROM w), "
    f"x AS (SELECT w.user_id, w.epoch, GREATEST(COALESCE((SELECT SUM(weight) FROM a WHERE a.user_id = w.user_id AND a.epoch <= w.epoch), 0), 0) AS na, GREATEST(COALESCE((SELECT SUM(weight) FROM b WHERE b.user_id = w.user_id AND b.epoch <= w.epoch), 0), 0) AS nb FROM w), "
    f"h AS (SELECT x.user_id, CAST(na - nb AS BIGINT) AS value, x.epoch, s.until FROM x JOIN s USING (user_id, epoch) WHERE na > 0 OR nb > 0), "
    f"u AS (SELECT user_id, value, {{w}} AS weight, epoch FROM h UNION ALL SELECT user_id, value, -({{w}}), until FROM h WHERE until IS NOT NULL) "
    f"SELECT user_id, value, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, value, epoch HAVING SUM(weight) <> 0"
)


def _difference(a, b):
    return F.array((F.size(a) - F.size(b)).cast("long"))


@query(CO.replace("{w}", "1"))
def z_co_group_by(spark, d):
    u = F.col("user_id")
    return side_a(spark, d).co_group_by(side_b(spark, d), ["user_id"], u, u, _difference).df


@query(CO.replace("{w}", "2"))
def z_co_group_by_weighted(spark, d):
    u = F.col("user_id")
    return side_a(spark, d).co_group_by(side_b(spark, d), ["user_id"], u, u, _difference, weight=lambda a, b: F.lit(2)).df


@query(f"WITH {CH} SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight, GREATEST(epoch, 10) AS epoch FROM ch GROUP BY user_id, event_type, GREATEST(epoch, 10) HAVING SUM(weight) <> 0")
def z_adjust_time(spark, d):
    return changes(spark, d).adjust_time(F.lit(10)).deltas()


@query(f"WITH {CH}, u AS (SELECT * FROM ch UNION ALL SELECT user_id, event_type, -weight, epoch + 3 FROM ch) SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight, epoch FROM u GROUP BY user_id, event_type, epoch HAVING SUM(weight) <> 0")
def z_sliding_window(spark, d):
    return changes(spark, d).sliding_window(3).deltas()


@query(f"WITH {CH} SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight FROM ch WHERE epoch <= 7 GROUP BY user_id, event_type HAVING SUM(weight) <> 0")
def z_at(spark, d):
    return changes(spark, d).at(7)


@query(f"WITH {CH} SELECT user_id, event_type, CAST(SUM(weight) AS BIGINT) AS weight, GREATEST(epoch, 20) AS epoch FROM ch GROUP BY user_id, event_type, GREATEST(epoch, 20) HAVING SUM(weight) <> 0")
def z_compact(spark, d):
    return changes(spark, d).compact(20).df


@query(f"WITH {CH} SELECT COUNT(*) AS records, CAST(SUM(weight) AS BIGINT) AS weight FROM ch")
def z_monitor(spark, d):
    """What was counted while the changes passed."""
    seen = Observation("monitor")
    changes(spark, d).monitor(seen).df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["records"], seen.get["weight"])], "records long, weight long")


@query(f"""WITH {EV}, seen AS (SELECT user_id, MIN(epoch) AS epoch FROM ev GROUP BY user_id)
SELECT user_id AS node, CAST(1 AS BIGINT) AS weight, epoch FROM seen
UNION ALL SELECT -1 - k AS node, CAST(1 AS BIGINT), MIN(epoch) FROM (SELECT unnest(range(user_id // 32 + 1)) AS k, epoch FROM seen) GROUP BY 1""")
def z_fixed_point(spark, d):
    """Users, and -1 - k for every k from 0 to user_id // 32, reached one step at a time."""
    users = Collection(events(spark, d).select(F.col("user_id").alias("node"), F.lit(1).cast("long").alias("weight"), "epoch"))

    def body(x: Collection) -> Collection:
        first = x.where("node >= 0").select((-1 - F.floor(F.col("node") / 32)).cast("long").alias("node"))
        return users.concat(first).concat(x.where("node < -1").select((F.col("node") + 1).alias("node"))).distinct()

    return users.distinct().fixed_point(body).df


@query(f"""WITH {EV}, seen AS (SELECT user_id, MIN(epoch) AS epoch FROM ev GROUP BY user_id)
SELECT k AS node, CAST(1 AS BIGINT) AS weight, MIN(epoch) AS epoch FROM (SELECT unnest(range(user_id, user_id + 1)) AS k, epoch FROM seen UNION ALL SELECT user_id // 10 - 1000, epoch FROM seen) GROUP BY k""")
def z_general_fixed_point(spark, d):
    """Users enter by tens, largest last; each adds its ten's own node."""
    users = Collection(events(spark, d).select(F.col("user_id").alias("node"), F.lit(1).cast("long").alias("weight"), "epoch")).distinct()

    def body(x: Collection) -> Collection:
        return x.concat(x.where("node >= 0").select((F.floor(F.col("node") / 10) - 1000).cast("long").alias("node"))).distinct()

    return users.general_fixed_point(body, F.floor(F.col("node") / 75).cast("long") * 1000).df


@query(f"WITH {EV}, {A_SQL}{value_steps_sql('a', 'weight', 's0', 's0 > 0', 'count')}")
def z_epoch_deltas(spark, d):
    """The rule-free form: contents evaluated epoch by epoch agree with the delta rule of count."""
    return deltas.epoch_deltas(lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("count")), side_a(spark, d)).df


# --- graphs --------------------------------------------------------------------------------------


def part_edges(spark, d) -> DataFrame:
    """Parts that follow each other in an order."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"))
    return e.filter("target is not null and source <> target").distinct()


PARTS = "pe AS (SELECT DISTINCT source, target FROM (SELECT l_partkey AS source, LEAD(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS target FROM lineitem) WHERE target IS NOT NULL AND source <> target)"


def family(spark, d) -> DataFrame:
    """region > nation > customer > order, with names as identifiers."""
    pick = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))
    return l1.concat(pick("nation", "r", "n_regionkey", "n", "n_nationkey"), pick("customer", "n", "c_nationkey", "c", "c_custkey"), pick("orders", "c", "o_custkey", "o", "o_orderkey"))


def number_family(spark, d) -> DataFrame:
    """nation - customer - order as numbers: nations below 100, customers and orders above."""
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("source"), (F.col("c_custkey") + 1000).alias("target"))
    b = table(spark, d, "orders").select((F.col("o_custkey") + 1000).alias("source"), (F.col("o_orderkey") + 1_000_000_000).alias("target"))
    return a.unionByName(b)


FAMILY = """fam AS (SELECT CAST(c_nationkey AS BIGINT) AS label, c_custkey + 1000 AS node FROM customer
UNION ALL SELECT CAST(c_nationkey AS BIGINT), o_orderkey + 1000000000 FROM orders JOIN customer ON c_custkey = o_custkey
UNION SELECT CAST(c_nationkey AS BIGINT), CAST(c_nationkey AS BIGINT) FROM customer)"""


def block_edges(spark, d) -> DataFrame:
    """Parts in blocks of neighbours, each pointing to one of its block by a quadratic map: cycles
    with tails, self-loops, and parts that nothing points to."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.floor(F.col("p_partkey") / 16).alias("b"))
    w = Window.partitionBy("b")
    p = p.select("node", "b", (F.row_number().over(w.orderBy("node")) - 1).cast("long").alias("i"), F.count("*").over(w).alias("n"))
    to = p.select(F.col("node").alias("target"), "b", F.col("i").alias("j"))
    return p.withColumn("j", (F.col("i") * F.col("i") + F.col("b")) % F.col("n")).join(to, ["b", "j"]).select(F.col("node").alias("source"), "target")


BLOCKS = """blk AS MATERIALIZED (SELECT node, b, row_number() OVER (PARTITION BY b ORDER BY node) - 1 AS i, count(*) OVER (PARTITION BY b) AS n FROM (SELECT p_partkey AS node, p_partkey // 16 AS b FROM part)),
be AS MATERIALIZED (SELECT x.node AS s, y.node AS t, x.b, x.i, y.i AS j FROM blk x JOIN blk y ON x.b = y.b AND y.i = (x.i * x.i + x.b) % x.n)"""
#: (s, t): t is reached from s along one edge or more
REACH = "reach(s, t) AS (SELECT s, t FROM be UNION SELECT reach.s, be.t FROM reach JOIN be ON be.s = reach.t)"
#: (s, t) the same, whatever the edges' direction
NEAR = "duo AS (SELECT s, t FROM be UNION SELECT t, s FROM be), near(s, t) AS (SELECT s, t FROM duo UNION SELECT near.s, duo.t FROM near JOIN duo ON duo.s = near.t)"


def part_values(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("value"))


@query(f"WITH {PARTS} SELECT target AS node, CAST(p_size AS BIGINT) AS value FROM pe JOIN part ON p_partkey = source")
def g_transmit_along(spark, d):
    return graph.transmit_along(part_values(spark, d), part_edges(spark, d))


@query(f"WITH {PARTS} SELECT target AS node, p_size + target AS value FROM pe JOIN part ON p_partkey = source")
def g_transmit_select(spark, d):
    return graph.transmit_along(part_values(spark, d), part_edges(spark, d), lambda v, t: v + t)


@query(f"WITH {PARTS} SELECT target AS node, MAX(CAST(p_size AS BIGINT)) AS value FROM pe JOIN part ON p_partkey = source GROUP BY target")
def g_graph_reduce(spark, d):
    return graph.graph_reduce(part_values(spark, d), part_edges(spark, d), F.max)


@query("SELECT l_partkey AS node, ROUND(SUM(l_quantity), 4) AS value FROM lineitem GROUP BY l_partkey")
def g_node_aggregate(spark, d):
    v = table(spark, d, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_quantity").alias("value"))
    return graph.node_aggregate(v).withColumn("value", F.round("value", 4))


@query(f"WITH {PARTS}, deg AS (SELECT source, COUNT(*) AS n FROM pe GROUP BY source) SELECT p_partkey AS node, p_size + COALESCE(n, 0) AS value FROM part LEFT JOIN deg ON source = p_partkey")
def g_node_join(spark, d):
    degrees = graph.count_nodes(part_edges(spark, d).select(F.col("source").alias("node")))
    return graph.node_join(part_values(spark, d), degrees, lambda v, s: v + s, 0)


@query("SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS value FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def g_filter_by(spark, d):
    return graph.filter_by(part_values(spark, d), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("node")))


@query("SELECT l_partkey AS node, COUNT(*) AS value FROM lineitem GROUP BY l_partkey")
def g_count_nodes(spark, d):
    return graph.count_nodes(table(spark, d, "lineitem").select(F.col("l_partkey").alias("node")))


@query("SELECT DISTINCT l_partkey AS node FROM lineitem")
def g_distinct_nodes(spark, d):
    return graph.distinct_nodes(table(spark, d, "lineitem").select(F.col("l_partkey").alias("node")))


@query("SELECT COUNT(*) AS names, COUNT(*) AS nodes, CAST(0 AS BIGINT) AS least, COUNT(*) - 1 AS greatest FROM (SELECT DISTINCT p_name FROM part)")
def g_dense_names(spark, d):
    m = graph.dense_names(table(spark, d, "part"), "p_name")
    return m.agg(F.count_distinct("name").alias("names"), F.count_distinct("node").alias("nodes"), F.min("node").alias("least"), F.max("node").alias("greatest"))


@query("SELECT 'c' || o_custkey AS source, 'o' || o_orderkey AS target FROM orders UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation")
def g_rename_edges(spark, d):
    """To dense nodes and back: every edge survives."""
    e = family(spark, d)
    m = graph.AutoRenamer().add(e, "source", "target").finish()
    back = m.select(F.col("node").alias("name"), F.col("name").alias("node"))
    return graph.rename_edges(graph.rename_edges(e, m), back)


@query("SELECT 'n' || n_nationkey AS name, n_name AS value FROM nation")
def g_rename_nodes(spark, d):
    """Names to nodes and back."""
    v = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("value"))
    m = graph.AutoRenamer().add(v, "name").finish()
    return graph.rename_nodes(v, m).join(m, "node").select("name", "value")


@query("SELECT event_id AS node, value FROM events WHERE value > 100")
def g_filter_options(spark, d):
    v = table(spark, d, "events").select(F.col("event_id").alias("node"), F.when(F.col("value") > 100, F.col("value")).alias("value"))
    return graph.filter_options(v)


@query("SELECT user_id AS node, CAST(MAX(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) + 10 * MAX(CASE WHEN user_id < 5 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY user_id")
def g_state_machine_initial(spark, d):
    """A flag that purchases set, on states that some nodes begin with."""
    e = table(spark, d, "events")
    v = e.select(F.col("user_id").alias("node"), "event_id", (F.col("event_type") == "purchase").cast("long").alias("value"))
    start = e.filter("user_id < 5").select(F.col("user_id").alias("node")).distinct().withColumn("value", F.lit(10).cast("long"))
    return graph.state_machine(v, "event_id", F.lit(0).cast("long"), lambda x, s: F.when((x == 1) & (s % 10 == 0), s + 1).otherwise(s), start)


@query("SELECT user_id AS node, CAST(SUM(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) FILTER (WHERE event_id > COALESCE(last_error, -1)) AS BIGINT) AS value FROM (SELECT *, MAX(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_error FROM events) GROUP BY user_id HAVING value IS NOT NULL UNION ALL SELECT user_id, 0 FROM (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id) WHERE t = 'error'")
def g_state_machine(spark, d):
    """Events since the last error: a counter that errors reset."""
    v = table(spark, d, "events").select(F.col("user_id").alias("node"), "event_id", F.col("event_type").alias("value"))
    return graph.state_machine(v, "event_id", F.lit(0).cast("long"), lambda x, s: F.when(x == "error", F.lit(0).cast("long")).otherwise(s + 1))


@query("SELECT user_id AS node, MAX(event_id) AS event_id, CAST(COUNT(*) FILTER (WHERE event_id > COALESCE(last_error, -1)) AS BIGINT) AS value FROM (SELECT *, MAX(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS last_error FROM events) GROUP BY user_id")
def g_state_machine_stream(spark, d):
    """The same counter with one state in memory, however long a node's history."""
    v = table(spark, d, "events").select(F.col("user_id").alias("node"), "event_id", F.col("event_type").alias("value"))
    return graph.state_machine_stream(v, "event_id", 0, lambda x, s: 0 if x == "error" else s + 1)


@query("SELECT user_id AS node, event_id, event_type AS value FROM (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def g_state_changes(spark, d):
    """The kind of a user's latest event, whenever it changes."""
    v = table(spark, d, "events").select(F.col("user_id").alias("node"), "event_id", F.col("event_type").alias("value"))
    return graph.state_changes(v, "event_id", F.lit(None).cast("string"), lambda x, s: x)


# --- loops ---------------------------------------------------------------------------------------


@query("SELECT p_partkey AS node, CAST(p_size AS BIGINT) + 4 AS value, CAST(0 AS INTEGER) AS epoch FROM part")
def i_iterate(spark, d):
    """Bounded by 3: the body runs four times."""
    return iterate.iterate(l1.with_epoch(part_values(spark, d)), lambda x: x.withColumn("value", F.col("value") + 1), 3)


@query("SELECT p_partkey AS node, CAST(p_size AS BIGINT) + k AS value, CAST(0 AS INTEGER) AS epoch FROM part, range(1, 5) t(k) WHERE p_size + k <= 40")
def i_iterate_and_accumulate(spark, d):
    step = lambda x: x.withColumn("value", F.col("value") + 1).filter("value <= 40")
    return iterate.iterate_and_accumulate(l1.with_epoch(part_values(spark, d)), step, 3)


@query("SELECT p_partkey AS node, CAST(p_size AS BIGINT) AS value, CAST(p_size // 20 AS INTEGER) AS iteration FROM part WHERE p_size < 60")
def i_enter_loop(spark, d):
    """Rows enter at the iteration that they name."""
    enter = iterate.entering(part_values(spark, d), F.floor(F.col("value") / 20))
    return l1.concat(*[enter(i).withColumn("iteration", F.lit(i)) for i in range(3)])


@query("SELECT p_partkey AS node, CAST(p_size AS BIGINT) + k AS value FROM part, range(2, 4) t(k)")
def i_leave_loop(spark, d):
    """Only the results of iterations 1 and 2 leave."""
    results, x = [], part_values(spark, d)
    for _ in range(3):
        x = x.withColumn("value", F.col("value") + 1)
        results.append(x)
    return iterate.leaving(results, 1)


# --- shipped queries -----------------------------------------------------------------------------


@query(r"SELECT word, COUNT(*) AS count FROM (SELECT unnest(string_split_regex(text, '[ \t\n\x0b\f\r]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count(spark, d):
    return algorithms.word_count(table(spark, d, "documents"))


@query("WITH w AS (SELECT unnest(string_split(text, ' ')) AS word, 1 AS n, CAST(turn AS INTEGER) AS epoch FROM conversations), per AS (SELECT word, epoch, SUM(n) AS n FROM w GROUP BY 1, 2), run AS (SELECT word, epoch, SUM(n) OVER (PARTITION BY word ORDER BY epoch) AS c FROM per), o AS (SELECT *, LAG(c) OVER (PARTITION BY word ORDER BY epoch) AS b FROM run) SELECT word, CAST(c AS BIGINT) AS count, CAST(1 AS BIGINT) AS weight, epoch FROM o UNION ALL SELECT word, CAST(b AS BIGINT), CAST(-1 AS BIGINT), epoch FROM o WHERE b IS NOT NULL")
def word_count_changes(spark, d):
    """Conversations turn by turn: counts retract and grow."""
    c = table(spark, d, "conversations")
    return algorithms.word_count_changes(Collection(c.select("text", F.lit(1).cast("long").alias("weight"), F.col("turn").cast("int").alias("epoch")))).df


TERMS = r"SELECT DISTINCT id, word FROM (SELECT {id} AS id, unnest(string_split_regex(text, '[ \t\n\x0b\f\r]+')) AS word FROM {t}) WHERE word <> ''"


@query(f"WITH d AS ({TERMS.format(id='doc_id', t='documents')}), q AS ({TERMS.format(id='item_id', t='benchmark')}) SELECT d.id AS document, q.id AS query, CAST(12 AS INTEGER) AS threshold FROM d JOIN q USING (word) GROUP BY d.id, q.id HAVING COUNT(*) >= 12")
def search_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.lit(12).alias("threshold"))
    return algorithms.search(docs, asked)


@query("SELECT key, COUNT(*) AS n FROM (SELECT CASE WHEN label < 10 THEN 65536 * label ELSE 65536 * (10 + CAST(round_even(ln(1 + label), 0) AS BIGINT)) END AS key FROM (SELECT p_partkey AS label FROM part)) GROUP BY key")
def label_priorities(spark, d):
    """The order in which labels enter a prioritised fixed point."""
    return table(spark, d, "part").select(text.log1p_bucket(F.col("p_partkey")).cast("long").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {BLOCKS}, {NEAR} SELECT s AS node, LEAST(s, MIN(t)) AS label FROM near GROUP BY s")
def connected_components(spark, d):
    """Of graphs with cycles and tails."""
    return algorithms.connected_components(block_edges(spark, d))


@query(f"WITH {FAMILY} SELECT node, label FROM fam")
def connected_components_of_families(spark, d):
    return algorithms.connected_components(number_family(spark, d))


CHANGING = "CASE WHEN s % 3 = 0 THEN 2 WHEN s % 3 = 1 THEN 0 ELSE 1 END"


@query(f"""WITH RECURSIVE {BLOCKS}, ch AS (SELECT s, t, {CHANGING} AS e, 1 AS w FROM be UNION ALL SELECT s, t, {CHANGING} + 2, -1 FROM be WHERE s % 4 < 2),
held AS (SELECT k AS e, s, t FROM ch, range(5) AS r(k) WHERE ch.e <= k GROUP BY k, s, t HAVING SUM(w) > 0),
duo AS (SELECT e, s, t FROM held UNION SELECT e, t, s FROM held),
near(e, s, t) AS (SELECT e, s, t FROM duo UNION SELECT near.e, near.s, duo.t FROM near JOIN duo ON duo.e = near.e AND duo.s = near.t),
lab AS (SELECT e, s AS node, LEAST(s, MIN(t)) AS label FROM near GROUP BY e, s),
c AS (SELECT node, label, e, 1 AS w FROM lab UNION ALL SELECT node, label, e + 1, -1 FROM lab WHERE e < (SELECT MAX(e) FROM ch))
SELECT node, label, CAST(SUM(w) AS BIGINT) AS weight, CAST(e AS INTEGER) AS epoch FROM c GROUP BY node, label, e HAVING SUM(w) <> 0""")
def connected_components_changes(spark, d):
    """Edges enter over three epochs and half of them leave again: labels retract and return."""
    e = block_edges(spark, d)
    enters = F.when(F.col("source") % 3 == 0, 2).when(F.col("source") % 3 == 1, 0).otherwise(1)
    plus = e.select("source", "target", F.lit(1).cast("long").alias("weight"), enters.alias("epoch"))
    minus = e.filter(F.col("source") % 4 < 2).select("source", "target", F.lit(-1).cast("long").alias("weight"), (enters + 2).alias("epoch"))
    return algorithms.component_changes(Collection(plus.unionByName(minus))).df


@query(f"WITH {FAMILY} SELECT node, MAX(node) OVER (PARTITION BY label) AS label FROM fam")
def connected_components_greatest(spark, d):
    return algorithms.connected_components(number_family(spark, d), greatest=True)


@query(f"WITH {FAMILY}, s AS (SELECT label, COUNT(*) AS size FROM fam GROUP BY label) SELECT size, COUNT(*) AS components FROM s GROUP BY size")
def component_sizes(spark, d):
    return algorithms.component_sizes(algorithms.connected_components(number_family(spark, d)))


@query(f"WITH RECURSIVE {BLOCKS}, {REACH}, n AS (SELECT s AS node, s AS v FROM be UNION SELECT t, t FROM be UNION ALL SELECT t, s FROM reach) SELECT node, MAX(v) AS label FROM n GROUP BY node")
def label_propagation(spark, d):
    """Along edges, around cycles."""
    return algorithms.label_propagation(block_edges(spark, d))


@query("SELECT 'r' || r_regionkey AS node FROM region UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'c' || c_custkey FROM customer UNION SELECT 'o' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey")
def reachability(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return algorithms.reachability(family(spark, d), roots)


def _pagerank_sql(steps: int) -> str:
    parts = [PARTS, "deg AS (SELECT source, COUNT(*) AS n FROM pe GROUP BY source)", "x0 AS (SELECT source AS node, CAST(0.15 AS DOUBLE) AS v FROM deg)"]
    for i in range(1, steps + 1):
        parts.append(f"x{i} AS MATERIALIZED (SELECT target AS node, SUM(v * (CAST(0.85 AS DOUBLE) / n)) AS v FROM x{i - 1} JOIN deg ON deg.source = x{i - 1}.node JOIN pe ON pe.source = deg.source GROUP BY target)")
    every = " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(steps + 1))
    return f"WITH {', '.join(parts)} SELECT node, ROUND(SUM(v), 8) AS rank FROM ({every}) GROUP BY node"


@query(_pagerank_sql(11))
def pagerank(spark, d):
    return algorithms.pagerank(part_edges(spark, d)).withColumn("rank", F.round("rank", 8))


@query(f"WITH RECURSIVE {BLOCKS}, {REACH} SELECT node, LEAST(node, MIN(r.t)) AS label FROM (SELECT s AS node FROM be UNION SELECT t FROM be) LEFT JOIN (SELECT a.s, a.t FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s) r ON r.s = node GROUP BY node")
def strongly_connected_components(spark, d):
    return algorithms.strongly_connected_components(block_edges(spark, d))


@query(f"WITH RECURSIVE {BLOCKS}, {REACH} SELECT be.t AS source, be.s AS target FROM be WHERE be.s IN (SELECT s FROM reach WHERE s = t)")
def trim_leaves(spark, d):
    """Against the edges' direction, tails go and cycles stay."""
    return algorithms.trim_leaves(algorithms.flip(block_edges(spark, d)))


#: a block's nodes in order, each with the least colour that its lower neighbours leave
COLOURS = f"""{BLOCKS}, low AS MATERIALIZED (SELECT b, greatest(i, j) AS i, list(DISTINCT least(i, j)) AS lower FROM be WHERE i <> j GROUP BY 1, 2),
col(b, n, i, cs) AS (SELECT DISTINCT b, n, CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] FROM blk UNION ALL
SELECT col.b, col.n, col.i + 1, list_append(cs, list_filter(range(0, len(coalesce(lower, [])) + 1), lambda k: NOT list_contains(list_transform(coalesce(lower, []), lambda x: cs[x + 1]), k))[1])
FROM col LEFT JOIN low ON low.b = col.b AND low.i = col.i + 1 WHERE col.i + 1 < col.n)"""


@query(f"WITH RECURSIVE {COLOURS} SELECT node, CAST(cs[blk.i + 1] AS INTEGER) AS colour FROM blk JOIN col ON col.b = blk.b AND col.i = col.n - 1 WHERE node IN (SELECT s FROM be WHERE s <> t UNION SELECT t FROM be WHERE s <> t)")
def graph_colouring(spark, d):
    return algorithms.colour(block_edges(spark, d))


@query("SELECT CAST(0 AS BIGINT) AS conflicts")
def colouring_check(spark, d):
    e = algorithms.flip(block_edges(spark, d))
    return algorithms.colour_conflicts(e, algorithms.colour(e)).agg(F.count("*").alias("conflicts"))


@query("SELECT COUNT(*) AS edges, true AS inside, true AS spread FROM part")
def random_graph(spark, d):
    """As many edges as parts; ends lie in range, and most nodes have one."""
    n = table(spark, d, "part").count()
    g = algorithms.random_graph(spark, 100, n)
    inside = F.min(F.least("source", "target") >= 0) & F.max(F.greatest("source", "target") < 100)
    return g.agg(F.count("*").alias("edges"), inside.alias("inside"), (F.count_distinct("source") > 50).alias("spread"))


@query("SELECT COUNT(*) AS received, CAST(SUM(l_partkey) AS BIGINT) AS total FROM lineitem")
def exchange(spark, d):
    return algorithms.exchange(table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey"), 8).agg(F.count("*").alias("received"), F.sum("l_partkey").alias("total"))


# --- sources and sinks ---------------------------------------------------------------------------


@query(f"WITH {EV} SELECT epoch, COUNT(*) AS n, CAST(1 AS BIGINT) AS folders FROM ev GROUP BY epoch")
def io_write_by_epoch(spark, d):
    """Written per epoch and read back with the uris that the sink reports."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    uris = io.write_by_epoch(events(spark, d).select("event_id", "epoch"), path, max_records=5000)
    folders = uris.select("epoch", F.regexp_extract("uri", r"epoch=(\d+)", 1).alias("f")).groupBy("epoch").agg(F.count_distinct("f").alias("folders"))
    return spark.read.parquet(path).groupBy("epoch").agg(F.count("*").alias("n")).join(folders, "epoch")


@query("SELECT COUNT(*) AS lines, CAST(SUM(length(text)) AS BIGINT) AS chars FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM documents)")
def io_text_lines(spark, d):
    """Documents as text files, read back line by line, none lost."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    lines.write.text(path)
    return io.read_lines(spark, path).agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


@query("SELECT COUNT(*) AS lines, COUNT(DISTINCT text) AS texts, CAST(7 AS BIGINT) AS parts FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM conversations)")
def io_repartition(spark, d):
    """Text lines written in a given number of parts and read back."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    lines = table(spark, d, "conversations").select(F.explode(F.split("text", "\n")).alias("line"))
    lines.repartition(7).write.text(path)
    back = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return back.agg(F.count("*").alias("lines"), F.count_distinct("value").alias("texts"), F.count_distinct("file").alias("parts"))


@query(f"WITH {EV} SELECT epoch, COUNT(*) AS n, true AS own FROM ev GROUP BY epoch")
def io_write_in_rounds(spark, d):
    """Epochs written as they close, each by a call of its own for two halves, and the last one again:
    none goes, none is doubled, and a call gives the files of its own epochs."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    e = storage.cut(events(spark, d).select("event_id", "epoch"))
    half = e.agg(F.expr("percentile(epoch, 0.5)")).first()[0]
    first = io.write_by_epoch(e.filter(F.col("epoch") <= half), path)
    io.write_by_epoch(e.filter(F.col("epoch") > half), path)
    again = io.write_by_epoch(e.filter(F.col("epoch") > half), path)
    own = first.agg(F.max("epoch")).first()[0] <= half < again.agg(F.min("epoch")).first()[0]
    return spark.read.parquet(path).groupBy("epoch").agg(F.count("*").alias("n")).withColumn("own", F.lit(own))


@query("SELECT event_id, user_id FROM events")
def io_custom_files(spark, d):
    """Records of fixed width, written to files of one's own format and read back."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    io.write_custom_files(table(spark, d, "events").select("event_id", "user_id").repartition(3), path, io.pack_longs)
    names = ["event_id", "user_id"]
    return io.read_custom(spark, path, lambda c: io.unpack_longs(c, names), "event_id long, user_id long").select(*names)


@query("SELECT p_partkey, p_name, CAST(0 AS INTEGER) AS epoch FROM part")
def io_binary(spark, d):
    """Typed records, written and read back as one epoch."""
    path = f"{storage.shared_dir(spark)}/io-{uuid.uuid4().hex[:10]}"
    table(spark, d, "part").select("p_partkey", "p_name").write.parquet(path)
    return io.read_binary(spark, path)


@query("WITH w AS (SELECT conv_id, unnest(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' ')))) AS word, turn FROM conversations) SELECT conv_id, word, COUNT(*) AS weight, CAST(turn AS INTEGER) AS epoch FROM w GROUP BY ALL")
def z_select_many_segments(spark, d):
    """A text's words as segments, one a line."""
    c = table(spark, d, "conversations").select("conv_id", "text", F.lit(1).cast("long").alias("weight"), F.col("turn").cast("int").alias("epoch"))
    lines = F.transform(F.split("text", "\n"), lambda line: F.split(line, " "))
    return Collection(c).select_many_segments(lines, "word", "conv_id").deltas()


@query("WITH r AS (SELECT event_id, user_id, SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id AS node, event_id, CAST(n AS BIGINT) AS out FROM r")
def g_state_outputs(spark, d):
    """An output for every input: how many errors the user has had so far."""
    values = table(spark, d, "events").select(F.col("user_id").alias("node"), "event_id", (F.col("event_type") == "error").cast("long").alias("value"))
    return graph.state_machine_outputs(values, "event_id", 0, lambda v, s: (s + v, s + v))


@query("SELECT user_id, COUNT(*) AS n, CAST(1 AS BIGINT) AS places FROM events GROUP BY user_id")
def z_partition_by(spark, d):
    c = Collection(events(spark, d).select("user_id", F.lit(1).cast("long").alias("weight"), "epoch")).partition_by("user_id").assume_partitioned_by("user_id").assume_immutable()
    return c.df.withColumn("place", F.spark_partition_id()).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"))


# --- streams -------------------------------------------------------------------------------------

#: Files of a micro-batch.
PER_BATCH = 8
#: Events of the third day that arrive with the last one's, far behind the watermark.
LATE = "(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) = 2 AND event_id % 20 = 7)"
#: Events with the number of their micro-batch.
BATCHED = f"""ar AS (SELECT *, CASE WHEN {LATE} THEN MAX(CAST(ts AS DATE)) OVER () ELSE CAST(ts AS DATE) END AS arrives FROM events),
bt AS (SELECT *, CAST((dense_rank() OVER (ORDER BY arrives) - 1) // {PER_BATCH} AS INTEGER) AS epoch FROM ar)"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Events as they arrive: a file a day, in order, ``PER_BATCH`` files a micro-batch."""
    e = table(spark, d, "events")
    base = f"{storage.shared_dir(spark)}/arrivals-{uuid.uuid4().hex[:10]}"
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    last = e.agg(F.max(day)).first()[0]
    late = (day == 2) & (F.col("event_id") % 20 == 7)
    e.withColumn("day", F.when(late, last).otherwise(day)).repartition("day").write.partitionBy("day").parquet(base)
    # a stream takes files by their times
    fs, folder = storage.file_system(spark, base)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "day=*/part-*"))
    for f in found:
        fs.setTimes(f.getPath(), 1_700_000_000_000 + 1000 * int(f.getPath().getParent().getName()[4:]), -1)
    return streams.file_epochs(spark, f"{base}/day=*/part-*", e.schema, per_epoch=PER_BATCH)


def _collected(df: DataFrame, mode: str) -> DataFrame:
    base = f"{storage.shared_dir(df.sparkSession)}/collected-{uuid.uuid4().hex[:10]}"
    return streams.to_files(df, f"{base}/out", f"{base}/check", mode)


@query("SELECT event_type, COUNT(*) AS count FROM events GROUP BY event_type")
def s_count(spark, d):
    return _collected(streams.streaming_count(_stream(spark, d), "event_type"), "complete")


@query("SELECT date_trunc('day', ts) AS start, event_type, COUNT(*) AS n FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE AND NOT " + LATE + " GROUP BY 1, 2")
def s_tumbling(spark, d):
    """Append mode: only windows that the watermark has closed, without rows that came after that."""
    e = streams.event_time(_stream(spark, d), "ts", "10 minutes")
    w = _collected(streams.tumbling(e, "ts", "1 day", F.count("*").alias("n"), keys=("event_type",)), "append")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT s AS start, COUNT(*) AS n FROM (SELECT unnest([date_trunc('day', ts) - INTERVAL 1 DAY, date_trunc('day', ts)]) AS s FROM events) GROUP BY s")
def s_sliding(spark, d):
    e = streams.event_time(_stream(spark, d), "ts", "10 minutes")
    w = _collected(streams.sliding(e, "ts", "2 days", "1 day", F.count("*").alias("n")), "complete")
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE NOT " + LATE + "), s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM s GROUP BY user_id, k")
def s_sessions(spark, d):
    """Sessions keep their state to the end, but rows behind the watermark are dropped."""
    e = streams.event_time(_stream(spark, d), "ts", "10 minutes")
    w = _collected(streams.sessions(e, "ts", "6 hours", F.count("*").alias("n"), keys=("user_id",)), "complete")
    return w.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _add(rows: pd.DataFrame, state: tuple | None) -> tuple[tuple, list[tuple]]:
    n = (state[0] if state else 0) + len(rows)
    return (n,), [(int(rows.user_id.iloc[0]), n)]


@query("SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id")
def s_machine(spark, d):
    m = streams.machine(_stream(spark, d), "user_id", _add, "user_id long, n long", "n long")
    return _collected(m, "update").groupBy("user_id").agg(F.max("n").alias("n"))


@query(f"""WITH {BATCHED}, per AS (SELECT user_id, epoch, COUNT(*) AS n FROM bt GROUP BY 1, 2), run AS (SELECT user_id, epoch, CAST(SUM(n) OVER (PARTITION BY user_id ORDER BY epoch) AS BIGINT) AS count FROM per),
old AS (SELECT *, LAG(count) OVER (PARTITION BY user_id ORDER BY epoch) AS was FROM run)
SELECT user_id, count, CAST(1 AS BIGINT) AS weight, epoch FROM old UNION ALL SELECT user_id, was, CAST(-1 AS BIGINT), epoch FROM old WHERE was IS NOT NULL""")
def s_changes(spark, d):
    """Weighted changes of a streaming count, micro-batch by micro-batch: old counts go, new ones come."""
    base = f"{storage.shared_dir(spark)}/changes-{uuid.uuid4().hex[:10]}"
    streams.changes_of(streams.streaming_count(_stream(spark, d), "user_id"), ["user_id"], "count", f"{base}/out", f"{base}/check")
    return spark.read.parquet(f"{base}/out").select("user_id", "count", "weight", "epoch")


@query("SELECT a.user_id, a.event_id AS error_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('day', a.ts) = date_trunc('day', b.ts) WHERE a.event_type = 'error' AND b.event_type = 'purchase' AND NOT " + LATE.replace("ts", "a.ts").replace("event_id", "a.event_id") + " AND NOT " + LATE.replace("ts", "b.ts").replace("event_id", "b.event_id"))
def s_join(spark, d):
    """Two streams, joined by user and day."""
    pick = lambda kind, name: _stream(spark, d).filter(F.col("event_type") == kind).select("user_id", "ts", F.col("event_id").alias(name))
    j = streams.join_within(pick("error", "error_id"), pick("purchase", "purchase_id"), ["user_id"], "ts", "10 minutes", "1 day")
    return _collected(j.select("user_id", "error_id", "purchase_id"), "append")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-10 00:00:00'")
def s_late_rows(spark, d):
    """What an input that holds the tenth day would drop."""
    return _collected(streams.late_rows(_stream(spark, d), "ts", F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).select("event_id"), "append")
