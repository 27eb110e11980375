"""Queries over tracks, kinds and locations made from events and orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions import bits
from tidewright.operators import hierarchy, spans
from tidewright.session import load


def track_keys(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events")
    counters = ev.filter("value > 100").select(F.concat_ws(".", (F.col("user_id") % 20).cast("string"), "event_type").alias("key"))
    events = ev.filter("value <= 400").select(F.concat_ws(".", (F.col("user_id") % 25).cast("string"), "event_type").alias("key"))
    return hierarchy.union_keys(counters, events)


def ranked_kinds(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ranked_kinds(load(spark, d, "events"), ["user_id"], "event_type", ["error"])


def location_tree(spark: SparkSession, d: str) -> DataFrame:
    places = load(spark, d, "customer").select((F.col("c_custkey") % 2).alias("l0"), (F.col("c_custkey") % 3).alias("l1"), (F.col("c_custkey") % 5).alias("l2"), (F.col("c_custkey") % 7).alias("l3"), (F.col("c_custkey") % 11).alias("l4"))
    return hierarchy.location_tree(places, ["l0", "l1", "l2", "l3", "l4"])


def location_rank(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, d, "customer").select("c_custkey", hierarchy.mixed_rank([key % 2, key % 7, key % 31]).alias("rank"), hierarchy.flow_id(1 << 40, key % 4, key * 40_000).alias("flow"))


def address_flows(spark: SparkSession, d: str) -> DataFrame:
    address = F.concat(F.lit("0xF"), F.lpad(F.hex(F.col("event_id") * 7919), 15, "0"))
    return load(spark, d, "events").select("event_id", hierarchy.address_flow(address).alias("flow"))


def complete_ops(spark: SparkSession, d: str) -> DataFrame:
    items = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    return spans.drop_incomplete(items, "l_orderkey", F.col("l_quantity") > 25, F.col("l_returnflag") == "R")[0]


def emptied_tasks(spark: SparkSession, d: str) -> DataFrame:
    return spans.drop_incomplete(load(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") > 25, F.col("l_returnflag") == "R")[1]


def waits_to_done(spark: SparkSession, d: str) -> DataFrame:
    ev = load(spark, d, "events").select("user_id", "event_type", bits.micros(F.col("ts")).alias("ts"))
    return spans.stretch_to_done(ev, ["user_id"], "event_type", "ts", "view", "purchase")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (track_keys, ranked_kinds, location_tree, location_rank, address_flows, complete_ops, emptied_tasks, waits_to_done)}

SQL: dict[str, str] = {
    "track_keys": """
select key, bool_or(c) as is_counter from (select (user_id % 20) || '.' || event_type as key, true as c from events where value > 100
  union all select (user_id % 25) || '.' || event_type, false from events where value <= 400) group by key""",
    "ranked_kinds": "select user_id, event_type, (row_number() over (partition by user_id order by event_type) - 1)::int as rank from (select distinct user_id, event_type from events where event_type <> 'error')",
    "location_tree": """
with p as (select distinct c_custkey % 2 as a, c_custkey % 3 as b, c_custkey % 5 as c, c_custkey % 7 as d, c_custkey % 11 as e from customer),
n as (select distinct 1 as depth, 'l0=' || a as path, null as parent, a as x from p union select distinct 2, 'l0=' || a || '/l1=' || b, 'l0=' || a, b from p
  union select distinct 3, 'l0=' || a || '/l1=' || b || '/l2=' || c, 'l0=' || a || '/l1=' || b, c from p
  union select distinct 4, 'l0=' || a || '/l1=' || b || '/l2=' || c || '/l3=' || d, 'l0=' || a || '/l1=' || b || '/l2=' || c, d from p
  union select distinct 5, 'l0=' || a || '/l1=' || b || '/l2=' || c || '/l3=' || d || '/l4=' || e, 'l0=' || a || '/l1=' || b || '/l2=' || c || '/l3=' || d, e from p)
select depth, path, parent, (row_number() over (partition by depth, parent order by x) - 1)::int as rank from n""",
    "location_rank": "select c_custkey, ((c_custkey % 2) * 32 + c_custkey % 7) * 32 + c_custkey % 31 as rank, case when c_custkey * 40000 < 16777216 then 1099511627776 + (c_custkey % 4) * 16777216 + c_custkey * 40000 end as flow from customer",
    "address_flows": "select event_id, (7::bigint << 60) + event_id * 7919 as flow from events",
    "complete_ops": "select l_orderkey, l_partkey, l_quantity, l_returnflag from lineitem where l_quantity > 25 or l_returnflag = 'R'",
    "emptied_tasks": "select l_orderkey from lineitem group by l_orderkey having not bool_or(l_quantity > 25 or l_returnflag = 'R')",
    "waits_to_done": """
select user_id, start, greatest(start, coalesce(done, start)) as "end" from (select user_id, min(case when event_type = 'view' then epoch_us(ts) end) as start, min(case when event_type = 'purchase' then epoch_us(ts) end) as done from events group by user_id) where start is not null""",
}
