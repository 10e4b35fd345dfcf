"""Binding of operator roles to the driver's tables, in one place for Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foretally.roles import Order

PIT = {
    "shipped": "l_shipdate",
    "season": "cast(year(l_shipdate) as int)",
    "month": "cast(month(l_shipdate) as int)",
    "day": "cast(l_shipdate as date)",
    "entity": "l_suppkey",
    "opp": "l_partkey",
    "hand": "l_linestatus",
    "ctx": "l_linenumber",
    "game": "l_orderkey",
    "y": "cast(case when l_returnflag = 'R' then 1 else 0 end as int)",
    "y2": "cast(case when l_returnflag = 'A' then 1 else 0 end as int)",
    "lab": "l_returnflag",
    "qty": "l_quantity",
    "price": "l_extendedprice",
    "disc": "l_discount",
    "tax": "l_tax",
    "tax0": "cast(nullif(cast(l_tax as decimal(4,2)), 0) as double)",
    "cents": "nullif(round(l_tax * 100), 0e0)",
    "p": "0.25e0 + 1.5e0 * l_tax",
    "p2": "0.30e0 + 0.5e0 * l_discount",
}
EV = {
    "event_id": "event_id",
    "ts": "ts",
    "day": "cast(ts as date)",
    "user_id": "user_id",
    "event_type": "event_type",
    "value": "value",
    "y": "cast(case when event_type = 'error' then 1 else 0 end as int)",
    "big": "cast(case when value >= 50 then 1 else 0 end as int)",
}

# The order of pitches inside a group, and of events inside a user.
PIT_ORDER = Order(("day", "game", "ctx", "opp", "entity"))
EV_ORDER = Order(("ts", "event_id"))
PIT_SQL_ORDER = "day, game, ctx, opp, entity"
LAST_SEASON = 2001
# Season predicates on the stored column, so that they reach the scan.
PAST = f"shipped < timestamp_ntz'{LAST_SEASON}-01-01 00:00:00'"
LATEST = (f"shipped >= timestamp_ntz'{LAST_SEASON}-01-01 00:00:00' AND "
          f"shipped < timestamp_ntz'{LAST_SEASON + 1}-01-01 00:00:00'")


def _select(table: str, exprs: dict[str, str]) -> str:
    body = ", ".join(f"{e} AS {n}" for n, e in exprs.items())
    return f"(SELECT {body} FROM {table})"


COMMON_SQL = f"pit AS {_select('lineitem', PIT)},\nev AS {_select('events', EV)}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items in the role of an event log."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in PIT.items()])


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the role of a per-user log."""
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in EV.items()])
