"""Joins and rankings that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pageloom.operators.tree import exprs

SALTS = 32


def salted_lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join ``rows`` to a table with one row per ``key``, where a key of ``rows`` may be hot.

    The distinct pairs of key and salt fetch the values first: they are found with map-side combining, and no
    key has more than ``salts`` of them. The rows then meet the pairs on one column made of both, so a hot key is
    spread over ``salts`` tasks whatever part of a join's keys the session lets an exchange use. Neither side is
    broadcast and the table is not copied.
    """
    salted = rows.selectExpr("*", f"concat(pmod(xxhash64({spread}), {salts}), '|', {key}) as salted_key")
    pairs = salted.filter(f"{key} is not null").select(key, "salted_key").distinct()
    fetched = pairs.join(table, key).drop(key)
    return salted.join(fetched, "salted_key", "left").drop("salted_key")


def latest_per_key(rows: DataFrame, key: str, order: str, row_id: str, name: str = "is_latest") -> DataFrame:
    """Flag the row with the greatest ``order`` of every key; ties go to the greater id.

    The winner is an aggregate with map-side combining, and it is carried back over the unique ``row_id``.
    A window over ``key`` would sort a hot key in one task.
    """
    winners = (
        rows.groupBy(key)
        .agg(*exprs(f"max(struct({order} as o, {row_id} as winner)).winner as {row_id}"))
        .selectExpr(row_id, f"true as {name}")
    )
    return rows.join(winners, row_id, "left").na.fill({name: False})
