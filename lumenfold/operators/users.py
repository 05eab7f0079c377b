"""Users without their credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.schemas import ArchiveError


def page(users: DataFrame, number: int, size: int) -> DataFrame:
    """One page of users by id, each row with the total of all users."""
    if number < 1 or size < 1:
        raise ArchiveError("page and size start at 1")
    total = F.broadcast(users.agg(F.count("*").alias("total")))  # one row
    return users.orderBy("id").offset((number - 1) * size).limit(size).join(total, F.lit(True))


def by_name(users: DataFrame, name: str) -> DataFrame:
    return users.where(F.col("username") == name)


def create(users: DataFrame, new: DataFrame) -> DataFrame:
    """``users`` with the new ones (username) that are not there yet; ids go on from the largest."""
    wanted = new.select("username").where("username <> ''").distinct().join(users.select("username"), "username", "left_anti")
    last = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # Gaps between ids are fine, as after deletions.
    made = wanted.join(F.broadcast(last), F.lit(True)).select(
        (F.col("last") + 1 + F.monotonically_increasing_id()).alias("id"), "username",
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"),
    )
    return users.unionByName(made)
