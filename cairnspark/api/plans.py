"""Ordered plans: running totals, chunks, and greedy batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096  # ids of one stretch


def running(rows: DataFrame, by: list[str], order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """rows with the running total of a value over the rows before, in order of a whole number, for each group.

    Two levels: totals of stretches of the order, summed up over the stretches of a group, then sums within a stretch. No
    task sorts more than a stretch or the list of a group's stretches, however many rows a group has.
    """
    x = rows.withColumn("_v", value).withColumn("_stretch", F.expr(f"`{order}` div {width}"))
    sums = x.groupBy(*by, "_stretch").agg(F.sum("_v").alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*by, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(starts, [*by, "_stretch"]).withColumn(name, F.col("_start") + F.coalesce(F.sum("_v").over(inner), F.lit(0))).drop("_v", "_stretch", "_start")


def chunks(rows: DataFrame, by: list[str], order: str, size: int, name: str = "chunk") -> DataFrame:
    """rows with the number of the chunk of so many rows of its group, in order."""
    return running(rows, by, order, F.lit(1), name).withColumn(name, F.expr(f"{name} div {size}"))


def cuts(sizes: np.ndarray, most: int | None = None, full: int | None = None, limit: int | None = None) -> np.ndarray:
    """Batch numbers of sizes in order. A batch ends once it holds `full` bytes, after `most` items, or before the item that would
    bring it over `limit` bytes (it has one item at least). One step a batch, not an item."""
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    number, at, n = np.zeros(len(sizes), np.int64), 0, 0
    while at < len(sizes):
        end = len(sizes)
        if full is not None:
            end = min(end, int(np.searchsorted(total, total[at] + full)))
        if limit is not None:
            end = min(end, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        if most is not None:
            end = min(end, at + most)
        end = max(end, at + 1)
        number[at:end] = n
        at, n = end, n + 1
    return number


def batches(items: DataFrame, scope: str, order: str, size: str = "size", name: str = "batch_no", **rule) -> DataFrame:
    """(scope, order, batch): greedy batches of each scope's items in order; see `cuts`.

    The rule looks at all that went before, so a scope is one task's: it holds two whole numbers for each item, no more.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame({scope: key[0], order: pdf[order].to_numpy(), name: cuts(pdf[size].to_numpy(np.int64), **rule)})

    kinds = {c: items.schema[c].dataType.simpleString() for c in (scope, order)}
    return items.select(scope, order, size).groupBy(scope).applyInPandas(run, f"{scope} {kinds[scope]}, {order} {kinds[order]}, {name} bigint")


def rotation(items: DataFrame, scope: str, order: str, size: str = "size", target: int = 32 << 30) -> DataFrame:
    """A new pack starts once the one before has reached its target."""
    return batches(items, scope, order, size, "pack_no", full=target)


def packing_plan(items: DataFrame, small: int = 1 << 20, block: int = 64 << 20, target: int = 32 << 30) -> DataFrame:
    """(id, project, member, pack_no): what a transfer of files (id, project, scope, size, sha256) writes, in order of id.

    Of files with one content in a project the first is sent; small ones go to solid blocks of their scope, ended once they are
    full, large ones are members of their own; packs of a project rotate once they have reached their target.
    """
    first = Window.partitionBy("project", "sha256").orderBy("id")
    sent = items.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    few = sent.where(F.col("size") <= small).withColumn("_scope", F.concat_ws("\0", "project", "scope"))
    solid = few.join(batches(few, "_scope", "id", name="_block", full=block), ["_scope", "id"])
    solid = solid.withColumn("member", F.concat(F.lit("solid "), F.col("scope"), F.lit(" "), F.col("_block").cast("string")))
    large = sent.where(F.col("size") > small).withColumn("member", F.concat(F.lit("file "), F.col("id").cast("string")))
    every = solid.select("id", "project", "size", "member").unionByName(large.select("id", "project", "size", "member"))
    members = every.groupBy("project", "member").agg(F.sum("size").alias("size"), F.min("id").alias("first"))
    packs = rotation(members, "project", "first", target=target)
    return every.join(members.select("project", "member", "first"), ["project", "member"]).join(packs, ["project", "first"]).select("id", "project", "member", "pack_no")


def numbered(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in a total order: sorted by ranges, then numbered from the ranges' sizes; no task sorts them all."""
    placed = rows.orderBy(*order).rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1))
    return rows.sparkSession.createDataFrame(placed, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {name} bigint")
