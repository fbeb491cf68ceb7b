"""Chains of steps: parents, depth, layout, memory, transitions, id repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .selection import fresh


def chain(df: DataFrame, task: str, node: str) -> DataFrame:
    """Adds ``parent_id, children, depth, root_id, viz_x, viz_y`` of each task's chain in node order."""
    w = W.partitionBy(task).orderBy(node)
    after, n = F.lead(node).over(w), F.count("*").over(W.partitionBy(task))
    return df.withColumns({
        "parent_id": F.lag(node).over(w),
        "children": F.when(after.isNull(), F.array().cast("array<bigint>")).otherwise(F.array(after.cast("bigint"))),
        "depth": F.row_number().over(w) - 1,
        "root_id": F.first(node).over(w),
        "viz_x": F.lit(0.5),
        "viz_y": F.when(n == 1, 0.5).otherwise(0.08 + 0.84 * F.percent_rank().over(w)),
    })


def edges(df: DataFrame, task: str, node: str) -> DataFrame:
    """Parent and child of each step but the first."""
    return df.select(task, F.lag(node).over(W.partitionBy(task).orderBy(node)).alias("parent_id"), F.col(node).alias("child_id")).filter("parent_id is not null")


def valid_edges(e: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """Edges both of whose ends exist."""
    have = nodes.select(F.col(node).alias("_n")).distinct()
    return e.join(have, e["parent_id"] == have["_n"], "left_semi").join(have, e["child_id"] == have["_n"], "left_semi")


def depth_layout(df: DataFrame, group: str, depth: str, order: str) -> DataFrame:
    """Adds places by depth: x spreads nodes of one depth, y goes down."""
    w = W.partitionBy(group, depth)
    return df.withColumns({"x": F.row_number().over(w.orderBy(order)) / (F.count("*").over(w) + 1), "y": 0.12 + 0.16 * F.col(depth)})


def running_memory(text: Column, task: str, order: str) -> Column:
    """Non-empty texts of all earlier steps, by line."""
    before = W.partitionBy(task).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.array_join(F.collect_list(F.nullif(text, F.lit(""))).over(before), "\n")


def node_type(decision: Column, task: str, order: str) -> Column:
    """A first step, and one after to_redraft, is a draft; another a revision."""
    prior = F.lag(decision).over(W.partitionBy(task).orderBy(order))
    return F.when(prior.isNull() | (prior == "to_redraft"), "draft").otherwise("revise")


def repaired_ids(ids: Column) -> Column:
    """Ids of an ordered list made unique: a missing or used one becomes the next free one."""
    start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(1).cast("bigint").alias("nxt"))

    def step(a: Column, x: Column) -> Column:
        i = F.when(x.isNull() | F.array_contains(a["out"], F.coalesce(x, F.lit(-1))), a["nxt"]).otherwise(x.cast("bigint"))
        return F.struct(F.array_append(a["out"], i).alias("out"), F.greatest(a["nxt"], i + 1).alias("nxt"))

    return F.aggregate(ids, start, step, lambda a: a["out"])


def until_terminal(df: DataFrame, session: str, order: str, terminal: Column) -> DataFrame:
    """Events up to and with the first terminal one of each session."""
    before = W.partitionBy(session).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    done = fresh(df, "_done")
    return df.withColumn(done, F.coalesce(F.max(terminal).over(before), F.lit(False))).filter(~F.col(done)).drop(done)
