"""Long listings as numbered rows, and summaries folded over them level by level.

A group that holds a third of all rows is dealt over range partitions, numbered
there, and shifted by what the partitions before it hold; its summary is made of
blocks, the blocks of their summaries, and so on.  No task and no string ever
holds a whole group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsloom.session import stored

#: Lines one summary is made of; a group with no more is summarised in one go.
BLOCK = 500


def placed(rows: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``pos``, their number within the group in the given order, from 1.

    ``order`` must tell all rows of a group apart, else rows that tie are numbered
    in any order.  A null group is a group.  ``rows`` may have no column ``_task``.
    """
    dealt = stored(rows.repartitionByRange(F.col(group), *order).withColumn("_task", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy(group, "_task").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(group).alias("_group"), F.col("_task").alias("_of"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy(group, "_task").orderBy(*order))
    numbered = dealt.withColumn("_own", own).join(
        offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of")))
    return numbered.withColumn("pos", F.col("_own") + F.col("_offset")).select(*rows.columns, "pos")


def _joined(name: str, separator: str) -> Column:
    packed = F.sort_array(F.collect_list(F.struct("pos", F.coalesce(name, F.lit("")).alias("line"))))
    return F.array_join(F.transform(packed, lambda r: r["line"]), separator)


def folded(lines: DataFrame, group: str, combine: Callable[[Column, Column, Column], Column],
           block: int = BLOCK, separator: str = "\n\n") -> DataFrame:
    """``group, n, line``: one summary per group of ``lines (group, pos, line, plain)``.

    A level joins the lines of ``block`` neighbours and makes one line of them:
    ``combine(group, text, plain)``, where ``plain`` joins the short forms of the
    lines, for the case that a summary can't be made.  The number of levels is
    the logarithm of the largest group; each is written before the next reads it.
    """
    if block < 2:
        raise ValueError("a block has at least two lines")
    most = lines.agg(F.max("pos")).first()[0] or 0
    rows = lines.select(group, F.col("pos").cast("long").alias("pos"), "line", "plain", F.lit(1).cast("long").alias("n"))
    while True:
        place = (F.floor((F.col("pos") - 1) / block) + 1).cast("long")
        blocks = rows.groupBy(group, place.alias("at")).agg(
            F.sum("n").alias("n"), _joined("line", separator).alias("text"), _joined("plain", "\n").alias("plain"))
        line = combine(F.col(group), F.col("text"), F.col("plain"))
        rows = stored(blocks.select(group, F.col("at").alias("pos"), line.alias("line"), "n"), "folded").withColumn(
            "plain", F.col("line"))
        most = -(-most // block)
        if most <= 1:
            return rows.select(group, "n", "line")
