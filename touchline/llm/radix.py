"""The k greatest rows of each group by radix selection: histograms instead of sorted groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage

#: Bits of a value that one histogram tells apart.
BITS = 10


def _chosen(histogram: DataFrame, need: DataFrame, groups: list, descending: bool) -> DataFrame:
    """(*groups, digit, need, size): the digit at which a group's running count reaches its need, else its last digit.

    histogram(*groups, digit, size) holds a row per digit, so a group's window is as wide as a digit at most.
    need becomes what is still to be taken among the rows of that digit.
    """
    order = F.col("digit").desc() if descending else F.col("digit")
    running = F.sum("size").over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counted = histogram.withColumn("running", running).join(need, groups)
    reached = counted.withColumn("at", F.struct((F.col("running") < F.col("need")).alias("short"), F.when(F.col("running") < F.col("need"), -F.col("running")).otherwise(F.col("running")).alias("by"), "digit", "size", "running"))
    return reached.groupBy(*groups).agg(F.min("at").alias("at"), F.first("need").alias("need")).select(
        *groups, F.col("at.digit").alias("digit"), (F.col("need") - F.col("at.running") + F.col("at.size")).alias("need"), F.col("at.size").alias("size")
    )


def radix_top(rows: DataFrame, groups: list, value: str, item: str, k: int) -> DataFrame:
    """rows with a further column `rank`, from 1 to k in each group: value descending, then item ascending by UTF-8 bytes.

    value is a long of 0 or more, item a string that isn't null; groups are columns without nulls.
    Rows equal in group, value and item are told apart arbitrarily, and at most k of them are ranked.
    Each round counts one digit of the values by partial aggregates; then the rows that tie at the
    k-th value are told apart by the first byte in which a group's least and greatest items differ.
    No group is sorted or gathered: only the k rows that are left are ranked by a window.
    """
    held = staged(rows.select(*groups, F.col(value).alias("_v"), F.col(item).alias("_i")), "radix")
    made = [held]
    greatest = held.agg(F.max("_v")).first()[0]
    state = staged(held.select(*groups).distinct().withColumns({"prefix": F.lit(0).cast("long"), "need": F.lit(k).cast("long"), "size": F.lit(0).cast("long")}), "radix-state")
    made.append(state)
    rounds = 0 if greatest is None else max(1, -(-int(greatest).bit_length() // BITS))
    for i in reversed(range(rounds)):
        shift, top = i * BITS, (i + 1) * BITS
        within = held if top >= 63 or i + 1 == rounds else held.join(state.select(*groups, "prefix"), groups).where(F.shiftright("_v", top) == F.col("prefix"))
        digit = F.shiftright("_v", shift).bitwiseAND((1 << BITS) - 1)
        histogram = within.groupBy(*groups, digit.cast("int").alias("digit")).agg(F.count("*").alias("size"))
        step = _chosen(histogram, state.select(*groups, "need"), groups, descending=True)
        joined = step.join(state.select(*groups, "prefix"), groups)
        state = staged(joined.select(*groups, (F.shiftleft("prefix", BITS) + F.col("digit")).alias("prefix"), "need", "size"), "radix-state")
        made.append(state)
    at = held.join(state, groups)
    taken = [at.where((F.col("_v") > F.col("prefix")) | ((F.col("_v") == F.col("prefix")) & (F.col("size") <= F.col("need")))).select(*groups, "_v", "_i")]
    ties = staged(at.where((F.col("_v") == F.col("prefix")) & (F.col("size") > F.col("need"))).select(*groups, "_v", "_i", "need"), "radix-ties")
    made.append(ties)
    while not ties.isEmpty():
        # The first byte in which items of a group differ; 0 stands for the end of an item, byte b for b + 1.
        ends = ties.groupBy(*groups).agg(F.min("_i").alias("lo"), F.max("_i").alias("hi"), F.first("need").alias("need"))
        lo, hi = F.col("lo").cast("binary"), F.col("hi").cast("binary")
        differ = F.filter(F.sequence(F.lit(1), F.greatest(F.length(lo), F.lit(1))), lambda p: F.substring(lo, p, 1) != F.substring(hi, p, 1))
        place = F.when(F.col("lo") == F.col("hi"), -1).otherwise(F.coalesce(F.get(differ, F.lit(0)), F.length(lo) + 1))
        ends = staged(ends.select(*groups, "need", place.alias("place")), "radix-ends")
        byte = F.substring(F.col("_i").cast("binary"), F.col("place"), 1)
        digit = F.when(F.length(byte) == 0, 0).otherwise(F.conv(F.hex(byte), 16, 10).cast("int") + 1)
        told = ties.drop("need").join(ends, groups).withColumn("digit", F.when(F.col("place") < 0, 0).otherwise(digit))
        step = _chosen(told.groupBy(*groups, "digit").agg(F.count("*").alias("size")), ends.select(*groups, "need"), groups, descending=False)
        step = staged(step.withColumnRenamed("digit", "last"), "radix-step")
        cut = told.drop("need").join(step, groups)
        whole = (F.col("size") <= F.col("need")) | (F.col("place") < 0)
        taken.append(cut.where((F.col("digit") < F.col("last")) | ((F.col("digit") == F.col("last")) & whole)).select(*groups, "_v", "_i"))
        ties = staged(cut.where((F.col("digit") == F.col("last")) & ~whole).select(*groups, "_v", "_i", "need"), "radix-ties")
        made += [ends, step, ties]
    few = staged(reduce(DataFrame.union, taken), "radix-top")
    unstage(*made)
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("_v").desc(), "_i"))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).select(*groups, F.col("_v").alias(value), F.col("_i").alias(item), "rank")
