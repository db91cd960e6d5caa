"""As-of, interval and neighbour operators over timed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import free_names


def asof_backward(probes: DataFrame, rows: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """probes with the value of the last row of the same key with start <= at; null before the first.

    One shuffle and one sorted window over the union, so no pairs are made. Rows that start together: the largest value.
    """
    kind = dict(rows.dtypes)[value]
    t, side, v = free_names(probes, "__t", "__side", "__v")
    left = probes.withColumns({t: F.col(at), side: F.lit(1), v: F.lit(None).cast(kind)})
    right = rows.groupBy(by, F.col(start).alias(t)).agg(F.max(value).alias(v)).withColumn(side, F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(t, side).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last(v, ignorenulls=True).over(w)).where(F.col(side) == 1).drop(t, side, v)


def overlapping(left: DataFrame, right: DataFrame, by: str, cell: float) -> DataFrame:
    """Pairs of one key whose [start, end] intervals touch; left has l_start, l_end, right r_start, r_end.

    Both sides are dealt to the cells of time that they cover, so a pair meets in a cell; it counts in the first such.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell).cast("bigint"), F.floor(F.col(b) / cell).cast("bigint")))
    pairs = left.withColumn("cell", cells("l_start", "l_end")).join(right.withColumn("cell", cells("r_start", "r_end")), [by, "cell"])
    first = F.floor(F.greatest("l_start", "r_start") / cell).cast("bigint")
    return pairs.where((F.col("l_start") <= F.col("r_end")) & (F.col("r_start") <= F.col("l_end")) & (F.col("cell") == first)).drop("cell")


def spoken_end(start: Column, duration: Column, by: str, order: list[str], tail: float, least: float) -> Column:
    """min(start + duration, next start, or start + tail at the end), at least `least` long."""
    following = F.lead(start).over(Window.partitionBy(by).orderBy(*order))
    return F.greatest(F.least(start + duration, F.coalesce(following, start + tail)), start + least)


def monotonic_violations(rows: DataFrame, by: str, order: list[str], start: str, end: str, slack: float = 0.01) -> DataFrame:
    """Rows that start before the one before them ends."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end") - slack)


def context(rows: DataFrame, by: str, order: str, column: str, size: int = 80) -> DataFrame:
    """rows with the text before them (previous), and the texts behind them until `size` characters are reached.

    Adds following, those texts joined by blanks, and n_following, its length. A null is no text, an empty text is one.
    The frame ahead is bounded by characters: texts are collected for rows that have characters only, of which `size` at
    most are in a frame, and a row takes what the next one of them has. How far the frame reaches is an as-of look-up of
    the running count of characters, and what empty texts add is blanks. So no step holds a run of empty rows, and
    without following the work is in proportion to the rows. Columns of the three new names are replaced, all others kept.
    """
    place, before, upto, nth, key, near, side, at, reach = free_names(rows, "__place", "__before", "__upto", "__nth", "__key", "__near", "__side", "__at", "__reach")
    w = Window.partitionBy(by).orderBy(order)
    length = F.coalesce(F.length(column), F.lit(0)).cast("bigint")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({"previous": F.lag(column).over(w), place: F.row_number().over(w).cast("bigint"), upto: F.sum(length).over(so_far), nth: F.count(column).over(so_far)})
    out = out.withColumn(before, F.col(upto) - length)
    # Rows with characters are apart by one at least; the others get keys of their own, far from one another.
    out = out.withColumn(key, F.when(length > 0, F.col(before)).otherwise(-F.col(place) * (size + 1)))
    texts = F.collect_list(F.when(length > 0, F.struct(F.col(nth).alias("q"), F.col(column).alias("t")))).over(Window.partitionBy(by).orderBy(key).rangeBetween(0, size - 1))
    out = out.withColumn(near, F.when(length > 0, F.array_sort(texts)))
    behind = Window.partitionBy(by).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(near, F.last(near, ignorenulls=True).over(behind))
    # Each row twice: where it begins, and, before rows that begin there, where its frame ends.
    both = out.withColumn(side, F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(at, F.when(F.col(side) == 0, F.col(upto) + size).otherwise(F.col(before)))
    last = F.last(F.when(F.col(side) == 1, F.struct(F.col(upto).alias("u"), F.col(nth).alias("q"))), ignorenulls=True)
    both = both.withColumn(reach, last.over(Window.partitionBy(by).orderBy(at, side, place).rowsBetween(Window.unboundedPreceding, 0))).where(F.col(side) == 0)
    ahead, found = F.col(reach)["q"] - F.col(nth), F.coalesce(near, F.array().cast("array<struct<q:bigint,t:string>>"))
    blanks = lambda n: F.repeat(F.lit(" "), F.greatest(n, F.lit(0)).cast("int"))
    parts = F.transform(found, lambda x, i: F.concat(blanks(x["q"] - F.when(i == 0, F.col(nth) + 1).otherwise(F.get(found, i - 1)["q"])), x["t"]))
    rest = F.when(F.size(found) > 0, F.col(reach)["q"] - F.try_element_at(found, F.lit(-1))["q"]).otherwise(ahead - 1)
    both = both.withColumn("following", F.concat(F.array_join(parts, ""), blanks(rest)))
    n = F.when(ahead > 0, F.col(reach)["u"] - F.col(upto) + ahead - 1).otherwise(0)
    return both.withColumn("n_following", n).drop(place, before, upto, nth, key, near, side, at, reach)


def interpolated(rows: DataFrame, by: str, order: str, value: str, weight: str) -> DataFrame:
    """rows with missing values filled between their known neighbours in proportion to the weights in between."""
    w = Window.partitionBy(by).orderBy(order)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    upto = F.sum(weight).over(before) - F.col(weight)
    w_, a, wa, b, wb = free_names(rows, "__w", "__a", "__wa", "__b", "__wb")
    out = rows.withColumn(w_, upto)
    known = lambda c: F.when(F.col(value).isNotNull(), F.col(c))
    out = out.withColumns({a: F.last(value, True).over(before), wa: F.last(known(w_), True).over(before), b: F.first(value, True).over(after), wb: F.first(known(w_), True).over(after)})
    share = (F.col(w_) - F.col(wa)) / F.nullif(F.col(wb) - F.col(wa), F.lit(0))
    filled = F.coalesce(F.col(value), F.col(a) + (F.col(b) - F.col(a)) * share)
    return out.withColumn("filled", filled).drop(w_, a, wa, b, wb)


def contiguous(rows: DataFrame, by: str, index: str) -> DataFrame:
    """Keys whose indexes aren't 0 to n - 1."""
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("a"), F.max(index).alias("b"))
    return found.where(~((F.col("n") == F.col("d")) & (F.col("a") == 0) & (F.col("b") == F.col("n") - 1)))
