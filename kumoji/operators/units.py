"""Script units: sentences with their block, short ones merged into the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Fixed value: a unit of fewer characters is merged.
SHORT = 12
UNITS = "array<struct<block:int,text:string>>"
SIZED = "array<struct<block:int,text:string,n:int>>"


def plain_length(x: Column) -> Column:
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def combined(units: Column, short: int = SHORT) -> Column:
    """Units in order with their plain lengths n; one joins the last if either is short. The first one's block stays."""

    def step(out: Column, u: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.struct(last["block"].alias("block"), F.concat(last["text"], u["text"]).alias("text"), (last["n"] + u["n"]).alias("n"))
        merge = last.isNotNull() & ((u["n"] < short) | (last["n"] < short))
        return F.when(merge, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(u)))

    sized = F.transform(units, lambda u: F.struct(u["block"].alias("block"), u["text"].alias("text"), plain_length(u["text"]).alias("n")))
    return F.aggregate(sized, F.array().cast(SIZED), step)


def script_units(scripts: DataFrame, key: str = "episode", column: str = "text", terminators: str = text.TERMINATORS) -> DataFrame:
    """(key, unit_index, block, text): lines are blocks, structural ones are counted and left out."""
    lines = F.split(column, "\n+")
    of_line = lambda line, i: F.transform(F.when(text.structural(F.trim(line)), F.array().cast("array<string>")).otherwise(text.sentences(line, terminators)), lambda s: F.struct(i.cast("int").alias("block"), s.alias("text")))
    units = F.filter(combined(F.flatten(F.transform(lines, of_line)).cast(UNITS)), lambda u: u["n"] > 0)
    return scripts.select(key, F.posexplode(units).alias("unit_index", "u")).select(key, "unit_index", "u.block", "u.text")
