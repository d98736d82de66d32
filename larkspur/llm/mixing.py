"""Mixing sources to target weights along a curriculum.

Each source has a target number of words and a weight schedule over training time. The
integral of the schedule, scaled to the target, is the source's cumulative demand; the
inverse of the demand at the words that come before a document in its source's order is the
time of the document. Its training position is what all sources together have due at that
time, so it is near the number of words before it. The result is range-sorted by position.

Words before a document come from a two-level prefix sum: sums by (source, slice of the
hash order) are combined before the shuffle and accumulated over the few slices; the running
sum inside a slice needs only that slice's rows, so a source of any share is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, fresh, staged

#: Weights by source in code point order, repeating; share of all words to take; copies at most.
WEIGHTS, BUDGET, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Slopes of the linear schedules over time from 0 to 1, repeating like the weights: weight(t) = 1 + slope * (2 t - 1).
SLOPES = (-0.5, 0.0, 0.5)
#: Rows that a slice of the hash order has on average, while there are no more than MOST_SLICES of them; beyond that slices grow.
SLICE_ROWS, MOST_SLICES = 250, 1 << 16


def word_count(text_col: str) -> Column:
    """Number of maximal runs of characters other than ASCII white space; 0 for null."""
    text = F.btrim(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, SPACE))).cast("long")


def water_fill(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight, none above most * size; what exceeds is shared again by weight."""
    target, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    for i in [i for i, n in enumerate(sizes) if n <= 0]:
        target[i] = 0.0
    left = float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = unit * weights[i]
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return target


def targets(sizes: DataFrame, *, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, slopes: Sequence[float] = SLOPES) -> DataFrame:
    """(source, source_size, target, slope) from (source, source_size), in the engine: the water-filling level is a window over sources.

    Sources are ordered by code point, null last. In the order of size / weight, the sources before
    the level are full; the level is fixed by the running sums of their sizes and the later weights.
    """
    def listed(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (F.pmod(F.col("_n"), F.lit(len(values))) + 1).cast("int"))

    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.select("source", "source_size", "_n", listed(weights).alias("_w"), listed(slopes).alias("slope"))
    order = Window.orderBy(F.col("source_size") / F.col("_w"), "_n")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranked = ranked.withColumn("_full", F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0.0)))
    ranked = ranked.withColumn("_open", F.sum(F.when(F.col("source_size") > 0, F.col("_w")).otherwise(0.0)).over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_level", (F.sum("source_size").over(every) * budget - F.col("_full")) / F.nullif(F.col("_open"), F.lit(0.0)))
    # the first source, in that order, that the level does not fill fixes the unit of weight
    unit = F.min(F.when((F.col("_level") * F.col("_w") <= most * F.col("source_size")) & (F.col("source_size") > 0), F.struct(F.col("source_size") / F.col("_w"), "_n", "_level"))).over(every)
    level = unit["_level"]
    return ranked.select("source", "source_size", F.least(F.col("source_size") * most, F.coalesce(level * F.col("_w"), F.col("source_size") * most)).cast("double").alias("target"), "slope")


def arrival(before: Column, target: Column, slope: Column) -> Column:
    """The time in [0, 1] at which a demand of slope `slope` that ends at target reaches `before` words."""
    share = F.least(F.greatest(F.lit(0.0), before / target), F.lit(1.0))
    # the integral of 1 + slope (2 t - 1) is (1 - slope) t + slope t^2
    root = (slope - 1 + F.sqrt(F.greatest((1 - slope) * (1 - slope) + 4 * slope * share, F.lit(0.0)))) / (2 * F.when(slope == 0, F.lit(1.0)).otherwise(slope))
    return F.when(slope == 0, share).otherwise(F.least(F.greatest(F.lit(0.0), root), F.lit(1.0)))


def demanded(time: Column, linear: Column, square: Column) -> Column:
    """Words of all sources that are due at a time: the sums over sources of target (1 - slope) and of target slope are its coefficients."""
    return linear * time + square * time * time


def _hot_hashes(table: DataFrame, sums: DataFrame, keys: list[str], h: str, most: int) -> DataFrame | None:
    """keys and h of the row hashes that more than `most` rows share, and into how many deals of `most` rows they go; None if there are none.

    Only equal rows share a hash, so looking into overfull slices is enough.
    """
    full = sums.where(F.col("rows") > 2 * most).select(*keys)
    if full.isEmpty():
        return None
    inside = table.join(F.broadcast(full), keys, "left_semi")  # at most one in 2 * most rows of the table
    return staged(inside.groupBy(*keys, h).agg(F.count("*").alias("rows")).where(F.col("rows") > most).select(*keys, h, F.ceil(F.col("rows") / most).cast("long").alias("deals")), "equal")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: Sequence[str] = (), most: float = MOST, slice_rows: int = SLICE_ROWS, most_slices: int = MOST_SLICES, **kw) -> tuple[DataFrame, str]:
    """The id and `keep` columns of each row plus a struct (its name is returned too): size, source_size, target, taken, copies.

    Rows of a source stand in the order of a hash of id, text and the kept columns; rows with equal
    hashes are equal and interchangeable. The stream of a source repeats that order up to `most`
    times, the last time in part if `most` is no whole number; the mix takes its first `target` words,
    so the row at the end of the target is taken in part. taken: words taken, repeats counted.
    copies: for each time that the row is taken its number (0 first), the words then taken, and the
    position: the number of words that all sources have due when this copy begins. Null texts have
    size 0 and are not taken; a null source is a source. An empty table gives an empty result. Columns
    of docs may have any names.
    """
    columns = list(dict.fromkeys([id_col, *keep]))
    m, h, k, cut, hot, dealt, at, plan_col = [fresh([*docs.columns], n) for n in ("mix", "row_hash", "source_key", "slice_no", "equal_rows", "deal", "words_before", "plan")]
    hashed = F.shiftrightunsigned(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in dict.fromkeys([id_col, text_col, source_col, *keep]))), 1)
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))
    table = docs.select(*(f"`{c}`" for c in columns), F.struct(F.col(f"`{source_col}`").cast("string").alias("source"), word_count(text_col).alias("size")).alias(m), key.alias(k), hashed.alias(h))
    narrow = staged(table.select(m, k, h), "mix")  # without texts, which are read again at the end
    size = F.col(f"`{m}`.size")
    sizes = narrow.groupBy(F.col(f"`{m}`.source").alias("source")).agg(F.sum(size).cast("double").alias("source_size"), F.count("*").alias("n"))
    plan = staged(targets(sizes.drop("n"), most=most, **kw), "targets")
    most_rows = sizes.agg(F.max("n")).first()[0] or 0
    n_slices = 1 << min(max(0, (most_rows // slice_rows).bit_length()), most_slices.bit_length() - 1)
    slice_no = F.shiftrightunsigned(F.col(h), 64 - n_slices.bit_length()) if n_slices > 1 else F.lit(0).cast("long")
    table, narrow = table.withColumn(cut, slice_no), narrow.withColumn(cut, slice_no)
    counts = staged(narrow.groupBy(k, cut).agg(F.count("*").alias("rows")), "slice_rows")
    equal = _hot_hashes(narrow, counts, [k, cut], h, 4 * max(slice_rows, most_rows // n_slices))
    part = [k, cut, hot, dealt]
    if equal is None:
        table, narrow = (x.withColumn(hot, F.lit(None).cast("long")).withColumn(dealt, F.lit(0).cast("long")) for x in (table, narrow))
    else:  # rows under a hot hash are all equal: they come first in their slice and are dealt to many tasks, for good
        table = table.join(F.broadcast(equal.withColumn(hot, F.col(h))), [k, cut, h], "left")
        table = narrow = staged(table.withColumn(dealt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("deals"))).otherwise(0).cast("long")).drop("deals"), "dealt")
    sums = narrow.groupBy(*part).agg(F.sum(size).alias("words"))
    before = sums.withColumn("start", F.sum("words").over(Window.partitionBy(k).orderBy(cut, F.col(hot).asc_nulls_last(), dealt).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    every = Window.partitionBy()
    goal = plan.select(F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias(k), "source_size", "target", "slope", F.sum(F.col("target") * (1 - F.col("slope"))).over(every).alias("linear"), F.sum(F.col("target") * F.col("slope")).over(every).alias("square"))
    lookup = before.join(goal, k).select(*(F.col(c).alias(f"{c}_of") for c in part), F.struct("start", "source_size", "target", "slope", "linear", "square").alias(plan_col))
    lookup = staged(lookup, "slices")
    # AQE may broadcast lookup, a row for each slice; the window needs its rows in one task, and these are a slice
    order = Window.partitionBy(*part).orderBy(h).rowsBetween(Window.unboundedPreceding, 0)
    rows = table.withColumn(at, F.sum(size).over(order) - size).join(lookup, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in part)))
    of = {n: F.col(f"`{plan_col}`.{n}") for n in ("start", "source_size", "target", "slope", "linear", "square")}
    begin, goal_words = F.col(at) + of["start"], F.floor(of["target"] + 0.5)

    def copy(i: int) -> Column:
        left = F.greatest(F.lit(0), F.least(size, goal_words - begin - of["source_size"].cast("long") * i)).cast("long")
        time = arrival((begin + of["source_size"].cast("long") * i).cast("double"), of["target"], of["slope"])
        return F.when(left > 0, F.struct(F.lit(i).alias("copy"), left.alias("words"), demanded(time, of["linear"], of["square"]).alias("position")))

    copies = F.array_compact(F.array(*(copy(i) for i in range(math.ceil(most)))))
    out = rows.select(*(f"`{c}`" for c in columns), F.struct(size.alias("size"), of["source_size"].cast("long").alias("source_size"), of["target"].alias("target"), copies.alias("copies")).alias(m))
    taken = F.aggregate(F.col(f"`{m}`.copies"), F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return out.withColumn(m, F.col(f"`{m}`").withField("taken", taken)), m


def mixing_report(docs: DataFrame, *, id_col: str = "doc_id", **kw) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, position, repeat_position (of the first two copies); sorted by position, rows not taken last."""
    rows, m = mixed(docs, id_col=id_col, **kw)
    of = F.col(f"`{m}`.copies")
    out = rows.select(F.col(f"`{id_col}`").alias("doc_id"), f"`{m}`.size", f"`{m}`.source_size", f"`{m}`.target", f"`{m}`.taken", F.get(of, 0)["position"].alias("position"), F.get(of, 1)["position"].alias("repeat_position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(docs: DataFrame, **kw) -> DataFrame:
    """A row for each time that a row of docs is taken, with copy, taken (words of this copy) and position, sorted by position."""
    rows, m = mixed(docs, keep=docs.columns, **kw)
    one = fresh([*docs.columns, m], "one")
    each = rows.select(*(f"`{c}`" for c in docs.columns), F.explode(F.col(f"`{m}`.copies")).alias(one))
    names = {n: fresh(docs.columns, n) for n in ("copy", "taken", "position")}
    added = [F.col(f"`{one}`.{of}").alias(names[n]) for n, of in (("copy", "copy"), ("taken", "words"), ("position", "position"))]
    return each.select(*(f"`{c}`" for c in docs.columns), *added).orderBy(f"`{names['position']}`")
