"""Mixing sources to target weights by entropy balancing, DataFrame operations only.

Entropy balancing looks for the document rates w closest to 1, in the sum of
w log w - w over documents, whose tokens meet the target of each source.  With
documents as units its optimum is an exponential tilt by size,
w = exp(multiplier of the source * size), here held at ``limit`` copies.  The
convex dual has one multiplier for each source and no closed form; Newton's
method solves it.  An iteration sums the tilted tokens of every source (the
gradient; also the Hessian, which is diagonal as sources are disjoint) over
the distributed classes of documents of equal source and size, and moves the
multipliers, bisecting where a step would leave the interval known to hold the
solution.

Rates become whole copies in two steps.  Within a source, in order of size,
copies are the steps of the rounded running rate, so every range of sizes is
taken at its rate and the error of a source stays within about one document.
A few corrections then add a copy of one document, remove a copy of another, or
both, whichever comes closest to what is still missing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifolder.llm.runtime import WORD, Workspace, column, numbered, parts_for, unused_name

#: Rows in one block of the running numbers: a source, size or id is never one task's.
_BLOCK = 20_000


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def document_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, size): the number of words of each whole text, 0 for null."""
    return docs.select(column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), _size(text_col).alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target): shares of all words by weight, at most ``limit`` times a source.

    Sources sort by code point, null last, and take the weights in turn.  What
    the limit cuts off is shared again by weight; the end of that is one water
    level t with target = min(limit * source_size, t * weight), found from
    running sums in order of the level at which each source fills up.  Works
    on one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    nth = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(float(limit))
    by_level = Window.orderBy("fills", "nth")
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = per.withColumn("nth", nth).withColumn("weight", weight).withColumn("fills", most / F.col("weight"))
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything))
    ranked = ranked.withColumn("filled", F.coalesce(F.sum(most).over(before), F.lit(0.0)))
    ranked = ranked.withColumn("open", F.sum("weight").over(after))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
    water = F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(everything)
    target = F.least(most, F.coalesce("water", F.lit(0.0)) * F.col("weight"))
    return ranked.withColumn("water", water).select("source", "source_size", "n_docs", target.alias("target"))


def _same_source(left: str, right: str) -> Column:
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def _newton(classes: DataFrame, state: DataFrame, limit: float, tolerance: float) -> DataFrame:
    """One iteration: the dual's gradient and curvature at each multiplier, and where it moves.

    The step is Newton's for the logarithm of the tilted tokens, which a tilt
    moves almost linearly; ``residual`` is that of the multiplier it came from,
    which stays where it is once that is within ``tolerance``.
    """
    at = F.col("m.multiplier") * F.col("c.size")
    words = F.col("c.size") * F.col("c.n")
    kept = ("target", "low", "high", "multiplier")
    sums = classes.alias("c").join(state.alias("m"), _same_source("c", "m")).groupBy("c.source").agg(
        *[F.first(f"m.{name}").alias(name) for name in kept],
        F.sum(words * F.least(F.lit(limit), F.exp(at))).alias("tokens"),
        F.sum(F.when(at < math.log(limit), words * F.col("c.size") * F.exp(at)).otherwise(0.0)).alias("slope"),
    )
    residual = F.abs(F.col("tokens") / F.col("target") - 1)
    low = F.when(F.col("tokens") <= F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
    high = F.when(F.col("tokens") >= F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
    sums = sums.withColumns({"residual": residual, "low": low, "high": high})
    step = F.log(F.col("tokens") / F.col("target")) * F.col("tokens") / F.col("slope")
    stepped = F.col("multiplier") - F.when(F.col("slope") > 0, step)
    inside = (stepped > F.col("low")) & (stepped < F.col("high"))
    moved = F.when(F.col("residual") <= tolerance, F.col("multiplier")).when(inside, stepped).otherwise((F.col("low") + F.col("high")) / 2)
    return sums.select("source", "target", "low", "high", moved.alias("multiplier"), "residual")


def solve_multipliers(classes: DataFrame, targets: DataFrame, ws: Workspace, limit: float = 3.0, turns: int = 120, tolerance: float = 1e-9, together: int = 4) -> DataFrame:
    """(source, target, low, high, multiplier, residual) by Newton iterations on the dual.

    ``classes`` is (source, size, n) with the number of documents of each size
    above 0, a sufficient statistic of the constraints.  A job runs
    ``together`` iterations.  The residual is the share by which the tilted
    tokens miss the target; not reaching ``tolerance`` in ``turns`` iterations
    is an error.  A source of no words has no row.
    """
    ends = classes.groupBy("source").agg(F.min("size").alias("least"), F.sum(F.col("n") * F.col("size") * F.col("size")).alias("squares"))
    begun = targets.where("target > 0").alias("t").join(ends.alias("e"), _same_source("t", "e"))
    ratio = F.log(F.col("t.target") / F.col("t.source_size"))
    low = F.when(ratio < 0, ratio / F.col("e.least")).otherwise(0.0)
    high = F.when(ratio <= 0, 0.0).otherwise(F.lit(math.log(limit)) / F.col("e.least"))
    start = F.when(ratio >= math.log(limit) - 1e-12, high).otherwise(ratio * F.col("t.source_size") / F.col("e.squares"))
    state = begun.select("t.source", "t.target", low.alias("low"), high.alias("high"), F.greatest(low, F.least(high, start)).alias("multiplier"))
    for turn in range(0, turns, together):
        for _ in range(together):
            state = _newton(classes, state, limit, tolerance)
        state = ws.table(state, f"newton{turn}")
        worst = state.agg(F.max("residual")).first()[0]
        if worst is None or worst <= tolerance:
            return state
    raise RuntimeError(f"the dual's residual is {worst} after {turns} iterations")


def _places(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (row, doc_id, source, size) with ``place``, their number from 0 among those of their source and size.

    The order is that of a hash of the id, then of the id; rows alike in all
    of id, source and size come in any order, which nothing depends on.
    Numbers are counted in blocks, so neither a frequent size nor an id that
    many rows share (null, say) meets in one window.
    """
    slots = parts_for(n, _BLOCK)
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(slots))).withColumn("sub", F.pmod(F.xxhash64("row"), F.lit(slots)))
    alike = ("source", "size", "slot", "doc_id", "sub")
    dealt = dealt.withColumn("nth", F.row_number().over(Window.partitionBy(*alike).orderBy("row")) - 1)
    groups = dealt.groupBy(*alike).agg(F.count("*").alias("n"))
    in_cell = Window.partitionBy("source", "size", "slot").orderBy(F.col("doc_id").isNull(), "doc_id", "sub").rowsBetween(Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("source", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = groups.groupBy("source", "size", "slot").agg(F.sum("n").alias("n"))
    cells = cells.select("source", "size", "slot", F.coalesce(F.sum("n").over(in_class), F.lit(0)).alias("cell_base"))
    groups = groups.withColumn("base", F.coalesce(F.sum("n").over(in_cell), F.lit(0)))
    first = groups.alias("g").join(cells.alias("c"), _same_source("g", "c") & (F.col("g.size") == F.col("c.size")) & (F.col("g.slot") == F.col("c.slot")))
    first = first.select(*[F.col(f"g.{name}").alias(name) for name in alike], (F.col("base") + F.col("cell_base")).alias("first"))
    on = _same_source("r", "f") & F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.size") == F.col("f.size")) & (F.col("r.sub") == F.col("f.sub"))
    return dealt.alias("r").join(first.alias("f"), on).select("r.row", "r.doc_id", "r.source", "r.size", (F.col("nth") + F.col("first")).alias("place"))


def _planned(ws: Workspace, sizes: DataFrame, weights: tuple[float, ...], limit: int, corrections: int) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies) for ``sizes`` (row, doc_id, source, size)."""
    targets = ws.table(source_targets(sizes, weights, limit), "targets")
    classes = ws.table(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    solved = solve_multipliers(classes.where("size > 0"), targets, ws, float(limit))
    rated = classes.alias("c").join(targets.alias("t"), _same_source("c", "t")).join(solved.alias("m"), _same_source("c", "m"), "left")
    rate = F.coalesce(F.least(F.lit(float(limit)), F.exp(F.col("m.multiplier") * F.col("c.size"))), F.lit(0.0))
    rated = rated.select("c.source", "c.size", "c.n", "t.source_size", "t.target", F.when(F.col("c.size") > 0, rate).otherwise(0.0).alias("rate"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = rated.withColumn("carry", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(smaller), F.lit(0.0)))
    placed = _places(sizes, sizes.count()).alias("p").join(rated.alias("r"), _same_source("p", "r") & (F.col("p.size") == F.col("r.size")))
    begin = F.col("carry") + F.col("place") * F.col("rate")
    steps = F.floor(begin + F.col("rate") + 0.5) - F.floor(begin + 0.5)
    copies = F.when(F.col("p.size") == 0, 1).otherwise(F.least(F.lit(limit), steps)).cast("int")
    mixed = ws.table(placed.select("p.row", "p.doc_id", "p.source", "p.size", "r.source_size", "r.target", copies.alias("copies")), "mixed")
    return _corrected(mixed, ws, limit, corrections)


def _exchanges(now: DataFrame, missing: DataFrame, limit: int) -> DataFrame:
    """(source, size, change, rest): for each source what brings it nearest to its target.

    That is a copy more of one size, a copy less of another, or both; found by
    sorting what could be added among what could be removed plus the miss, on
    one row for each source and size.  Sources that nothing brings nearer have
    no row.
    """
    sizes = now.where("size > 0").groupBy("source", "size").agg((F.min("copies") < limit).alias("more"), (F.max("copies") > 0).alias("less"))
    nothing = missing.select("source", F.lit(0).cast("long").alias("size"), F.lit(True).alias("more"), F.lit(True).alias("less"))
    each = sizes.unionByName(nothing).alias("s").join(missing.where("miss <> 0").alias("m"), _same_source("s", "m"))
    added = each.where("more").select("s.source", "miss", F.col("size").alias("at"), F.col("size").alias("add"), F.lit(None).cast("long").alias("take"))
    taken = each.where("less").select("s.source", "miss", (F.col("size") + F.col("miss")).alias("at"), F.lit(None).cast("long").alias("add"), F.col("size").alias("take"))
    order = Window.partitionBy("source").orderBy("at", "add", "take")
    below = F.last("add", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    above = F.first("add", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sides = added.unionByName(taken).select("source", "miss", "at", "take", F.array(below, above).alias("sides")).where("take is not null")
    met = sides.select("source", "miss", "at", "take", F.explode("sides").alias("add")).where("add is not null")
    rest = F.abs(F.col("at") - F.col("add"))
    both = (F.col("add") > 0) & (F.col("take") > 0)
    best = met.where(rest < F.abs("miss")).groupBy("source").agg(F.min(F.struct(rest.alias("rest"), both.alias("both"), "add", "take", "miss")).alias("b"))
    changes = F.explode(F.array(F.struct(F.col("b.add").alias("size"), F.lit(1).alias("change")), F.struct(F.col("b.take").alias("size"), F.lit(-1).alias("change"))))
    left = F.col("b.miss") - F.col("b.add") + F.col("b.take")
    return best.select("source", left.alias("rest"), changes.alias("c")).select("source", "c.size", "c.change", "rest").where("size > 0")


def _corrected(mixed: DataFrame, ws: Workspace, limit: int, turns: int) -> DataFrame:
    """Single copies added, removed or both until nothing brings a source nearer to its target, or ``turns`` are over.

    A turn changes at most two rows of a source: of those of the chosen size,
    the ones of the smallest id.
    """
    by_source = mixed.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("size") * F.col("copies")).alias("taken"))
    missing = ws.table(by_source.select("source", F.round(F.col("target") - F.col("taken")).cast("long").alias("miss")), "missing0")
    changes: DataFrame | None = None
    for turn in range(1, turns + 1):
        now = _changed(mixed, changes)
        chosen = _exchanges(now, missing, limit)
        fits = F.when(F.col("c.change") > 0, F.col("d.copies") < limit).otherwise(F.col("d.copies") > 0)
        rows = now.alias("d").join(chosen.alias("c"), _same_source("d", "c") & (F.col("d.size") == F.col("c.size"))).where(fits)
        place = F.struct(F.col("d.doc_id").isNull().alias("none"), F.col("d.doc_id").alias("doc_id"), F.col("d.row").alias("row"))
        found = rows.groupBy("c.source", "c.change").agg(F.min(place).alias("p"), F.first("c.rest").alias("rest"))
        found = ws.table(found.select("source", "p.row", "change", "rest"), f"change{turn}")
        if turn == turns or found.isEmpty():
            changes = found if changes is None else changes.unionByName(found)
            break
        changes = found if changes is None else changes.unionByName(found)
        moved = missing.alias("m").join(found.groupBy("source").agg(F.first("rest").alias("rest")).alias("f"), _same_source("m", "f"), "left")
        missing = moved.select("m.source", F.coalesce("f.rest", "m.miss").alias("miss"))
    return _changed(mixed, changes)


def _changed(mixed: DataFrame, changes: DataFrame | None) -> DataFrame:
    if changes is None:
        return mixed
    joined = mixed.join(changes.groupBy("row").agg(F.sum("change").cast("int").alias("change")), "row", "left")
    return joined.withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, corrections: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every row of ``docs``.

    size is the number of words of the whole text (null: 0).  A copy of a
    document counts its size; no document gets more than ``limit`` copies.
    Documents of size 0 keep one copy, which takes no words.  A null source
    is a source of its own.  Rows that repeat an id, or have none, are
    documents of their own; which of those alike in id, source and size get
    which copies is all the same for the result.  An empty table gives an
    empty result, other columns are not read.  Reruns agree: nothing depends
    on partitions or random numbers.
    """
    ws = Workspace(spark, "mix")
    sizes = document_sizes(docs, id_col, text_col, source_col).withColumn("row", F.monotonically_increasing_id())
    sizes = ws.table(sizes, "sizes")  # written once, so that a row keeps its number
    return _planned(ws, sizes, weights, limit, corrections).drop("row")


def mixed_documents(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), limit: int = 3, corrections: int = 4, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; all columns are passed on, whatever their names.

    Rows and their copies are matched by what tells apart even equal rows, so null and repeated ids, texts and whole rows are no matter.  Null
    and empty texts have size 0 and stay once; an empty table stays empty.
    """
    ws = Workspace(spark, "mixed")
    whole, row = numbered(ws, docs)
    sizes = whole.select(column(row).alias("row"), column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), _size(text_col).alias("size"))
    sizes = ws.table(sizes, "sizes")
    plan = _planned(ws, sizes, weights, limit, corrections).where("copies > 0")
    times, nth = unused_name(whole, "times"), unused_name(whole, "nth")
    joined = whole.join(plan.select(F.col("row").alias(row), F.col("copies").alias(times)), row)
    repeated = joined.withColumn(nth, F.explode(F.sequence(F.lit(1), column(times))))
    return repeated.select(*[column(c) for c in docs.columns])
