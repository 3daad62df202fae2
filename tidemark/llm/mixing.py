"""Mixing sources to target weights by entropy balancing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import refuse, written

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a cell's range, at least; a thousandth of all rows where that is more.
RANGE_ROWS = 200


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(name, source, source_size, target) from (name, source, source_size).

    Sources by code point, null last, take the weights in turn. Their targets share ``share`` of all sizes; none goes above
    ``most`` times its source's size, and the excess is shared anew by weight. Sorting by (cap / weight) finds that fixed point at once.
    The windows run over one row for each source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("w", F.element_at(F.lit(list(map(float, weights))), (F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most)).withColumn("budget", F.sum("source_size").over(everything) * float(share))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("w"))
    common = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"]
    return ranked.withColumn("common", common).select("name", "source", "source_size", F.when(F.col("free"), F.col("common") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _newton(cells: DataFrame, dual: DataFrame, most: float) -> DataFrame:
    """One Newton step of every source's dual: (name, mean, target, tilt, gap).

    The dual of a source is sum(most * log(1 + exp(tilt * x)) ) - tilt * target, convex in its tilt; its slope is the
    words taken less the target, its curvature the sum of most * p * (1 - p) * size * x.
    """
    x = F.col("size") / F.col("mean")
    p = 1 / (1 + F.exp(-F.col("tilt") * x))
    words = F.col("docs") * F.col("size") * most * p
    sums = cells.join(dual.hint("merge"), "name").groupBy("name", "mean", "target", "tilt").agg(F.sum(words).alias("words"), F.sum(words * (1 - p) * x).alias("slope"))
    step = F.coalesce(F.try_divide(F.col("words") - F.col("target"), F.col("slope")), F.lit(0.0))
    moved = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("tilt") - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))))
    return sums.select("name", "mean", "target", moved.alias("tilt"), (F.abs(F.col("words") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))).alias("gap"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    rounds: int = 12,
    tolerance: float = 1e-6,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """The columns ``also`` and (doc_id, source, size, source_size, target, rate, copies, taken): how often the mix takes every document.

    Rates minimise the (bounded) relative entropy to one copy each under the constraint that each source's expected words equal its target:
    ``rate = most / (1 + exp(-tilt * size / mean size))``, an exponential tilt held within 0 and ``most`` copies. Newton
    iterations over the (source, size) histogram solve for the tilts, four to a job; a source that is further than 0.1 % from its target after all rounds is an error.
    Rates become whole copies by rounding running sums within a source and size class, largest sizes first; what is still missing or over is then made up by cells
    that fit the gap, largest first.

    Null texts have size 0; a null source is a source. A cell's documents stand in the order of a hash of id and text, and the first ones take the copies that don't
    divide evenly, so reruns agree, whatever the table's size; equal rows may get different copies, but the same ones as a set. Cells of over a thousandth of all rows are
    numbered in ranges of that order, which changes no result. No rows: no rows. A column of ``also`` with the name of a result, or of a column that is needed on the way, is an error.
    """
    refuse(also, ("doc_id", "source", "name", "size", "order", "ranges", "range", "before", "place", "docs", "source_size", "target", "rate", "copies", "taken"))
    most_f = float(most)
    name = F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))  # a source's name that is never null, so joins and windows share a shuffle
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    base = written(df.select(*also, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), name.alias("name"), size.alias("size"), F.xxhash64(F.col(doc_id), body).alias("order")))
    rows = base.count()
    cells = written(base.groupBy("name", "source", "size").agg(F.count("*").alias("docs")))

    sizes = cells.groupBy("name", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("n"))
    means = sizes.select("name", (F.greatest(F.col("source_size"), F.lit(1)) / F.col("n")).alias("mean"))
    targets = written(source_targets(sizes.select("name", "source", "source_size"), weights, share, most_f).join(means.hint("merge"), "name"))

    # Sources at their cap take every document as often as they may; the rest have a finite tilt.
    free = F.col("target") < F.col("source_size") * most_f * (1 - 1e-9)
    dual = targets.filter(free & (F.col("target") > 0)).select("name", "mean", "target", F.lit(0.0).alias("tilt"), F.lit(1.0).alias("gap"))
    for _ in range(rounds):
        for _ in range(4):
            dual = _newton(cells, dual, most_f)
        dual = written(dual)
        worst = dual.agg(F.max("gap")).first()[0]
        if worst is None or worst < tolerance:
            break
    if worst is not None and worst > 1e-3:
        raise RuntimeError(f"the mix hasn't converged: a source is {worst:.2%} from its target after {4 * rounds} Newton steps")

    plan = cells.join(targets.drop("source").join(dual.select("name", "tilt").hint("merge"), "name", "left").hint("merge"), "name")
    rate = F.when(F.col("tilt").isNull(), F.when(F.col("target") > 0, most_f).otherwise(0.0)).otherwise(most_f / (1 + F.exp(-F.col("tilt") * F.col("size") / F.col("mean"))))
    plan = plan.withColumn("rate", rate).withColumn("class", F.floor(F.log2(F.col("size") + 1)))
    w = Window.partitionBy("name", "class").orderBy(F.desc("size"))  # over distinct sizes
    rounded = F.floor(F.sum(F.col("docs") * F.col("rate")).over(w) + 0.5)
    copies = F.greatest(F.lit(0), F.least(F.col("docs") * most, rounded - F.coalesce(F.lag(rounded).over(w), F.lit(0))))
    plan = written(plan.withColumn("copies", copies.cast("long")).select("name", "size", "docs", "source_size", "target", "rate", "copies"))
    for _ in range(4):
        plan = written(_closer(plan, most))

    # A document's place in its cell: the rows of the ranges before, and its place within the range.
    range_rows = max(RANGE_ROWS, rows // 1000)  # so at most 1000 cells have ranges
    heavy = cells.filter(F.col("docs") > range_rows).select("name", "size", F.ceil(F.col("docs") / range_rows).alias("ranges"))
    ranged = base.join(F.broadcast(heavy), ["name", "size"], "left")
    unit = F.shiftrightunsigned("order", 1) / F.lit(float(1 << 63))
    ranged = ranged.withColumn("range", F.coalesce(F.least(F.floor(unit * F.col("ranges")), F.col("ranges") - 1), F.lit(0)))
    before = Window.partitionBy("name", "size").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("name", "size", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.join(plan.hint("merge"), ["name", "size"]).drop("n")
    signed = F.shiftrightunsigned("order", 1)
    place = F.row_number().over(Window.partitionBy("name", "size", "range").orderBy(signed, "order", "doc_id")) + F.col("before")
    out = ranged.drop("ranges").join(starts.hint("merge"), ["name", "size", "range"]).withColumn("place", place)
    own = F.expr("copies div docs") + F.when(F.col("place") <= F.expr("copies % docs"), 1).otherwise(0)
    return out.select(*also, "doc_id", "source", "size", "source_size", "target", "rate", own.cast("int").alias("copies"), (own * F.col("size")).cast("long").alias("taken"))


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as its copies say. Rows of one id, text and source share their copies: the first of them, by all columns, comes so often. Columns may have any names."""
    key = F.xxhash64(F.col(text).isNull(), text, F.col(source).isNull(), source)
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(source).alias("source"), key.alias("mix_key"))
    taken = mix(rows, "id", "text", "source", also=("mix_key",), **how).groupBy("doc_id", "mix_key").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    taken = taken.withColumnRenamed("mix_key", "of")
    first = F.row_number().over(Window.partitionBy("id", "mix_key").orderBy(F.xxhash64("row")))
    rows = rows.withColumn("nth", first).filter("nth = 1")
    both = rows.join(taken, rows["id"].eqNullSafe(taken["doc_id"]) & (rows["mix_key"] == taken["of"]))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def _closer(plan: DataFrame, most: int) -> DataFrame:
    """Bring each source's words closer to its target by more or fewer copies in one cell: the one of the largest size that fits the gap."""
    gaps = plan.groupBy("name").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    room = F.when(F.col("gap") > 0, F.col("docs") * most - F.col("copies")).otherwise(F.col("copies"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("gap")) & (room > 0)
    change = F.signum("gap") * F.least(room, F.floor(F.abs("gap") / F.col("size")))
    best = plan.join(gaps.hint("merge"), "name").filter(fits).groupBy("name").agg(F.max(F.struct(F.col("size"), change.cast("long").alias("change"))).alias("best")).select("name", "best.*")
    return plan.join(best.hint("merge"), ["name", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")
