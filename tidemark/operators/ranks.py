"""Order statistics without one task for all rows: running sums, ranks and exact quantiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.stage import written

#: Rows of a bracket that are counted value by value; rank error (1 in so many) of the sketches that give brackets, and points that narrow one.
LAST, ACCURACY, STEPS = 4096, 10_000, 1024


def running(df: DataFrame, by: list[Column], order: list[Column], before: dict[str, Column] | None = None, total: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with sums over the rows before each one in its group, ordered ascending, nulls first, and with sums over the whole group.

    ``before`` and ``total`` name the new columns and say what is summed up (``F.lit(1)`` gives places from 0, and counts); null values count as 0. Rows are range-partitioned by group and order, whose splitters
    Spark samples; every range is summed up, the sums of the group's earlier ranges are added (a window over ranges, not rows), and places are counted within a range. Rows that tie in everything are told apart by
    their place in the input, so a group or a value with any share of all rows is dealt to several tasks.

    Null groups are groups. No rows: no rows. ``df`` keeps all its columns whatever their names, but for those that a new column replaces.
    """
    before, total = before or {}, total or {}
    of = {f"v{i}": c for i, c in enumerate([*before.values(), *total.values()])}
    ahead, whole = list(of)[: len(before)], list(of)[len(before) :]
    kept = [c for c in df.columns if c not in (*before, *total)]
    rows = df.select(
        F.struct(*kept).alias("row"),
        F.struct(F.lit(0).alias("g"), *[c.alias(f"g{i}") for i, c in enumerate(by)]).alias("group"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("order"),
        *[F.coalesce(c, F.lit(0)).alias(v) for v, c in of.items()],
    )
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, "group", "order", "tie").withColumn("part", F.spark_partition_id()))
    earlier = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    sums = ranged.groupBy("group", "part").agg(*[F.sum(v).alias(v) for v in of])
    sums = sums.select("group", "part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_start") for v in ahead], *[F.sum(v).over(Window.partitionBy("group")).alias(f"{v}_whole") for v in whole])
    inside = Window.partitionBy("group", "part").orderBy("order", "tie").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(sums, ["group", "part"]).select("row", *[(F.col(f"{v}_start") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(v) for v in ahead], *[F.col(f"{v}_whole").alias(v) for v in whole])
    return out.select("row.*", *[F.col(v).alias(name) for v, name in zip(of, (*before, *total))])


def commonest(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, column): the most frequent known value of each group, ties to the smallest; groups without one are left out.

    Values are counted by group and value first, so no group's counts are gathered as a map, and a group of any share of all rows is counted in several tasks. Rows that are partitioned by ``by`` aren't shuffled again.
    """
    n = df.filter(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_n"))
    return n.groupBy(by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias("_best")).select(by, F.col("_best.v").alias(column))


@dataclass
class _Rank:
    """A rank whose value is looked for: it lies between ``low`` and ``high``, of ``inside`` rows, with ``below`` rows before them."""

    k: int
    low: float
    high: float
    below: int = 0
    inside: int = 0
    value: float | None = None


def quantiles(df: DataFrame, columns: list[str], qs: list[float], by: str | None = None) -> dict[tuple[object, str], list[float | None]]:
    """(group, column) to its exact quantiles, linearly interpolated; None without known values. Without ``by`` the group is None.

    ``df`` is computed once; the passes read only these columns, written. The ranks of all columns are searched together. Sketches of fixed size bracket each rank, the rows below, inside and on the ends of a bracket are counted, ends that hold the rank or can't hold it are
    settled, and the bracket is narrowed until at most ``LAST`` rows are left in it; these are counted value by value. So no state grows with the rows or with their distinct values: three passes for 10^7 rows, about
    seven for 10^11. A sketch that errs only costs a pass, as counts check every bracket. The driver holds a few numbers for each group, so groups are to be few (segments); ranks within many groups are ``running``'s.
    """
    one = F.lit(None).cast("string") if by is None else F.col(by)
    rows = written(df.select(one.alias("g"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    names, spark = range(len(columns)), df.sparkSession
    margin = 2.0 / ACCURACY
    ps = [min(1.0, max(0.0, p)) for q in qs for p in (q - margin, q + margin)]
    first = rows.groupBy("g").agg(*[x for i in names for x in (F.count(f"c{i}").alias(f"n{i}"), F.min(f"c{i}").alias(f"min{i}"), F.max(f"c{i}").alias(f"max{i}"), F.percentile_approx(f"c{i}", ps, ACCURACY).alias(f"s{i}"))])
    stats = {r["g"]: r for r in first.collect()}
    ranks: dict[tuple[object, int, int], _Rank] = {}  # by group, column, place among the ranks
    for g, r in stats.items():
        for i in names:
            for k, q in enumerate(qs if r[f"n{i}"] else []):
                at = (r[f"n{i}"] - 1) * q
                low, high = (r[f"min{i}"] if q <= margin else r[f"s{i}"][2 * k]), (r[f"max{i}"] if q >= 1 - margin else r[f"s{i}"][2 * k + 1])
                ranks[g, i, 2 * k], ranks[g, i, 2 * k + 1] = _Rank(math.floor(at), low, high), _Rank(math.ceil(at), low, high)

    def bracketed(some: dict) -> tuple[DataFrame, list[tuple[int, int]]]:
        """Rows with the brackets of their group (``low_i_k``, ``high_i_k``; null where there is none), and the (column, place) that any group has."""
        cells = sorted({(i, k) for _, i, k in some})
        values = [(g, *[getattr(some[g, i, k], side) if (g, i, k) in some else None for i, k in cells for side in ("low", "high")]) for g in {g for g, _, _ in some}]
        schema = f"bg {rows.schema['g'].dataType.simpleString()}, " + ", ".join(f"{side}_{i}_{k} double" for i, k in cells for side in ("low", "high"))
        return rows.join(spark.createDataFrame(values, schema), F.col("g").eqNullSafe(F.col("bg"))), cells

    def settle() -> None:
        """Count around the brackets of all open ranks, and take their ends or cut them off."""
        table, cells = bracketed(open_)
        figures: list[Column] = []
        for i, k in cells:
            v, low, high = F.col(f"c{i}"), F.col(f"low_{i}_{k}"), F.col(f"high_{i}_{k}")
            figures += [F.count_if(p).alias(f"{n}_{i}_{k}") for n, p in (("below", v < low), ("inside", v.between(low, high)), ("onlow", v == low), ("onhigh", v == high))]
            figures += [F.min(F.when(v > low, v)).alias(f"next_{i}_{k}"), F.max(F.when(v < high, v)).alias(f"prev_{i}_{k}")]
        for r in table.groupBy("g").agg(*figures).collect():
            for i, k in cells:
                t = open_.get((r["g"], i, k))
                if t is None:
                    continue
                below, inside, onlow, onhigh, after, prev = (r[f"{n}_{i}_{k}"] for n in ("below", "inside", "onlow", "onhigh", "next", "prev"))
                if below > t.k:  # the sketch erred
                    t.low, t.high, t.below, t.inside = stats[r["g"]][f"min{i}"], t.low, 0, below
                elif below + inside <= t.k:
                    t.low, t.high, t.below, t.inside = t.high, stats[r["g"]][f"max{i}"], below + inside - onhigh, stats[r["g"]][f"n{i}"] - below - inside + onhigh
                elif t.k < below + onlow:
                    t.value = t.low
                elif t.k >= below + inside - onhigh:
                    t.value = t.high
                else:
                    t.low, t.high, t.below, t.inside = after, prev, below + onlow, inside - onlow - onhigh

    def listed(few: dict) -> None:
        """Take the ranks' values from counts of all values in their brackets."""
        table, cells = bracketed(few)
        inside = lambda i, k: F.when(F.col(f"c{i}").between(F.col(f"low_{i}_{k}"), F.col(f"high_{i}_{k}")), F.col(f"c{i}"))
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), inside(i, k).alias("v")) for i, k in cells]))
        held: dict[tuple[object, int, int], list[tuple[float, int]]] = {}
        for r in table.select("g", each.alias("e")).filter("e.v is not null").groupBy("g", "e.i", "e.k", "e.v").count().collect():  # at most LAST for each rank
            held.setdefault((r["g"], r["i"], r["k"]), []).append((r["v"], r["count"]))
        for key, t in few.items():
            upto = t.below
            for value, n in sorted(held[key]):
                if upto <= t.k < upto + n:
                    t.value = value
                upto += n

    def narrow(many: dict) -> None:
        table, cells = bracketed(many)
        inside = lambda i, k: F.when(F.col(f"c{i}").between(F.col(f"low_{i}_{k}"), F.col(f"high_{i}_{k}")), F.col(f"c{i}"))
        steps = [j / STEPS for j in range(STEPS + 1)]
        for r in table.groupBy("g").agg(*[F.percentile_approx(inside(i, k), steps, ACCURACY).alias(f"s_{i}_{k}") for i, k in cells]).collect():
            for i, k in cells:
                if t := many.get((r["g"], i, k)):
                    j = int((t.k - t.below) / t.inside * STEPS)
                    t.low, t.high = r[f"s_{i}_{k}"][max(0, j - 1)], r[f"s_{i}_{k}"][min(STEPS, j + 2)]

    while open_ := {key: t for key, t in ranks.items() if t.value is None}:
        settle()
        open_ = {key: t for key, t in open_.items() if t.value is None}
        few = {key: t for key, t in open_.items() if t.inside <= LAST}
        if few:
            listed(few)
        if len(few) < len(open_):
            narrow({key: t for key, t in open_.items() if key not in few})

    def mixed(g: object, i: int, k: int, q: float) -> float | None:
        if (g, i, 2 * k) not in ranks:
            return None
        a, b, at = ranks[g, i, 2 * k].value, ranks[g, i, 2 * k + 1].value, (stats[g][f"n{i}"] - 1) * q
        return a if a == b else (math.floor(at) + 1 - at) * a + (at - math.floor(at)) * b

    return {(g, c): [mixed(g, i, k, q) for k, q in enumerate(qs)] for g in stats for i, c in enumerate(columns)}


def median_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The one row of exact medians, as ``median_<column>``."""
    got = quantiles(df, columns, [0.5])
    values = tuple(got.get((None, c), [None])[0] for c in columns)
    return df.sparkSession.createDataFrame([values], ", ".join(f"`median_{c}` double" for c in columns))
