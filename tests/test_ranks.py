"""Ranks, running sums and quantiles against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranks


def test_running_sums_are_those_of_a_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), [None, "a", "b"][int(g)], None if o == 0 else int(o), int(v)) for i, (g, o, v) in enumerate(rng.integers(0, [3, 9, 5], (700, 3)))]
    df = spark.createDataFrame(rows, "row int, group string, order int, part int").withColumn("v0", F.lit(7)).repartition(6)
    got = ranks.running(df, [F.col("group")], [F.col("order"), F.col("row")], {"nth": F.lit(1), "upto": F.col("part")}, {"n": F.lit(1), "all": F.col("part")}).collect()
    assert len(got) == 700 and set(got[0].asDict()) == {"row", "group", "order", "part", "v0", "nth", "upto", "n", "all"}
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        mine = {r["row"]: r for r in got if r["group"] == g}
        for k, r in enumerate(own):
            m = mine[r[0]]
            assert (m["nth"], m["upto"], m["n"], m["all"]) == (k, sum(x[3] for x in own[:k]), len(own), sum(x[3] for x in own))


def test_one_value_in_all_rows_still_lies_in_several_ranges(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit("x").alias("c"))
    got = ranks.running(df, [], [F.col("c")], {"nth": F.lit(1)})
    assert sorted(r["nth"] for r in got.select("nth").collect()) == list(range(4000))
    assert ranks.running(df.limit(0), [], [F.col("c")], {"nth": F.lit(1)}).count() == 0


def plain(values, q):
    v = sorted(x for x in values if x is not None)
    if not v:
        return None
    at = (len(v) - 1) * q
    a, b = v[math.floor(at)], v[math.ceil(at)]
    return a if a == b else (math.floor(at) + 1 - at) * a + (at - math.floor(at)) * b


@pytest.mark.parametrize("last,accuracy,steps", [(4096, 10_000, 1024), (1, 5, 4)])
def test_quantiles_are_exact_however_rough_the_sketches(spark, monkeypatch, last, accuracy, steps):
    for name, value in (("LAST", last), ("ACCURACY", accuracy), ("STEPS", steps)):
        monkeypatch.setattr(ranks, name, value)
    rng = np.random.default_rng(last)
    n = 900
    g = rng.integers(0, 3, n)
    data = {
        "normal": rng.normal(size=n).tolist(), "two": rng.integers(0, 2, n).astype(float).tolist(), "wide": (10.0 ** rng.uniform(-300, 300, n)).tolist(), "tied": np.where(rng.random(n) < 0.4, 5.0, rng.integers(0, 12, n)).tolist(),
        "gaps": [None if x < 0.3 else float(x) for x in rng.random(n)], "none": [None] * n, "negative": (-(10.0 ** rng.uniform(0, 9, n))).tolist(),
    }
    names = list(data)
    df = spark.createDataFrame([(None if g[j] == 2 else f"g{g[j]}", *[data[c][j] for c in names]) for j in range(n)], "grp string, " + ", ".join(f"{c} double" for c in names)).repartition(5)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    whole, parts = ranks.quantiles(df, names, qs), ranks.quantiles(df, names, qs, by="grp")
    for c in names:
        assert whole[None, c] == [plain(data[c], q) for q in qs], c
        for k, name in enumerate(("g0", "g1", None)):
            assert parts[name, c] == [plain([x for x, y in zip(data[c], g) if y == k], q) for q in qs], (c, name)


def test_quantiles_of_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b int")
    assert ranks.quantiles(empty, ["a"], [0.5]) == {(None, "a"): [None]} or ranks.quantiles(empty, ["a"], [0.5]) == {}
    assert tuple(ranks.median_row(empty, ["a", "b"]).first()) == (None, None)


#: A window over one row for each cluster.
OVER_CLUSTERS = {"segment_rank_labels"}
#: Lists of segments and of kinds of events.
SHORT_LISTS = {"config_values", "tool_unknown_segment"}


def test_no_query_ranks_or_sorts_all_rows_in_one_task(spark):
    """A window's input never comes through one partition, and no aggregate keeps all values."""
    import re

    from tidemark.plans import registry

    for name in sorted(registry.ORACLES):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        lines = [re.sub(r"^[\s:+\-*()\d]*", "", x) for x in plan.split("\n")]
        for i, line in enumerate(lines):
            if line.startswith("Window ") and name not in OVER_CLUSTERS:
                below = next((x for x in lines[i + 1 :] if x.startswith(("Exchange", "ShuffleQueryStage", "Window"))), "")
                assert "SinglePartition" not in below, (name, line)
            assert name in SHORT_LISTS or not re.search(r"(?<!_)\b(percentile|median|collect_list|collect_set)\(", line), (name, line)
