"""Manifest, exact top-k and fill-in-middle against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import fim, merkle, threshold

# ---------------------------------------------------------------- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(root, paths): level by level; a path has the siblings and the index among them."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, p in enumerate(paths):
            run, own = runs[at[k] // 3], at[k] % 3
            p.append((run[:own], run[own + 1 :]))
            at[k] //= 3
        nodes = [sha(*r) for r in runs]
    return nodes[0], paths


def expected(rows, columns):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of([r[c] for c in columns]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = tree([x[2] for x in by[s]])
    root, tops = tree([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, leaf, r), path in zip(by[s], trees[s][1]):
            proof = sha("".join("".join(a) + "".join(b) for a, b in path + top))
            out.append((r["doc_id"], s, leaf, trees[s][0], root, proof))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def manifest_rows(df, **how):
    out = merkle.manifest(df, COLUMNS, **how)
    return out.select("doc_id", "source", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof"), (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), "tampered_leaf")


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_is_that_of_brute_force_whatever_a_block_holds(spark, docs, levels):
    rows = docs.unionByName(docs.limit(40).withColumn("source", F.lit(None).cast("string"))).unionByName(docs.limit(1).withColumn("source", F.lit("")))
    got = manifest_rows(rows, levels=levels).collect()
    assert all(r["ok"] and r["tampered_leaf"] is None for r in got)
    assert sorted((tuple(r)[:6] for r in got), key=str) == expected([r.asDict() for r in rows.collect()], COLUMNS)


def test_manifest_of_tricky_rows(tricky, empty):
    got = manifest_rows(tricky).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == expected([r.asDict() for r in tricky.collect()], COLUMNS)
    assert manifest_rows(empty).collect() == []
    alone = manifest_rows(tricky.filter("doc_id = 3")).collect()
    assert len(alone) == 1 and alone[0]["leaf"] == alone[0]["root"] and alone[0]["ok"]


def test_tampering_is_seen_where_it_changes_something(tricky):
    out = merkle.manifest(tricky, COLUMNS, tampered={"text": F.replace("text", F.lit("words"), F.lit("swords"))})
    rows = out.withColumn("ok", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")) == F.col("root")).collect()
    assert {r["doc_id"] for r in rows if not r["ok"]} == {1, 2}
    assert all((r["tampered_leaf"] is None) == r["ok"] for r in rows)


def test_levels_are_collapsed_natively(spark, docs):
    plan = merkle.manifest(docs, COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_paths_are_joined_by_shuffle_and_give_one_row_a_leaf(spark):
    nodes = spark.range(1000).select(F.lit("=a").alias("tree"), F.col("id").alias("nth"), F.lit(1000).cast("long").alias("size"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.col("id").alias("row"))
    rounds = merkle.tree_blocks(nodes)
    top = merkle.roots(rounds).withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    out = merkle.paths(rounds, top)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 1000 and out.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


# ---------------------------------------------------------------- exact top-k


def best(rows, queries, top=5):
    out = []
    for qid in queries:
        q = min(tuple(v) for i, v in rows if i == qid)
        score = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qid and len(v) == len(q))[:top]
        out += [(qid, k + 1, i, -s) for k, (s, i) in enumerate(score)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("kind", ["dense", "sparse", "small"])
def test_products_are_those_of_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(threshold, "SHARD_ROWS", 64)
    monkeypatch.setattr(threshold, "BLOCK_ROWS", 7)
    monkeypatch.setattr(threshold, "GROUP", 2)
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (500, 6))
    if kind == "sparse":
        v[rng.random(v.shape) < 0.8] = 0
    if kind == "small":
        v = v % 3 - 1  # ties everywhere
    v[100:220] = v[100]  # one vector many times
    v[220] = 0
    rows = [(int(i) - 20, v[i].tolist()) for i in range(500)] + [(7, v[3].tolist()), (7, v[4].tolist())]
    got = threshold.largest_products(frame(spark, [(i, [x / 256 for x in e]) for i, e in rows]), F.col("vec_id") % 7 == 0)
    assert sorted(map(tuple, got.collect())) == best(rows, sorted({i for i, _ in rows if i % 7 == 0}))


def test_products_of_odd_vectors(spark):
    big = [2.0**55, -(2.0**55), 3.0]
    rows = [(1, [1.0, 2.0, 3.0]), (2, [None, 1.0, 1.0]), (3, None), (4, []), (5, [float("nan")] * 3), (6, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (8, [1.0, 2.0]), (9, big), (10, [-0.001, 0.001, 0.0])]
    got = threshold.largest_products(frame(spark, rows).withColumns({c: F.lit("x") for c in ("v", "x", "dim", "shard", "block", "score", "rank", "is_query", "times")}), F.lit(True)).collect()
    whole = [(1, [256, 512, 768]), (7, [0, 0, 0]), (8, [256, 512]), (9, [2**63 - 1, -(2**63), 768]), (10, [-1, 0, 0])]
    want = [(q, k, i, max(-(2**63), min(2**63 - 1, s))) for q, k, i, s in best(whole, [1, 7, 8, 9, 10])]
    assert sorted(map(tuple, got)) == want
    assert threshold.largest_products(frame(spark, rows).limit(0), F.lit(True)).collect() == []


def test_threshold_stops_before_all_rows_are_scored():
    rng = np.random.default_rng(1)
    v = (rng.pareto(1.5, (4000, 4)) * 100).astype(np.int64)
    q = v[:20].copy()
    lists = threshold.sorted_lists(np.arange(4000), np.ones(4000, np.int64), v)
    found = [threshold.Best(i, 5) for i in range(20)]
    scored = threshold.visit(lists, q, found)
    assert scored < 0.2 * 20 * 4000
    full = q @ v.T
    for i, b in enumerate(found):
        want = sorted((-int(s), j) for j, s in enumerate(full[i]) if j != i)[:5]
        assert b.rows == want
    again = threshold.visit(threshold.sorted_lists(np.arange(4000, 8000), np.ones(4000, np.int64), v // 4), q, found)
    assert again < scored  # what is known from one shard bounds the next


# ---------------------------------------------------------------- fill-in-middle


def split(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def formed(doc_id, text, seed=7, rate=100, spm=50, marks=fim.SENTINELS):
    text = text or ""
    units = split(text)
    s = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, q, m = marks
    out = q + suf + p + pre + m + mid if h[3] % 100 < spm else p + pre + q + suf + m + mid
    return len(units), "spm" if h[3] % 100 < spm else "psm", len(pre), len(mid), out


pieces = st.lists(st.sampled_from(["<", "P", ">", "<P>", "<S>", "<M", "S", "\n", "\n\n", "a", "é", "日", "🙂", "<<P", " "]), max_size=30).map("".join)


@given(st.lists(pieces, min_size=1, max_size=8), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_automaton_counts_and_cuts_as_the_pattern_does(texts, segment):
    a = fim.automaton()
    raw = [t.encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = fim.counted(a, data, at, segment)
    assert got.units.tolist() == [len(split(t)) for t in texts]
    assert got.chars.tolist() == [len(t) for t in texts]
    assert [x > 0 for x in got.sentinels] == [any(m in t for m in fim.SENTINELS) for t in texts]
    for u in range(int(got.units.max()) + 1):
        want = ["".join(split(t)[:u]) for t in texts]
        byte, char = fim.located(a, data, at, got, np.minimum(u, got.units))
        assert byte.tolist() == [len(w.encode()) for w in want] and char.tolist() == [len(w) for w in want]


def test_overlapping_sentinels_are_recognised():
    a = fim.automaton(("<AB>", "AB", "B><"))
    for text, n in (("<AB>", 2), ("xAB><", 2), ("<A<AB", 1), ("AéB", 0)):
        raw = np.frombuffer(text.encode(), np.uint8)
        assert fim.counted(a, raw, np.array([0, len(raw)])).sentinels.tolist() == [n]
    with pytest.raises(ValueError):
        fim.automaton(("é",))


def test_forms_are_those_of_brute_force_and_texts_come_back(spark, tricky, empty, docs):
    rows = [(i, t) for i, t in enumerate(["a\nb\nc", "<P>x", "a<S\n>b\n", "\n\n\n", "x", "é\n日\n🙂", "<\n<\nS>\n", "no end\n" * 3000])]
    df = tricky.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).unionByName(docs.select("doc_id", "text"))
    for how in ({}, {"rate": 40, "spm": 0, "seed": 1}, {"sentinels": ("<pre>", "<suf>", "<mid>")}):
        marks = how.get("sentinels", fim.SENTINELS)
        out = fim.fill_in_middle(df.withColumn("own", F.col("text")), keep=("own",), **how).withColumn("back", fim.restore(F.col("output"), F.col("form"), marks)).collect()
        assert len(out) == df.count()
        for r in out:
            assert (r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == formed(r["doc_id"], r["own"], **{("marks" if k == "sentinels" else k): v for k, v in how.items()})
            assert r["back"] == (r["own"] or "")
    assert fim.fill_in_middle(empty).collect() == []


def test_kept_columns_may_not_be_named_as_results(tricky):
    for name in ("units", "form", "output", "_h1", "_text"):
        with pytest.raises(ValueError):
            fim.fill_in_middle(tricky.withColumn(name, F.lit(1)), keep=(name,))
    assert fim.fill_in_middle(tricky, keep=("node", "n_bytes")).count() == tricky.count()


def test_crc_parity_in_the_query_is_that_of_the_decimal_id(spark):
    got = spark.range(50).select("id", (F.crc32(F.encode(F.col("id").cast("string"), "UTF-8")) % 2).alias("p")).collect()
    assert all(r["p"] == zlib.crc32(str(r["id"]).encode()) % 2 for r in got)
