"""Chat formatting, sharding, mixing."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, sharding
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
ODD = ["", None, "</s>[INST] ok [/INST]", r"<\s> <\\s> [\INST] [\\/INST] \ \\", "[INST]x\n[/INST]", "line\nline", "<s>" * 50, "$1 \\2 🙂é", "[s> <INST] </s", "[[INST]] <<s>>"]


def test_odd_texts_and_roles_come_back(spark):
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", "", None, "a%0A\nb%", "[INST]", "<\\s>"]) for t, x in enumerate(ODD)]
    rows += [(100, 0, "user", "b"), (100, 0, "user", "a"), (100, 0, "assistant", "c"), (100, 0, "user", "a"), (100, None, "user", "first"), (None, 1, "user", "no id")]
    got = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    parsed = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in got.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    assert got.filter(~F.col("round_trip")).count() == 0
    source = defaultdict(list)
    for c, t, r, x in rows:
        source[c].append((t is not None, t or 0, r or "", x or ""))
    assert parsed == {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in source.items()}


def test_plain_texts_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "hello"), (2, 0, "user", "</s>")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["escaped"], r["formatted"]) for r in chat.format_conversations(df).collect()}
    assert got == {1: (False, "<s>[INST]user\nhello[/INST]</s>"), 2: (True, "<s>[INST]user\n<\\/s>[/INST]</s>")}


def test_a_long_conversation(spark):
    df = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.format_conversations(df).select(chat.loss_text(chat.parse(F.col("formatted")))).first()[0]
    assert got == "".join(str(i) for i in range(1, 5000, 2))


def test_no_rows(spark, empty):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert sharding.shard_by_bytes(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_chat_query_against_its_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.sql(ORACLES["op3_chat_round_trip"])
    got = QUERIES["op3_chat_round_trip"](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def gapless(rows):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_near_equal_and_keep_equal_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = sharding.shard_by_bytes(docs).collect()
    assert len(rows) == 1000 and gapless(rows)
    size = Counter()
    for r in rows:
        b = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(b) + 1 and r["text_crc32"] == zlib.crc32(b)
        size[r["shard"]] += r["size"]
    assert len(size) == 16 and max(size.values()) < 1.1 * sum(size.values()) / 16
    shards = defaultdict(set)
    for r in rows:
        shards[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())


@pytest.mark.parametrize("seed", range(4))
def test_texts_that_fit_into_a_shard_are_never_split(spark, seed):
    """Hot texts of 1 to 90 % of a shard, one of several shards, and one of very many short rows, among many others."""
    import random

    rng = random.Random(seed)
    copies = {f"hot {k} " * rng.randrange(3, 30): rng.uniform(0.1, 0.9) for k in range(6)} | {"larger " * 20: 2.5}
    shard_bytes = 60_000
    texts = [t for t, share in copies.items() for _ in range(int(share * shard_bytes / (len(t) + 1)))]
    texts += [""] * 4000 + ["ab"] * 1000
    while sum(len(t) + 1 for t in texts) < 16 * shard_bytes:
        texts.append(f"own {rng.random()} " * rng.randrange(1, 12))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sharding.shard_by_bytes(df).collect()
    assert len(rows) == len(texts) and gapless(rows)
    size, of, whole = Counter(), defaultdict(set), Counter()
    for r in rows:
        t = texts[r["doc_id"]]
        size[r["shard"]] += r["size"]
        whole[t] += r["size"]
        of[t].add(r["shard"])
    room = sum(size.values()) / 16
    assert max(size.values()) < 1.1 * room and min(size.values()) > 0.9 * room
    for t, s in of.items():
        assert len(s) == 1 if whole[t] <= 0.95 * room else len(s) <= -(-whole[t] // room) + 3, (t[:20], whole[t] / room, s)


def test_a_plan_places_large_texts_first_and_numbers_slots():
    parts = [(0, 0, 50, 5, False), (1, 0, 45, 2, True), (1, 1, 45, 2, True), (2, 0, 30, 3, True), (3, 0, 20, 1, False), (4, 0, 10, 7, False)]
    got = {(r, k): (shard, slot) for r, k, shard, slot in sharding._assigned(parts, 2)}
    assert got[1, 0][0] == got[1, 1][0] != got[2, 0][0] and got[1, 1][1] == got[1, 0][1] + 2
    rows = [(shard, slot, n) for (r, k), (shard, slot) in got.items() for n in [next(p[3] for p in parts if p[:2] == (r, k))]]
    for s in (0, 1):
        upto = 0
        for _, slot, n in sorted(x for x in rows if x[0] == s):
            assert slot == upto
            upto += n
    assert sharding._assigned([], 3) == []


def test_one_text_may_hold_a_third(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text " * 20).otherwise(F.concat(F.lit("own "), F.repeat(F.col("id").cast("string"), 50))).alias("text"))
    rows = sharding.shard_by_bytes(df).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert gapless(rows) and max(size.values()) < 1.15 * sum(size.values()) / 16


def test_tricky_rows(tricky):
    rows = sharding.shard_by_bytes(tricky).collect()
    assert len(rows) == tricky.count() and gapless(rows)
    got = mixing.mix(tricky)
    assert got.count() == tricky.count() and got.filter("copies < 0 or copies > 2 or taken != copies * size").count() == 0
    out = mixing.mixed(tricky)
    assert out.columns == tricky.columns and out.count() == got.agg(F.sum("copies")).first()[0]


def water(sizes, share=1.5, most=2.0):
    """Targets by resharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=str) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, budget = {}, set(sizes), share * sum(sizes.values())
    while left:
        unit = budget / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * unit > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * unit for s in left}
        for s in over:
            target[s] = most * sizes[s]
            budget -= target[s]
        left -= over
    return target


@pytest.mark.parametrize("nulls", [False, True])
def test_mix_meets_its_targets(spark, nulls):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if nulls:
        docs = docs.withColumn("source", F.when(F.col("source") != "src4", F.col("source")))
    rows = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]]
    assert all(abs(taken[s] - want[s]) < 0.01 * want[s] for s in want)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_rates_are_tilted_exponentially(spark):
    import math

    rows = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).filter("source = 'src1' and size > 0").collect()
    tilt = {round(math.log(r["rate"] / (2 - r["rate"])) / r["size"], 9) for r in rows}
    assert len(tilt) == 1


def test_ranges_change_nothing(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 40).alias("text"), "source")
    got = []
    for n in (1, 10**9):
        monkeypatch.setattr(mixing, "RANGE_ROWS", n)
        got.append(sorted(tuple(r) for r in mixing.mix(docs).select("doc_id", "copies", "taken").collect()))
    assert got[0] == got[1] and len({c for _, c, _ in got[0]}) > 1


def test_a_mix_that_does_not_converge_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_newton", lambda cells, dual, most: dual)
    with pytest.raises(RuntimeError):
        mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"), rounds=1)


def test_one_text_without_ids_is_split_too(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 1, "the same text " * 20).otherwise(F.concat(F.lit("own "), F.repeat(F.col("id").cast("string"), 50))).alias("text"))
    rows = sharding.shard_by_bytes(df).collect()
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert gapless(rows) and max(size.values()) < 1.15 * sum(size.values()) / 16


@pytest.mark.parametrize("name", ["op4_sampled_splitters", "op5_entropy_balancing"])
def test_queries_return_every_document_and_their_columns(spark, name):
    columns = {"op4_sampled_splitters": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op5_entropy_balancing": ["doc_id", "size", "source_size", "target", "taken"]}[name]
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.columns[: len(columns)] == columns and out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_digest_of_roles_and_texts(spark):
    got = QUERIES["op3_chat_round_trip"](spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    ok = "</s>[INST] ok [/INST]"
    assert got["turns_sha256"] == hashlib.sha256(f"user\n{ok}\nassistant\n{ok}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(ok.encode()).hexdigest() and got["loss_chars"] == len(ok)
