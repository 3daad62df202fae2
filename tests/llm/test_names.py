"""Columns of the input may have any name, or are refused on the driver."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm import langid, media, merkle, mixing, neardup, secrets, sharding

#: Names that operators use on the way.
HIDDEN = (
    "mix_key", "mix_row", "mix_nth", "mix_copies", "mix_copy", "mix_id", "mix_of", "row", "id", "nth", "copy", "copies", "of", "dedup_node", "dedup_row", "dedup_nth", "kept_id", "kept_node", "f", "none", "node", "key", "root", "name", "order", "taken", "rate", "target",
    "scanned_text", "kept_0", "secret_base", "secret_found", "secret_counts", "base", "spans", "lang_pred", "score", "lang_pred_of", "tree", "leaf", "other", "size", "path", "subroot", "part", "range", "place",
)


@pytest.fixture(scope="module")
def named(spark):
    rows = [(i, f"text number {i} has some words of its own {i * 7}", "en", f"s{i % 2}") for i in range(30)] + [(40, "text number 3 has some words of its own 21", "en", "s1"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.concat(F.lit(c), F.lit(" of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in HIDDEN})


def unchanged(rows):
    assert all(r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows for c in HIDDEN)
    return len(rows)


def test_the_mix_keeps_all_columns(named):
    out = mixing.mixed(named)
    assert out.columns == named.columns and unchanged(out.collect()) > 0


def test_deduplication_keeps_all_columns(named):
    out = neardup.deduplicate(named)
    assert out.columns == named.columns and unchanged(out.collect()) == 31


def test_others_ignore_or_refuse(named):
    assert sharding.shard_by_bytes(named).count() == named.count() and mixing.mix(named).count() == named.count()
    assert merkle.manifest(named, ("doc_id", "text")).count() == named.count()
    for call in (
        lambda: mixing.mix(named, also=("taken",)), lambda: mixing.mix(named, also=("size",)), lambda: langid.predict(named, langid.train(named), keep=("lang_pred",)), lambda: langid.predict(named, None, keep=("score",)),
        lambda: media.read_back(media.store_texts(named).withColumn("feature", F.lit(1)), also=("feature",)), lambda: secrets.scan_secrets(named, keep=("spans",)),
    ):
        with pytest.raises(ValueError):
            call()
    kept = tuple(c for c in HIDDEN if c not in ("base", "spans"))
    assert secrets.scan_secrets(named, keep=("doc_id", *kept)).count() == named.count()


SPANS = ArrayType(StructType([StructField(n, IntegerType()) for n in ("start", "kind", "end")]))


def test_redaction_of_many_overlapping_and_no_spans(spark):
    rng = random.Random(5)

    def plain(text, spans):
        if text is None or not spans:
            return text
        out, at = "", 0
        for s, _, e in spans:
            if s >= at:
                out += text[at:s] + "[SECRET]"
            at = max(at, e)
        return out + text[at:]

    cases = [(None, []), (None, [(0, 0, 1)]), ("", []), ("aé日🙂b", [(1, 0, 3)]), ("abcdef", [(0, 0, 2), (1, 1, 4), (4, 0, 5)]), ("ab", [(0, 0, 2)]), ("x", None)]
    for _ in range(60):
        t = "".join(rng.choice("ab é日🙂") for _ in range(rng.randrange(60)))
        cases.append((t, sorted((s := rng.randrange(len(t) + 1), 0, rng.randrange(s, len(t) + 1)) for _ in range(rng.randrange(6)))))
    long = "key é " * 40_000
    cases.append((long, [(6 * i, 0, 6 * i + 4) for i in range(20_000)]))
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(cases)], StructType([StructField("i", IntegerType()), StructField("t", StringType()), StructField("s", SPANS)]))
    got = {r["i"]: r["out"] for r in df.select("i", secrets.redact(F.col("t"), F.col("s")).alias("out")).collect()}
    for i, (t, s) in enumerate(cases):
        assert got[i] == plain(t, s), i
