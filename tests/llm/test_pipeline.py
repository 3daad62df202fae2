"""The pipeline, stage by stage, on a small table."""

import corpus_pipeline
from pyspark.sql import functions as F
from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1], SF)))
        assert kept[-1].columns == list(corpus_pipeline.COLUMNS)
    raw, told, unique, clean, mixed = kept
    assert told.count() >= 0.95 * raw.count() and raw.join(told, "doc_id", "left_anti").filter(F.length(F.regexp_replace("text", r"[^\p{L}]", "")) > 200).count() == 0
    assert unique.select("text").distinct().count() == unique.count() <= told.select("text").distinct().count()
    assert clean.count() == unique.count() and clean.filter(F.col("text").rlike(r"AKIA[A-Z0-9]{16}|\b[0-9a-f]{24,}")).count() == 0
    assert clean.filter("n_chars != length(text)").count() == 0
    assert mixed.groupBy("doc_id").count().filter("count > 2").count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, mixed, SF)
    assert last.filter("start = 0").count() == mixed.count()


def test_tricky_rows_and_no_rows(spark, tricky, empty):
    for rows in (tricky, empty):
        docs = rows.select(*corpus_pipeline.COLUMNS)
        for _, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SF))
        assert (docs.count() == 0) == (rows is empty)


def test_run_against_brute_force(spark, tmp_path, monkeypatch):
    """Large families of edited copies among the documents: every stage's decisions from scratch but for learned scores, and the packed ids of the whole run."""
    import numpy as np
    from tokenizers import Tokenizer

    from tests.llm.test_pair_operators import classes
    from tidemark.llm import langid, mixing, secrets
    from tidemark.llm.common import written

    rng = np.random.default_rng(9)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS)
    first = docs.filter("length(text) > 1500 and lang = 'en'").orderBy("doc_id").first()
    rows = []
    for i in range(60):
        w = first["text"].split(" ")
        for j in rng.choice(len(w), rng.integers(1, 4), replace=False):
            w[j] = f"own{i}x{j}"
        rows.append((10**6 + i, " ".join(w), "en", first["source"], 0))
    rows += [(2 * 10**6, "token = 9f86d081884c7d659a2feaa0c55ad015 " + first["text"][::-1], "en", "own", 0), (3 * 10**6, "12 34", None, "own", 0)]
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))

    model = langid.train(given)
    kept = [(r["doc_id"], r["text"], r["source"]) for r in langid.predict(given, model, keep=corpus_pipeline.COLUMNS).filter("lang_pred != 'und' and score >= 0.4").collect()]
    assert 3 * 10**6 not in {d for d, *_ in kept} and len(kept) >= given.count() - 12
    least = {c[0] for c in classes([(d, t) for d, t, _ in kept])}
    alone = [r for r in kept if r[0] in least]
    assert len(least & set(range(10**6, 10**6 + 60))) == 0

    def blotted(text, spans):
        out, at = [], 0
        for s, e in spans:
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        return "".join(out) + text[at:]

    frame = spark.createDataFrame(alone, "doc_id long, text string, source string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan_secrets(frame).collect()}
    clean = [(d, blotted(t, found[d]), s) for d, t, s in alone]
    assert "9f86d081884c7d65" not in dict((d, t) for d, t, _ in clean)[2 * 10**6]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(clean, frame.schema)).collect()}
    tok = Tokenizer.from_file(__import__("public_tokenizers").path("word_bpe_49k.json"))
    want = {d: copies[d] * (len(tok.encode(t, add_special_tokens=False).ids) + 1) for d, t, _ in clean if copies[d]}

    out = written(corpus_pipeline.run(spark, str(tmp_path))).collect()
    got, used = {}, {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == want
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
