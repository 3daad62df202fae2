"""Queries over the texts of documents: media, secrets, packing, language, language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import fim, langid, lm, media, merkle, packing, secrets
from tidemark.llm.common import read


def op1_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as lossless WebP and read back."""
    return media.read_back(media.store_texts(read(spark, sf_dir, "documents")))


def media_pixel_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixel arrays of all documents' images, as digests."""
    stored = media.store_texts(read(spark, sf_dir, "documents"))
    return media.pixel_arrays(stored, "doc_id").select("doc_id", "image", "width", "height", F.sha2("pixels", 256).alias("pixels_sha256"), "error")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    out = secrets.scan_secrets(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *[secrets.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(secrets.label(F.col("base")), 256).alias("base_sha256"),
        secrets.label(F.col("spans")).alias("spans"),
        secrets.count_kind(F.col("spans"), "random").alias("n_random"),
    )


def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from three quarters of those with a known one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2))
    model = langid.train(docs.filter(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from six sevenths of them."""
    return lm.score(read(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 7, 2))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what becomes of the root where half of them lose their line ends."""
    lines_lost = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0, F.replace("text", F.lit("\n"))).otherwise(F.col("text"))
    out = merkle.manifest(read(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), tampered={"text": lines_lost})
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered_leaf", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Leaves and nodes as rows; a level is a grouping of the one below by position div 3. The CRC is bitwise, over the digits of the id.
OP11_SQL = """
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS crc FROM documents, tbl),
f AS (SELECT doc_id, source, crc, {leaf} AS head, coalesce(strlen(text)::VARCHAR || ':' || text, '-') AS body, coalesce(strlen(replace(text, chr(10), ''))::VARCHAR || ':' || replace(text, chr(10), ''), '-') AS cut FROM d),
l AS (SELECT doc_id, source, sha256(head || body) AS leaf, CASE WHEN crc % 2 = 0 THEN sha256(head || cut) ELSE sha256(head || body) END AS bent,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS nth, count(*) OVER (PARTITION BY source) AS n FROM f),
t(lv, source, nth, n, h) AS (SELECT 0, source, nth, n, leaf FROM l
  UNION ALL SELECT lv + 1, source, nth // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY nth)) FROM t WHERE n > 1 GROUP BY lv, source, nth // 3, n),
s AS (SELECT source, lv AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth, count(*) OVER () AS n FROM t WHERE n = 1),
u(lv, nth, n, h) AS (SELECT 0, nth, n, subroot FROM s
  UNION ALL SELECT lv + 1, nth // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY nth)) FROM u WHERE n > 1 GROUP BY lv, nth // 3, n),
p(doc_id, source, leaf, subroot, k, height, place, up, sib, h) AS (
  SELECT doc_id, l.source, leaf, subroot, 0, height, l.nth, s.nth, '', bent FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT * EXCLUDE (a, b) REPLACE (k + 1 AS k, place // 3 AS place, CASE WHEN k >= height THEN up // 3 ELSE up END AS up, sib || a || b AS sib, sha256(a || h || b) AS h) FROM (
    SELECT p.*, coalesce(string_agg(x.h, '' ORDER BY x.nth) FILTER (x.nth < CASE WHEN k < height THEN place ELSE up END), '') AS a, coalesce(string_agg(x.h, '' ORDER BY x.nth) FILTER (x.nth > CASE WHEN k < height THEN place ELSE up END), '') AS b
    FROM p JOIN (SELECT lv, source, nth, h, true AS low FROM t WHERE n > 1 UNION ALL SELECT lv, NULL, nth, h, false FROM u WHERE n > 1) x
      ON x.low = (k < height) AND x.lv = CASE WHEN k < height THEN k ELSE k - height END AND (NOT x.low OR x.source IS NOT DISTINCT FROM p.source) AND x.nth // 3 = CASE WHEN k < height THEN place ELSE up END // 3
    GROUP BY p.doc_id, p.source, leaf, subroot, k, height, place, up, sib, p.h))
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(sib) AS proof_sha256, h AS folded_root, h = (SELECT h FROM u WHERE n = 1) AS verified
FROM p WHERE k = height + (SELECT max(lv) FROM u)
""".replace("{leaf}", " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in fill-in-middle form, and rebuilt from it."""
    out = fim.fill_in_middle(read(spark, sf_dir, "documents"))
    rebuilt = fim.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(rebuilt, "UTF-8"), 256).alias("restored_sha256"))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, x, u, len(u)::BIGINT AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, x, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""


QUERIES = {"op1_lossless_webp": op1_lossless_webp, "media_pixel_arrays": media_pixel_arrays, "op2_secret_scan": op2_secret_scan, "op8_harmonic_packing": op8_harmonic_packing, "op9_language_id": op9_language_id, "op10_context_tree_weighting": op10_context_tree_weighting, "op11_merkle_manifest": op11_merkle_manifest, "op13_fill_in_middle": op13_fill_in_middle}
ORACLES = {"op11_merkle_manifest": OP11_SQL, "op13_fill_in_middle": OP13_SQL}
