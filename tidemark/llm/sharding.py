"""Shards of near-equal bytes by sampled splitters, in DataFrame functions only."""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

KEY_BITS = 52


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the key: looked up in about two times sqrt(bounds) comparisons."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    top = F.lit(bounds[step - 1 :: step])
    skip = F.size(F.filter(top, lambda b: b <= key)) * step
    rest = F.slice(F.lit(bounds), skip + 1, F.lit(step))
    return skip + F.size(F.filter(rest, lambda b: b <= key))


def _assigned(parts: list[tuple[int, int, int, int, bool]], shards: int) -> list[tuple[int, int, int, int]]:
    """(range, part, shard, first slot) of the parts (range, part, bytes, rows, whether the range is one text); there are a few for each range.

    Texts with a range of their own are placed whole, largest first, into the emptiest shard, where they fit there; the parts of one that fits nowhere are dealt with the others. All others fill what is left of the shards in
    the order of ranges, each by the middle of its bytes.
    """
    total = sum(p[2] for p in parts)
    room = total / shards
    texts: dict[int, list[tuple[int, int, int, int, bool]]] = {}
    for p in parts:
        if p[4]:
            texts.setdefault(p[0], []).append(p)
    filled, shard_of = [0.0] * shards, {}
    for own in sorted(texts.values(), key=lambda ps: (-sum(p[2] for p in ps), ps[0][0])):
        size = sum(p[2] for p in own)
        emptiest = min(range(shards), key=lambda s: (filled[s], s))
        if filled[emptiest] + size <= room * (1 + 1 / 64):
            filled[emptiest] += size
            shard_of |= {(p[0], p[1]): emptiest for p in own}
    rest = sorted(p for p in parts if (p[0], p[1]) not in shard_of)
    left = [max(0.0, room - f) for f in filled]
    scale = sum(p[2] for p in rest) / max(1.0, sum(left))
    ends = [scale * sum(left[: s + 1]) for s in range(shards)]
    upto = 0
    for r, k, size, _, _ in rest:
        shard_of[r, k] = min(shards - 1, bisect.bisect_right(ends, upto + size / 2))
        upto += size
    slots, out = [0] * shards, []
    for r, k, _, rows, _ in sorted(parts):
        out.append((r, k, shard_of[r, k], slots[shard_of[r, k]]))
        slots[shard_of[r, k]] += rows
    return out


def shard_by_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16, ranges_per_shard: int = 32, draws_per_range: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row in one of ``shards`` shards of near-equal bytes.

    The key is a 52-bit hash of the text, so equal texts lie together. A sample of
    ``shards * ranges_per_shard * draws_per_range`` expected draws, weighted by size and by row, gives quantile splitters;
    its size doesn't depend on the input. Every row then goes to a range, all ranges are measured exactly, and overfull ones are
    subdivided: by a second hash of the text, or, if one text alone fills the range, by a hash of the running number (ids may be null or repeated), so that no task numbers a hot text alone. A text that
    fills a range lies whole in one shard, the largest ones first in the emptiest; only where no shard has room for it (it is larger than a shard, or several such texts are in each other's way) do its parts go
    to several. Other ranges fill the rest of the shards in order by their exact bytes, so a shard is off by about one range (1/32 of a shard). Slots number a
    shard's rows without gaps: the rows of the ranges before, plus the place within the range. The plan of at most a few parts for each range is made on the driver.

    A null text has size 1 as an empty one and goes with it. Repeated rows get slots of their own. No rows: no rows.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    base = written(
        df.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(body), 64 - KEY_BITS).alias("key"),
            F.monotonically_increasing_id().alias("nth"),
        )
    )
    ranges = shards * ranges_per_shard
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(1)), F.greatest(F.count("*"), F.lit(1))).first()

    draws = ranges * draws_per_range
    expected = (F.col("size") / F.lit(float(total)) + F.lit(1.0 / rows)) * (draws / 2)
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "key", F.lit(17)), 11) / F.lit(float(1 << 53))
    sample = base.select("key", F.floor(expected + uniform).cast("long").alias("times")).filter("times > 0")
    quantiles = [i / ranges for i in range(1, ranges)]
    found = sample.agg(F.percentile("key", F.lit(quantiles), F.col("times")).alias("q")).first()["q"] or []
    found = [int(x) for x in found]
    hot = {x for x, y in zip(found, found[1:]) if x == y}  # one key fills a range: it gets one of its own
    bounds = sorted(set(found) | {x + 1 for x in hot})

    ranged = base.withColumn("range", _range_of(F.col("key"), bounds))
    full = F.greatest(F.sum("size") * ranges / F.lit(float(total)), F.count("*") * ranges / F.lit(float(rows)))
    measured = ranged.groupBy("range").agg(F.greatest(F.lit(1), F.when(full > 2, F.ceil(full)).otherwise(1)).alias("pieces"), (F.min("key") == F.max("key")).alias("one_key"))
    cut = ranged.join(F.broadcast(measured), "range")  # at most twice as many rows as ranges
    by = F.when(F.col("one_key"), F.xxhash64("nth", F.lit(3))).otherwise(F.xxhash64("key", F.lit(5)))
    cut = cut.withColumn("part", F.pmod(by, F.col("pieces"))).select("doc_id", "size", "text_crc32", "key", "range", "part")

    parts = cut.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).join(measured.select("range", (F.col("one_key") & (F.col("pieces") > 1)).alias("hot")), "range")
    plan = _assigned([(r["range"], r["part"], r["bytes"], r["rows"], r["hot"]) for r in parts.collect()], shards)  # at most twice as many as ranges, and one for each range
    parts = spark.createDataFrame(plan, "range int, part long, shard int, first_slot long")

    place = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id", "text_crc32", "size")) - 1
    return (
        cut.withColumn("place", place)
        .join(F.broadcast(parts), ["range", "part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("place")).cast("long").alias("slot"))
    )
