"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its target of words is
its share of the mix, stopped at a multiple of the source's size (the excess goes to the others by weight).
A source's documents stand in a fixed shuffled order, passed through as often as the target asks; a copy of
a document is taken if it begins before the target, and the last copy only with its words up to the target, so a
source's words are its target's whole number. The integral of the schedule says how many of a source's words are
due by a time; its inverse at the middle of a copy's words is the copy's training position, and the stream is
range-sorted by position.

Running sums are found in three steps: sums of hash-ordered ranges of buckets, of buckets, and inside a bucket,
so a source with most of the rows is spread over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Schedules that belong to those weights: relative weight at knots spread evenly over training time.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Words of the mix over words of all documents.
SHARE = 1.5
#: Most words taken from a source over its words.
MOST_PASSES = 2
SEED = 20240607
#: What a target may lack to a whole number by rounding.
ROUNDING = 1e-6


def words(text_col: str = "text") -> Column:
    """Runs of bytes other than space and the controls tab to carriage return; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def first_words(text_col: str, n: Column) -> Column:
    """A text's first n words as they stand, without what is before the first."""
    return F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1)), F.lit(1), n.cast("int")), "")


def share_out(sizes: Sequence[int], weights: Sequence[float], total: float, caps: Sequence[float]) -> list[float]:
    """Targets in proportion to weight, none above its cap, the excess reshared by weight until none is above."""
    out = [0.0] * len(sizes)
    open_ = [k for k in range(len(sizes)) if weights[k] > 0]
    left = total
    while open_:
        unit = left / sum(weights[k] for k in open_)
        over = [k for k in open_ if unit * weights[k] > caps[k]]
        if not over:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in over:
            out[k] = float(caps[k])
            left -= caps[k]
        open_ = [k for k in open_ if k not in set(over)]
    return out


@dataclass(frozen=True)
class Plan:
    """For each source: key, words, target, and knots of its schedule."""

    sources: tuple[tuple[str, int, float, tuple[float, ...]], ...]


def _key(source_col: str) -> Column:
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def _order(id_col: str, seed: int) -> Column:
    """The shuffled order of a source's documents: MD5 of seed and identifier, as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))


def _bucket(order: Column, bits: int) -> Column:
    """Buckets that follow the order: its first ``bits`` bits."""
    return F.shiftright(F.conv(F.left(order, F.lit(8)), 16, 10).cast("long"), 32 - bits)


def plan(sized: DataFrame, weights: Sequence[float], schedules: Sequence[Sequence[float]], share: float, most_passes: int) -> Plan:
    """The driver gets one row for each source."""
    rows = sized.groupBy("__s").agg(F.sum("size").alias("size")).collect()
    # code point order with null last: UTF-8 bytes of the name, and the key says which is null
    rows.sort(key=lambda r: (r["__s"][0] == "n", r["__s"].encode("utf-8", "surrogatepass")))
    sizes = [int(r["size"]) for r in rows]
    w = [float(weights[k % len(weights)]) for k in range(len(rows))]
    targets = share_out(sizes, w, share * sum(sizes), [most_passes * n for n in sizes])
    return Plan(tuple((r["__s"], n, t, tuple(schedules[k % len(schedules)])) for k, (r, n, t) in enumerate(zip(rows, sizes, targets))))


def position(share_col: Column, knots: Sequence[float]) -> Column:
    """The time by which a share of a source's words is due: the inverse of its schedule's normed integral."""
    m = len(knots) - 1
    if m < 1 or min(knots) < 0 or max(knots) <= 0:
        raise ValueError("a schedule needs two knots at least, none negative and one positive")
    areas = [(a + b) / 2 / m for a, b in zip(knots, knots[1:])]
    whole, before = sum(areas), 0.0
    out: Column | None = None
    due = share_col * F.lit(whole)
    for k, (a, b) in enumerate(zip(knots, knots[1:])):
        if areas[k] == 0:
            continue
        rest = F.greatest(due - F.lit(before), F.lit(0.0))
        slope = (b - a) * m
        ahead = rest / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
        here = F.lit(k / m) + F.least(ahead, F.lit(1 / m))
        before += areas[k]
        last = not any(areas[k + 1 :])
        out = F.when(due <= F.lit(before), here) if out is None else out if last else out.when(due <= F.lit(before), here)
        if last:
            return here if out is None else out.otherwise(here)
    raise AssertionError("a positive schedule has a last segment")


def _inverse(knots: Sequence[float]):
    return lambda x: position(x / F.col("target"), knots)


def assign(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    schedules: Sequence[Sequence[float]] = SCHEDULES,
    share: float = SHARE,
    most_passes: int = MOST_PASSES,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``keep`` columns (all, if None) and size, source_size, target, taken, positions and words (one for each copy taken).

    Null texts and texts of white space have size 0 and taken 0. A null source is a source of its own, the
    last. Rows with one identifier are told apart by size and text; equal rows are interchangeable. The
    order depends on the identifiers and ``seed`` alone, so reruns agree whatever the partitions. An empty
    table gives no rows. Columns of ``docs`` named like those that are added are replaced.
    """
    added = ("size", "source_size", "target", "taken", "positions", "words")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    if docs.isEmpty():
        return docs.select(*keep).withColumns({"size": F.lit(0).cast("long"), "source_size": F.lit(0).cast("long"), "target": F.lit(0.0), "taken": F.lit(0).cast("long"), "positions": F.array().cast("array<double>"), "words": F.array().cast("array<bigint>")})
    bits = max(4, min(32, math.ceil(math.log2(8 * parts_for(docs, 16.0, least=int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))))
    sized = docs.select(
        *[F.col(c) for c in keep],
        _key(source_col).alias("__s"),
        words(text_col).alias("size"),
        _order(id_col, seed).alias("__h"),
        F.xxhash64(F.col(text_col)).alias("__t"),
        F.col(id_col).alias("__id"),
    ).withColumn("__b", _bucket(F.col("__h"), bits))
    slim = docs.select(_key(source_col).alias("__s"), words(text_col).alias("size"), _bucket(_order(id_col, seed), bits).alias("__b"))
    buckets = slim.groupBy("__s", "__b").agg(F.sum("size").alias("size"))
    buckets = cut(buckets)  # read twice, and far smaller than the documents
    mix = plan(buckets, weights, schedules, share, most_passes)
    spark = docs.sparkSession
    sources = spark.createDataFrame([(s, n, t, k % len(schedules)) for k, (s, n, t, _) in enumerate(mix.sources)], "__s string, source_size long, target double, __k int")
    ranged = buckets.withColumn("__c", F.shiftright("__b", bits // 2))
    passed = ranged.groupBy("__s", "__c").agg(F.sum("size").alias("n")).select("__s", "__c", (F.sum("n").over(Window.partitionBy("__s").orderBy("__c")) - F.col("n")).alias("passed"))
    before = F.col("passed") + F.sum("size").over(Window.partitionBy("__s", "__c").orderBy("__b")) - F.col("size")
    offsets = ranged.join(passed, ["__s", "__c"]).select("__s", "__b", before.alias("__before")).join(sources, "__s")
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "__id", "size", "__t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sized.join(offsets, ["__s", "__b"])
    rows = rows.withColumn("__start", F.col("__before") + F.sum("size").over(inside) - F.col("size"))
    rows = rows.withColumn("__whole", F.floor(F.col("target") + F.lit(ROUNDING)).cast("long"))
    starts = F.filter(F.array(*[F.col("__start") + F.lit(e) * F.col("source_size") for e in range(most_passes)]), lambda x: x < F.col("__whole"))
    rows = rows.withColumn("__starts", starts).withColumn("words", F.transform("__starts", lambda x: F.least(F.col("size"), F.col("__whole") - x)))
    rows = rows.withColumn("__middles", F.zip_with("__starts", "words", lambda x, n: x + n / F.lit(2.0)))
    times: Column | None = None
    for k, knots in enumerate(schedules):
        here = F.transform("__middles", _inverse(knots))
        times = F.when(F.col("__k") == k, here) if times is None else times.when(F.col("__k") == k, here)
    return rows.select(*[F.col(c) for c in keep], "size", "source_size", "target", F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x).alias("taken"), times.alias("positions"), "words")


def stream(assigned: DataFrame) -> DataFrame:
    """One row for each copy taken, with position, pass number and its words, range-sorted by position.

    Positions lie in 0 to 1 and demand is spread over them, so equal ranges of position are the partitions.
    """
    n = parts_for(assigned, 16.0, least=int(assigned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    copies = assigned.select("*", F.posexplode(F.arrays_zip("positions", "words")).alias("pass", "__x")).withColumn("position", F.col("__x.positions")).withColumn("words", F.col("__x.words")).drop("positions", "__x")
    return copies.repartitionById(n, F.least(F.floor(F.col("position") * n), F.lit(n - 1)).cast("int")).sortWithinPartitions("position", "pass")
