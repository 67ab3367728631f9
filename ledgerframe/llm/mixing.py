"""Mixing sources to target weights by a time-varying curriculum (native: DataFrame functions only).

Each source's demand for words varies over training as weight x (start + 2 (1 - start) t), t in 0..1.
The integral of that schedule, a quadratic, gives a source's cumulative demand; inverting it at a
document's place in its source's stream gives the document's training position, one for each pass.

Null texts have size 0; a null source is a source of its own, last in order; rows of size 0 are taken
0 times and have no position. Repeated rows each count. An empty table gives an empty result. Ties of
the stream order (the hash of doc_id) go by doc_id and size; rows alike in both are interchangeable. A very long text
counts with all its words. Extra columns are not read (with_texts() adds those that mix() has no column of that name for).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import stash

WORD = r"[^\x20\x09-\x0D]+"
#: By rank of the source's name, repeating: weight, and the schedule's start (1 is level, 2 falls to 0).
WEIGHTS = (5, 2, 1)
STARTS = (1.5, 1.0, 0.5)
#: No document is taken more often than this.
MOST_PASSES = 3
#: Rows that a bucket of a source's stream has on average; a bucket's running sum is one window.
BUCKET_ROWS = 5000
HASH_BITS = 60


def _pick(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, starts: tuple = STARTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Per source: source_size, target (double), words wanted (long) and the schedule's start.

    sizes: (source, size), pre-aggregated here to a row a source before any window. Targets share the
    sum of all sizes by weight; a source stops at most_passes times its size and the excess is shared
    again. In order of the level at which sources stop, the first source that the remaining level
    doesn't stop fixes the level for all after it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(named) - 1
    per = per.select("source", "source_size", _pick(tuple(map(float, weights)), rank).alias("weight"), _pick(starts, rank).alias("start"))
    per = per.withColumn("cap", F.col("source_size") * F.lit(most_passes))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("place", F.row_number().over(by_level))
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward))
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(Window.partitionBy())
    per = per.withColumn("free", free)
    target = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("cap").cast("double")).otherwise(F.least(F.col("free.level") * F.col("weight"), F.col("cap").cast("double")))
    return per.select("source", "source_size", target.alias("target"), F.round(target).cast("long").alias("wanted"), "start")


def _position(share: Column, start: Column) -> Column:
    """Where the integral of start + 2 (1 - start) t reaches `share`."""
    bend = F.lit(1.0) - start
    root = F.sqrt(F.greatest(start * start + F.lit(4.0) * bend * share, F.lit(0.0)))
    return F.when(bend == 0.0, share).otherwise((root - start) / F.when(bend != 0.0, F.lit(2.0) * bend))


def mix(docs: DataFrame, *, weights: tuple = WEIGHTS, starts: tuple = STARTS, most_passes: int = MOST_PASSES) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken, passes,
    first_position (0..1, when it first comes; null if it is not taken) and positions (when each pass comes; the
    first of them is first_position), range-sorted by the first. schedule() gives the order of all passes.

    A source's stream is its documents in hash order, repeated; the mix takes its first `wanted` words,
    so the document at the end gives only the words still wanted and the source's sum is exact.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = stash(docs.select("doc_id", "source", size.alias("size"), place.alias("place")))
    # rows a bucket, not the data, is fixed: the buckets' width follows the count
    width = (1 << HASH_BITS) // max(1, rows.count() // BUCKET_ROWS) + 1
    rows = rows.withColumn("bucket", F.expr(f"place div {width}L"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(sums, weights, starts, most_passes)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    sums = sums.alias("b").join(targets.alias("t"), F.expr("b.source <=> t.source")).select("b.*", "source_size", "target", "wanted", "start")
    both = rows.alias("r").join(sums.alias("s"), F.expr("r.source <=> s.source AND r.bucket = s.bucket"))
    both = both.select("r.*", "offset", "source_size", "target", "wanted", "start")
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("begin", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole, rest = F.expr("wanted div nullif(source_size, 0)"), F.expr("wanted % nullif(source_size, 0)")
    last = F.least(F.greatest(rest - F.col("begin"), F.lit(0)), F.col("size"))
    taken = F.coalesce(F.col("size") * whole + last, F.lit(0)).cast("long")
    passes = F.when(taken > 0, (whole + (last > 0).cast("long"))).otherwise(F.lit(0)).cast("int")

    def position(before: Column) -> Column:
        share = (F.col("begin") + before * F.col("source_size") + F.col("size") / F.lit(2.0)) / F.col("wanted").cast("double")
        return F.round(F.least(_position(share, F.col("start")), F.lit(1.0)), 9)

    out = both.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        passes.alias("passes"),
        F.when(taken > 0, position(F.lit(0))).alias("first_position"),
        F.when(taken > 0, F.transform(F.sequence(F.lit(0), passes - 1), position)).otherwise(F.array().cast("array<double>")).alias("positions"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def with_texts(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """mix()'s rows with lang and text (and whatever else docs has beside mix()'s own columns), in the same order.

    Rows of docs alike in doc_id, source and size are dealt to the mix's rows by their number, so none is doubled.
    """
    others = [c for c in docs.columns if c not in mixed.columns]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    numbered = lambda df, *ties: df.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(*ties)))
    left = numbered(mixed, F.col("first_position").asc_nulls_last()).alias("m")
    right = numbered(docs.select("doc_id", "source", size.alias("size"), *(F.col(f"`{c}`") for c in others)), F.xxhash64(*(F.col(f"`{c}`") for c in others))).alias("d")
    met = left.join(right, F.expr("m.doc_id <=> d.doc_id AND m.source <=> d.source AND m.size = d.size AND m._k = d._k"))
    out = met.select(*(F.col(f"m.`{c}`") for c in mixed.columns), *(F.col(f"d.`{c}`") for c in others))
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def schedule(mixed: DataFrame) -> DataFrame:
    """Of mix()'s rows, a row per pass: doc_id, source, pass (from 0), words (of that pass) and position, range-sorted by
    the last. This is the order of training; a document's words add up to its taken."""
    each = mixed.select("doc_id", "source", "size", "taken", F.posexplode("positions").alias("pass", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
    return each.select("doc_id", "source", "pass", words.alias("words"), "position").orderBy("position", "doc_id", "pass")


#: DuckDB SQL for mix(), but for its positions, over `documents`.
MIX_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM {docs}),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rk FROM per),
weighed AS (
  SELECT source, source_size, ([5.0, 2.0, 1.0])[rk % 3 + 1]::DOUBLE AS weight, ([1.5, 1.0, 0.5])[rk % 3 + 1]::DOUBLE AS start, source_size * 3 AS cap
  FROM ranked),
levels AS (
  SELECT *, row_number() OVER w AS place,
         (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM weighed WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST)),
free AS (SELECT min(place) AS place, min_by(remaining / weights, place) AS level FROM levels WHERE remaining / weights * weight <= cap),
targets AS (
  SELECT l.source, l.source_size, l.start,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN l.cap::DOUBLE ELSE least(f.level * l.weight, l.cap::DOUBLE) END AS target
  FROM levels l CROSS JOIN free f),
placed AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, round(t.target)::BIGINT AS wanted, t.start,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.place, r.doc_id, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT *, wanted // nullif(source_size, 0) AS whole, least(greatest(wanted % nullif(source_size, 0) - begin_at, 0), size) AS last_words,
         CASE WHEN wanted > 0 THEN (begin_at + size / 2.0::DOUBLE) / wanted::DOUBLE END AS share
  FROM placed)
SELECT doc_id, source, size, source_size, target, coalesce(size * whole + last_words, 0)::BIGINT AS taken,
       CASE WHEN coalesce(size * whole + last_words, 0) > 0 THEN whole + CASE WHEN last_words > 0 THEN 1 ELSE 0 END ELSE 0 END::INTEGER AS passes,
       CASE WHEN coalesce(size * whole + last_words, 0) > 0 THEN round(least(
         CASE WHEN start = 1 THEN share ELSE (sqrt(greatest(start * start + 4 * (1 - start) * share, 0)) - start) / (2 * (1 - start)) END, 1), 9) END AS first_position
FROM cut
"""
