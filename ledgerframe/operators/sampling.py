"""Folds, samples and bootstrap draws that are keyed by hashes, so that no partitioning changes them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: int, *parts: str | Column) -> Column:
    """A text that orders rows at random: SHA-256 of the seed and the parts."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *((F.col(p) if isinstance(p, str) else p).cast("string") for p in parts)).cast("binary"), 256)


def numbered(df: DataFrame, keys: list[str], seed: int, item: str, to: str = "_i") -> DataFrame:
    """df with `to`, each row's place (from 0) in hash order within its keys.

    A key may hold most rows: its order is cut by the first three hash digits, each cut is numbered by
    itself, and what stands before it is added.
    """
    cut = df.withColumn("_h", draw_key(seed, item)).withColumn("_c", F.substring("_h", 1, 3))
    sizes = cut.groupBy(*keys, "_c").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a key
    offsets = sizes.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.col("_c").alias("_oc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_c").orderBy("_h", item)) - 1)
    same = F.col("_c") == F.col("_oc")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return within.join(offsets, same).select(*df.columns, (F.col("_rn") + F.col("_before")).alias(to))


def grouped_folds(df: DataFrame, group: str, label: str, k: int, seed: int) -> DataFrame:
    """Per group its fold 0..k-1: groups are dealt in hash order within their majority label (ties to the greater)."""
    votes = df.groupBy(group, label).agg(F.count("*").alias("_n"))
    major = votes.groupBy(group).agg(F.max(F.struct("_n", label))[label].alias("stratum"))
    return numbered(major, ["stratum"], seed, group).select(group, "stratum", F.pmod("_i", F.lit(k)).cast("int").alias("fold"))


def _first(df: DataFrame, keys: list[str], order: list[str | Column], cut: Column, n: Column) -> DataFrame:
    """The first n rows of each key by `order`. A key may hold most rows: first the n of each of its cuts are taken, which are many tasks, then of these."""
    inner = Window.partitionBy(*keys, "_cut").orderBy(*order)
    kept = df.withColumn("_cut", cut).withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= n)
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn", "_cut")


def sample_per(df: DataFrame, keys: list[str], item: str, n: int | str, seed: int) -> DataFrame:
    """The first n rows of each key in hash order; n may be a column."""
    hashed = df.withColumn("_h", draw_key(seed, item))
    return _first(hashed, keys, ["_h", item], F.substring("_h", 1, 2), F.col(n) if isinstance(n, str) else F.lit(n)).drop("_h")


def down_sampled(df: DataFrame, label: str, item: str, seed: int) -> DataFrame:
    """As many rows of each label as the rarest has."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return numbered(df, [label], seed, item).crossJoin(F.broadcast(sizes)).where("_i < _least").select(*df.columns)  # one row


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes x n of the class) for each label."""
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    return per.select(label, "n", F.round(F.sum("n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("n")), 12).alias("weight"))


def balanced_match(df: DataFrame, stratum: list[str], label: str, item: str) -> DataFrame:
    """Per stratum the first rows by item of each of the two labels, as many as the rarer label has."""
    sizes = df.groupBy(*stratum).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("per_class"))
    w = Window.partitionBy(*stratum, label).orderBy(item)
    return df.join(sizes, stratum).withColumn("_rn", F.row_number().over(w)).where("_rn <= per_class").drop("_rn")


def diverse(df: DataFrame, cls: str, subtype: str, item: str, n: int, seed: int) -> DataFrame:
    """n rows of each class: one of each subtype first, then others, in hash order."""
    hashed = df.withColumn("_h", draw_key(seed, item)).withColumn("_at", F.struct("_h", item))
    least = hashed.groupBy(F.col(cls).alias("_c"), F.col(subtype).alias("_s")).agg(F.min("_at").alias("_least"))
    met = hashed.join(least, F.col(cls).eqNullSafe(F.col("_c")) & F.col(subtype).eqNullSafe(F.col("_s"))).withColumn("_later", (F.col("_at") != F.col("_least")).cast("int"))
    out = _first(met, [cls], ["_later", "_h", item], F.concat(F.col("_later").cast("string"), F.substring("_h", 1, 2)), F.lit(n))
    return out.select(*(F.col(f"`{c}`") for c in df.columns))


def top_up(df: DataFrame, cls: str, item: str, target: int, seed: int, transforms: int = 9) -> DataFrame:
    """Derivatives that bring each class to `target` rows: sources in hash order, round and round, transforms by turns."""
    ranked = numbered(df.select(cls, item), [cls], seed, item)
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    slots = sizes.where(F.col("_n") < target).select(cls, "_n", F.explode(F.sequence(F.lit(0), F.lit(target - 1) - F.col("_n"))).alias("slot"))
    slots = slots.withColumn("_i", F.pmod("slot", "_n"))
    return slots.join(ranked, [cls, "_i"]).select(cls, item, "slot", F.pmod("slot", F.lit(transforms)).alias("transform"))


def partitions(df: DataFrame, cls: str, item: str, final: int, pool: int, seed: int, transforms: int = 9, strict: bool = True) -> DataFrame:
    """Two sets of `final` and `pool` rows a class: part, the item, its slot and transform (null for an original).

    The final set has all originals first, then derivatives as top_up() makes them; the pool goes on where they end, so
    no derivative is in both while sources and transforms last. A class with more originals than `final` is an error, or if
    not strict keeps them all there; its pool has what is left of both sizes together, none if originals alone fill them.
    """
    if strict and (over := df.groupBy(cls).count().where(F.col("count") > final).limit(1).collect()):
        raise ValueError(f"{over[0][0]}: {over[0][1]} originals for {final} rows")
    ranked = numbered(df.select(cls, item), [cls], seed, item)
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    slots = sizes.where(F.col("_n") < final + pool).select(cls, "_n", F.explode(F.sequence(F.lit(0), F.lit(final + pool - 1) - F.col("_n"))).alias("slot"))
    made = slots.withColumn("_i", F.pmod("slot", "_n")).join(ranked, [cls, "_i"])
    part = F.when(F.col("slot") < F.lit(final) - F.col("_n"), "final").otherwise("pool")
    made = made.select(part.alias("part"), cls, item, F.col("slot").cast("long").alias("slot"), F.pmod("slot", F.lit(transforms)).cast("int").alias("transform"))
    return df.select(F.lit("final").alias("part"), cls, item, F.lit(None).cast("long").alias("slot"), F.lit(None).cast("int").alias("transform")).unionByName(made)


def bootstrap_draws(items: DataFrame, label: str, item: str, replicates: int, seed: int) -> DataFrame:
    """Per replicate, label and slot the item drawn, with replacement within the label; every model shares them."""
    w = Window.partitionBy(label).orderBy(item)
    numbered = items.select(F.col(label), F.col(item), (F.row_number().over(w) - 1).alias("_idx"))
    sizes = items.groupBy(label).agg(F.count("*").alias("_n"))
    slots = sizes.select(label, "_n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("slot"))
    drawn = F.conv(F.substring(draw_key(seed, "replicate", label, "slot"), 1, 15), 16, 10).cast("long")
    return slots.withColumn("_idx", F.pmod(drawn, F.col("_n"))).join(numbered, [label, "_idx"]).select("replicate", label, "slot", item)


#: Fixed values of the draw of bootstrap_cells: a prime, and what its steps multiply by and add.
PRIME = 2147483647
STEPS = (1103515245, 12345679, 48271, 69621, 1043618065, 630360016, 16807)


def drawn(replicate: Column, stratum: Column, slot: Column, n: Column) -> Column:
    """A number below n for a slot of a replicate, by arithmetic modulo a prime that SQL engines agree on. No product is above 2 ** 62."""
    p = F.lit(PRIME).cast("long")
    a, b, c, d, e, f, g = (F.lit(s).cast("long") for s in STEPS)
    x = (((replicate + 1) * a % p + (slot % p) * b % p) % p + (stratum + 1) * c) % p
    x = (x * ((x + d) % p)) % p
    x = (x * e + f) % p
    x = (x * ((x + g) % p)) % p
    x = (x * e + d) % p
    return (x * ((x + f) % p)) % p % n


def bootstrap_cells(df: DataFrame, stratum: str, cells: list[str], replicates: int) -> DataFrame:
    """Stratified bootstrap counts: per replicate, stratum (0 or 1) and cell of 0/1 columns, how often rows of the cell are drawn.

    A stratum's rows are a range in which each cell is one interval, so a draw needs no row: a replicate draws as
    many numbers below the stratum's size as the stratum has rows and counts them by interval. Draws are made and
    counted in one stage; only counts are shuffled. All models share the draws of a replicate.
    """
    code = functools.reduce(lambda x, c: x * 2 + F.col(c), cells, F.lit(0))
    many = 1 << len(cells)
    sizes = df.groupBy(F.col(stratum).cast("long").alias("stratum")).agg(F.count("*").alias("n"), *(F.count_if(code < k + 1).alias(f"_to_{k}") for k in range(many)))
    spark = df.sparkSession
    slots = spark.range(replicates, numPartitions=max(1, min(replicates, spark.sparkContext.defaultParallelism * 4))).select(F.col("id").alias("replicate"))
    slots = slots.join(F.broadcast(sizes)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))  # a row for each stratum
    at = slots.select("replicate", "stratum", drawn(F.col("replicate"), F.col("stratum"), F.col("slot"), F.col("n")).alias("at"), *(f"_to_{k}" for k in range(many)))
    below = at.groupBy("replicate", "stratum").agg(*(F.count_if(F.col("at") < F.col(f"_to_{k}")).alias(f"_n_{k}") for k in range(many)))
    cell = lambda k: F.struct(*(F.lit(k >> (len(cells) - 1 - i) & 1).alias(c) for i, c in enumerate(cells)), (F.col(f"_n_{k}") - (F.col(f"_n_{k - 1}") if k else F.lit(0))).alias("n"))
    return below.select("replicate", F.col("stratum").alias(stratum), F.inline(F.array(*map(cell, range(many)))))


def leaking(rows: DataFrame, fold: str, group: str) -> DataFrame:
    """The groups that have rows in more than one fold, with the number of folds."""
    return rows.groupBy(group).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def balanced(originals: DataFrame, derivatives: DataFrame, label: str, source: str, per_class: int, seed: int) -> DataFrame:
    """originals and as many derivatives of their own sources as bring each label to per_class rows, first by hash.

    Both have the same columns; derivatives of sources that originals lack are left out, so what is held back
    leaks nothing. A label with more originals, or with too few derivatives, is an error.
    """
    mine = derivatives.join(originals.select(F.col(source).alias("_s")).distinct(), F.col(source) == F.col("_s"), "left_semi")
    have = {r[0]: r[1] for r in originals.groupBy(label).count().collect()}  # a row for each label
    more = {r[0]: r[1] for r in mine.groupBy(label).count().collect()}
    for k, n in have.items():
        if not 0 <= per_class - n <= more.get(k, 0):
            raise ValueError(f"label {k}: {per_class} rows asked for, {n} originals and {more.get(k, 0)} derivatives")
    wanted = F.create_map(*(F.lit(x) for k, n in have.items() for x in (k, per_class - n)))
    names = derivatives.columns
    keyed = mine.withColumn("_key", F.xxhash64(*(F.col(f"`{c}`") for c in names)))
    taken = numbered(keyed, [label], seed, "_key").where(F.col("_i") < F.element_at(wanted, F.col(label)))
    return originals.unionByName(taken.select(*(F.col(f"`{c}`") for c in names)))
