"""Benchmark decontamination by spaced seeds (native: DataFrame functions only).

Texts are runs of letters and digits, lower-cased. A fixed mask over a window of tokens keeps some
positions and ignores the others; the kept ones are hashed, at each position of the benchmark's items
and of the documents. Equal hashes are hits: they give a document, an item and how they are aligned.
Along each alignment the tokens are compared one by one, and a document leaks an item if WINDOW
aligned tokens in a row (or all of a shorter item) agree in at least AGREE of their places. The masks are
chosen, by enumeration, so that each such run has a hit wherever its substitutions stand.

Null and empty texts have no tokens and no leaks. Items of fewer than LEAST tokens are too short to
tell and match nothing; those shorter than WINDOW have masks by their length. Repeated rows of a
document or an item are one. A document is told by doc_id and text, so null or repeated ids don't
mix texts. Very long texts are read whole, a row a word in turn. Of several windows with the same overlap the first in the
document is the best. Extra columns are not read; an empty table of documents or items gives no leaks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import if_small, stash

#: Fixed masks: 1 for the tokens that are hashed. Of WINDOW tokens with AGREE of them equal, one always hits.
MASKS = ("111111", "11001010011")
#: The masks of items shorter than WINDOW, by their number of tokens; made for the same AGREE.
SHORT_MASKS = {4: ("1111",), 5: ("111", "1101"), 6: ("1111", "11011"), 7: ("11011",), 8: ("1111",), 9: ("111011",), 10: ("1111", "11101"), 11: ("11101",), 12: ("1111",)}
LEAST = 4
WINDOW = 13
AGREE = 0.8
#: Seeds of the benchmark that may be broadcast (each three numbers); beyond it, a shuffle join runs.
BROADCAST_SEEDS = 2_000_000


def words(text: str | Column) -> Column:
    """A text's tokens: its runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def tokens(text: str | Column) -> Column:
    """The hashes of a text's tokens."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _places(df: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """Of df (keep, words): keep, at (a window's place) and seed, the hash of the window's kept tokens.

    Windows are read after the words are exploded, so that their hashing is compiled code and not a
    lambda for each place; the array of words itself leaves neither the row nor its task. (The outer form: the
    planner would filter on the size of the other's array, and split each text twice for it.)
    """
    at = df.select(*keep, "words", F.posexplode_outer("words").alias("at", "_word"))
    seeds = []
    for m in masks:
        kept = [F.get("words", F.col("at") + i) for i, x in enumerate(m) if x == "1"]
        seeds.append(F.when(F.col("at") + len(m) <= F.size("words"), F.xxhash64(F.lit(m), *kept)))
    return at.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed")).where(F.col("seed").isNotNull())


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which tells a document by its doc_id and text: two hashes, 128 bits."""
    both = F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), F.coalesce("text", F.lit(""))
    return docs.withColumn("_key", F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(1), *both).alias("b")))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Of docs (doc_id, text) and benchmark (item_id, text): _key, doc_id, item_id, hits (windows that met),
    position (the document's token at which the best window starts) and overlap (its share of equal tokens)."""
    items = stash(benchmark.select("item_id", words("text").alias("words")).where(F.size("words") >= LEAST).distinct())
    items = items.withColumn("tokens", F.transform("words", lambda w: F.xxhash64(w)))
    short = [r[0] for r in items.where(F.size("words") < WINDOW).select(F.size("words")).distinct().orderBy(F.size("words")).collect()]  # WINDOW numbers at most
    item = F.xxhash64("tokens").alias("_item")
    placed = _places(items.where(F.size("words") >= WINDOW).select("item_id", item, "words"), ["item_id", "_item"], list(MASKS))
    for n in short:
        placed = placed.unionByName(_places(items.where(F.size("words") == n).select("item_id", item, "words"), ["item_id", "_item"], list(SHORT_MASKS[n])))
    lighter = sorted({m for n in short for m in SHORT_MASKS[n]} - {*MASKS})
    seeds = stash(placed.select("item_id", "_item", F.col("at").alias("item_at"), F.col("seed").alias("_seed")).distinct())
    keys = keyed(docs.select("doc_id", "text"))
    places = _places(keys.select("_key", words("text").alias("words")), ["_key"], [*MASKS, *lighter])
    met = places.join(if_small(seeds, BROADCAST_SEEDS), F.col("seed") == F.col("_seed"))
    lines = stash(met.groupBy("_key", "item_id", "_item", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("hits")))
    wanted = stash(lines.select(F.col("_key").alias("_k")).distinct())
    texts = keys.join(if_small(wanted), F.col("_key") == F.col("_k"), "left_semi").groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    texts = texts.select("_key", "doc_id", tokens("text").alias("ours"))
    theirs = if_small(items.select(F.xxhash64("tokens").alias("_i"), F.col("tokens").alias("theirs")).distinct(), 100_000)
    pairs = lines.join(texts, "_key").join(theirs, F.col("_item") == F.col("_i"))
    first, last = F.greatest(F.lit(0), -F.col("shift")), F.least(F.size("theirs"), F.size("ours") - F.col("shift")) - 1
    pairs = pairs.withColumn("first", first).withColumn("same", F.transform(F.sequence(first, last), lambda i: F.when(F.get("theirs", i) == F.get("ours", i + F.col("shift")), 1).otherwise(0)))
    pairs = pairs.withColumn("width", F.least(F.lit(WINDOW), F.size("theirs")))
    sums = F.transform(F.sequence(F.lit(0), F.size("same") - F.col("width")), lambda s: F.struct((F.aggregate(F.slice("same", s + 1, F.col("width")), F.lit(0), lambda a, x: a + x) / F.col("width")).alias("overlap"), (-(s + F.col("first") + F.col("shift"))).alias("before")))
    best = F.when(F.size("same") >= F.col("width"), F.array_max(sums))
    pairs = pairs.select("_key", "doc_id", "item_id", "hits", best.alias("best")).where(F.col("best.overlap") >= AGREE)
    found = pairs.groupBy("_key", "doc_id", "item_id").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))
    return found.select("_key", "doc_id", "item_id", "hits", (-F.col("best.before")).cast("long").alias("position"), F.col("best.overlap").alias("overlap"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item; all columns stay."""
    bad = stash(leaks(docs, benchmark).select(F.col("_key").alias("_bad")).distinct())
    return keyed(docs).join(if_small(bad), F.col("_key") == F.col("_bad"), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
