"""Document fingerprints: a canonical exact digest.

The canonical form is NFKC, case folded, white space runs as one space, trimmed; its 128-bit xxh3 is
the fingerprint. Rows are grouped by digest; equal digests are only a bucket: the canonical bytes are compared
inside it, so two texts are the same class only if those bytes are equal.

A null text is the empty text. Rows with equal doc_id are ordered by a hash of their text, then the
text; rows alike in both are interchangeable. A null doc_id comes last. Extra columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerframe.llm.common import if_small, stash, tune

#: Buckets of the order by doc_id for each shuffle partition; a bucket's rows are sorted in one task.
BUCKETS_EACH = 6
#: Quantiles of doc_id at most; between two of them, more buckets have equal widths.
MOST_CUTS = 96


def canonical(text: str | None) -> bytes:
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Per row: the columns `keep`, n_chars and fingerprint."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            made = [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([digest(canonical(t)) for t in texts], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + made, names)

    names = [f"_keep_{i}" for i in range(len(keep))] + ["n_chars", "fingerprint"]
    kinds = [f"_keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    source = docs.select(*(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    out = source.mapInArrow(run, ", ".join([*kinds, "n_chars long, fingerprint string"]))
    return out.select(*(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), "n_chars", "fingerprint")


def _forms(docs: DataFrame, digest_of: Callable[[bytes], str]) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint, proof (a second digest of the form) and form, compressed (equal if and only if the forms are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            forms = [canonical(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(digest_of, forms), pa.string()), pa.array([proof_of(x) for x in forms], pa.binary()), pa.array(map(press.compress, forms), pa.binary())], ["doc_id", "fingerprint", "proof", "form"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, fingerprint string, proof binary, form binary")


def proof_of(form: bytes) -> bytes:
    return hashlib.sha256(form).digest()[:16]


def grouped(docs: DataFrame, signed: DataFrame, digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """The classes of docs (doc_id, text) of two rows or more: fingerprint, proof, class_id (the least doc_id with the same
    canonical bytes) and class_size. signed: the same rows' doc_id and fingerprint.

    Rows meet by digest, numbers only. Just the forms of digests that several rows have go on, with a map-side combine, so
    that a group of copies is a row a task. A bucket whose least and greatest forms agree, byte by byte, is one
    class; only in a bucket where they differ, a collision, rows are grouped by the form itself. proof is null in the former.
    """
    buckets = stash(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")).where("class_size > 1"))
    forms = _forms(docs, digest_of).join(if_small(buckets.select("fingerprint")), "fingerprint", "left_semi")
    one = stash(forms.groupBy("fingerprint").agg((F.min("form") == F.max("form")).alias("one")))
    whole = buckets.join(one.where("one"), "fingerprint").select("fingerprint", F.lit(None).cast("binary").alias("proof"), "class_id", "class_size")
    if not one.where("NOT one").limit(1).count():
        return whole
    clashes = forms.join(one.where("NOT one").select("fingerprint"), "fingerprint")
    apart = clashes.groupBy("fingerprint", "form").agg(F.first("proof").alias("proof"), F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return whole.unionByName(apart.drop("form"))


def with_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows (doc_id, fingerprint, proof) with class_id and class_size; a row that is in no class of two is its own."""
    met = rows.alias("r").join(classes.alias("c"), F.expr("r.fingerprint = c.fingerprint AND (c.proof IS NULL OR c.proof = r.proof)"), "left")
    return met.select("r.*", F.when(F.col("c.class_size").isNull(), F.col("r.doc_id")).otherwise(F.col("c.class_id")).alias("class_id"), F.coalesce("c.class_size", F.lit(1)).cast("long").alias("class_size")).drop("proof")


def exact_classes(docs: DataFrame, digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fingerprint, class_id and class_size."""
    tune(docs.sparkSession)
    rows = _forms(docs, digest_of).select("doc_id", "fingerprint", "proof")
    return with_classes(rows, grouped(docs, rows, digest_of))


def packed(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, tie (a hash of the text) and body, the text compressed, so that a shuffle moves less."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            ties = pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), ties, pa.array(map(press.compress, raw), pa.binary())], ["doc_id", "tie", "body"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, tie long, body binary")


def with_next(ids: DataFrame, docs: DataFrame, columns: list[str], ties: list[str]) -> DataFrame:
    """docs (an integer doc_id and `columns`) with _next: a struct of `columns` of the next row by descending
    doc_id, rows of a doc_id in the order of `ties`; after the last row comes the first. ids are the same
    rows' doc_id, from a plan that is cheap to run.

    doc_id's range is cut into buckets, each sorted in one task; a bucket also gets a copy of the first
    row of the one after it. Only numbers, a few a bucket, reach the driver or are broadcast.
    """
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_EACH
    n = min(wanted, MOST_CUTS)
    cuts = sorted(set(ids.select(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 20 * n)).head()[0] or []))
    bucket = _bucket(cuts, -(-wanted // n))
    docs = docs.withColumn("_bucket", bucket)
    tops = ids.withColumn("_bucket", bucket).groupBy("_bucket").agg(F.max("doc_id").alias("_top"))
    order = Window.orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy())
    tops = tops.select(F.col("_bucket").alias("_of"), "_top", F.coalesce(F.lag("_bucket").over(order), last).alias("_to"))
    # each row belongs to its bucket; the rows with a bucket's greatest doc_id are also guests of the one before
    docs = docs.join(F.broadcast(tops), F.expr("_bucket = _of AND doc_id <=> _top"), "left")
    home, away = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")), F.struct(F.col("_to").alias("b"), F.lit(1).alias("guest"))
    docs = docs.withColumn("_home", F.explode(F.when(F.col("_to").isNull(), F.array(home)).otherwise(F.array(home, away))))
    inside = Window.partitionBy("_home.b").orderBy("_home.guest", F.col("doc_id").desc_nulls_last(), *ties)
    docs = docs.withColumn("_next", F.lead(F.struct(*columns)).over(inside))
    return docs.where("_home.guest = 0").select("doc_id", *columns, "_next")


def _bucket(cuts: list[int], parts: int) -> Column:
    """A long that falls as doc_id grows: first by the cuts, found by halves, then by `parts` equal steps between two cuts."""

    def build(low: int, high: int) -> Column:  # the first of the ascending cuts at or above doc_id is in low..high
        if low == high:
            if low in (0, len(cuts)) or parts == 1:
                return F.lit((len(cuts) - low) * parts)
            low_cut, high_cut = cuts[low - 1], cuts[low]
            step = F.floor((F.lit(high_cut) - F.col("doc_id")) * F.lit(parts) / F.lit(high_cut - low_cut))
            return F.lit((len(cuts) - low) * parts) + F.least(step, F.lit(parts - 1))
        mid = (low + high) // 2
        return F.when(F.col("doc_id") > F.lit(cuts[mid]), build(mid + 1, high)).otherwise(build(low, mid))

    return F.when(F.col("doc_id").isNull(), F.lit((len(cuts) + 1) * parts)).otherwise(build(0, len(cuts))).cast("long")


def digests(docs: DataFrame) -> DataFrame:
    """The contract's rows for documents (doc_id, text).

    Likeness of two exact digests is 1 where the digests and then the canonical bytes are equal, else 0. class_id and class_size
    are of all rows with the same canonical bytes.
    """
    tune(docs.sparkSession)
    rows = with_next(docs.select("doc_id"), packed(docs), ["body"], ["tie", "body"]).select("doc_id", "body", F.col("_next.body").alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[] for _ in names[1:]]
            for bodies in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, after = (unpress.decompress(x).decode("utf-8", "surrogatepass") for x in bodies)
                k = len(text) // 3
                edited = text[: len(text) - k] + after[:k]
                form = canonical(text)
                other, following = (form if edited == text else canonical(edited)), (form if after == text else canonical(after))
                mine, theirs = digest(form), digest(other)
                row = (len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine, theirs)
                row += (float(mine == theirs and form == other), float(mine == digest(following) and form == following), proof_of(form))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out, kinds)], names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "proof"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, proof binary")
    return with_classes(out, grouped(docs, fingerprints(docs, ["doc_id"])))
