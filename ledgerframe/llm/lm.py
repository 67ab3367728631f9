"""Language-model scoring by a weighted backoff automaton.

A text is its words (lower-case A-Z, split at ASCII white space) with one space between, then the end. States are
contexts, in two ranks. A byte state is 0 to ORDER - 1 bytes; it has an arc for each byte seen after it, with the
Witten-Bell probability, and a failure arc to its longest proper suffix, with the backoff weight. A word state is
WORDS words that the training texts have, with a word after them (with the space or end that follows it) that comes
CUTOFF times or more; it has an arc for each such word, with the Witten-Bell probability of their counts, and a failure
arc, with the weight that is left, to the byte state, from which the word is read byte by byte. A word that comes after no
word state is read so too. Probabilities of what may follow sum to 1 in each state; a text's score is the sum of log10
probabilities along one traversal from left to right.

Counts are of all training texts, and every context counts: nothing is capped, broadcast or brought to the driver. A unit
is a run of rows of one piece of a file, of about UNIT bytes. It sends its distinct words, byte runs and word runs, as
sorted 64-bit numbers and counts, to buckets by number; a bucket sums what all units send, and sends each unit the sums
of what it sent, in the same order. Then the unit's texts are scored. A word is known by 64 bits of a hash, a
context by CONTEXT_BITS more than it takes to number the bytes of all texts, a word after a context by AFTER_BITS.

`fit` gives the byte states, the most frequent contexts only, as one automaton in memory. Its long texts
are cut into segments that start in the state that the bytes before them lead to, so many are traversed in
step with the same sums.

A null text is the empty text: one token, the end. A null doc_id is held out. Repeated rows count and
score each; extra columns are not read. Without training rows N and V are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerframe.llm import kernels
from ledgerframe.llm.common import groups, remainder, tune, written

ORDER = 5
END = 0xFF  # no byte of UTF-8
SEGMENT = 256
#: Words of a word state, and how often a word after it must come.
WORDS = 3
CUTOFF = 2
#: Bits of hashes.
CONTEXT_BITS, AFTER_BITS = 20, 24
#: Bytes of text of a unit, about; a longer text is a unit alone.
UNIT = 3_000_000
#: Bytes of a bucket's share of all texts, about, and the fewest and most buckets.
BUCKET_BYTES, FEWEST, MOST = 4_000_000, 32, 65_536
#: Distinct runs or words that a task holds before it passes them on.
HELD = 1_500_000
#: Words whose bytes are worked on together; a longer text is worked on alone.
PORTION = 100_000
#: Texts that are compressed together.
TOGETHER = 100


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _stream(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after ORDER - 1 spaces and before the end, and where each begins."""
    pad = b" " * (ORDER - 1)
    raw = [pad + b" ".join(x) + b"\xff" for x in docs]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))


def _portions(docs: list[list[bytes]]) -> list[tuple[int, int]]:
    """Ranges of texts of about PORTION words."""
    ends, held = [0], 0
    for i, x in enumerate(docs):
        held += len(x) + 1
        if held >= PORTION or i == len(docs) - 1:
            ends.append(i + 1)
            held = 0
    return list(zip(ends[:-1], ends[1:], strict=True))


def all_runs(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ORDER bytes of texts in order, as numbers, and the text that each is of."""
    flat, begins = _stream(docs)
    if len(flat) < ORDER:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.zeros(len(flat) - ORDER + 1, np.int64)
    for i in range(ORDER):
        key = (key << 8) | flat[i : i + len(key)]
    # a run belongs to a text if its last byte comes after the text's padding
    whole = np.ones(len(key), bool)
    for i in range(1, ORDER):
        at = begins[1:-1] - i
        whole[at[at >= 0]] = False
    return key[whole], np.repeat(np.arange(len(docs)), np.diff(begins) - (ORDER - 1))


def runs(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ORDER bytes of texts, as numbers, and their counts."""
    return np.unique(all_runs(docs)[0], return_counts=True)


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of several counts, and their sums."""
    keys, at = np.unique(np.concatenate([k for k, _ in held] or [np.zeros(0, np.int64)]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held] or [np.zeros(0)]), len(keys)).astype(np.int64)


@dataclass(frozen=True)
class Automaton:
    """classes: a byte's column. By state and column: log10 probability, and the next state's row."""

    classes: np.ndarray
    logs: np.ndarray
    moves: np.ndarray

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """The log10 probability of each text."""
        if not docs:
            return np.zeros(0)
        flat, begins = _stream(docs)
        columns = self.classes[flat].astype(np.int32)
        lengths = np.diff(begins) - (ORDER - 1)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(docs)), pieces)
        first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
        at = begins[:-1][owner] + (np.arange(len(owner)) - first[owner]) * SEGMENT
        size = np.minimum(begins[1:][owner] - (ORDER - 1) - at, SEGMENT)
        order = np.argsort(size, kind="stable")
        at, size, owner = at[order], size[order], owner[order]
        state, total = np.zeros(len(at), np.int32), np.zeros(len(at))
        for i in range(ORDER - 1):  # into the state that what stands before leads to
            state = self.moves.take(state + columns[at + i])
        ended = np.searchsorted(size, np.arange(SEGMENT), "right")
        at = at + ORDER - 1
        for i, live in enumerate(ended):
            if live == len(at):
                break
            step = state[live:] + columns[at[live:] + i]
            total[live:] += self.logs.take(step)
            state[live:] = self.moves.take(step)
        return np.bincount(owner, total, len(docs))


def build(grams: dict[int, tuple[np.ndarray, np.ndarray]], contexts: dict[int, np.ndarray]) -> Automaton:
    """The automaton of counts: by context length k, the (k + 1)-byte runs whose context is a state with their
    counts, and the sorted states of k bytes (k = 0: only the empty one)."""
    zero, n0 = grams[0]
    classes = np.full(256, len(zero), np.int64)  # bytes never seen share the last column
    classes[zero] = np.arange(len(zero))
    width = len(zero) + 1
    first, offset = {}, 0
    for k in range(ORDER):
        first[k] = offset
        offset += len(contexts[k])
    prob = np.zeros((offset, width), np.float64 if offset * width < 2_000_000 else np.float32)
    moves = np.zeros((offset, width), np.int32)
    total = n0.sum()
    prob[0, :-1] = (n0 + 1) / (total + 256)
    prob[0, -1] = 1 / (total + 256)
    for k in range(ORDER):
        own = contexts[k]
        rows = first[k] + np.arange(len(own))
        if k:
            back = first[k - 1] + np.searchsorted(contexts[k - 1], own & ((1 << 8 * (k - 1)) - 1))
            run, n = grams[k]
            at = np.searchsorted(own, run >> 8)
            seen = np.bincount(at, minlength=len(own))
            count = np.bincount(at, n, len(own))
            prob[rows] = prob[back] * (seen / np.maximum(count + seen, 1))[:, None]
            prob[rows[at], classes[run & 255]] += n / (count + seen)[at]
            moves[rows] = moves[back]
        if k < ORDER - 1 and len(contexts[k + 1]):
            longer = contexts[k + 1]
            up = np.searchsorted(own, longer >> 8)
            moves[rows[up], classes[longer & 255]] = (first[k + 1] + np.arange(len(longer))) * width
    return Automaton(classes.astype(np.uint8 if width < 256 else np.int16), np.log10(prob).astype(np.float32).ravel(), moves.ravel())


def count_runs(docs: DataFrame) -> DataFrame:
    """Of docs (text): run, n; what each task counts goes by run to be summed."""
    tune(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            words = [words_of(t) for t in b.column(0).to_pylist()]
            held += [runs(words[i:j]) for i, j in _portions(words)]
            if sum(len(k) for k, _ in held) > HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD // 2:
                    yield from _pieces(*held.pop())
        yield from _pieces(*_merged(held))

    def _pieces(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 200_000]), pa.array(n[i : i + 200_000])], ["run", "n"])

    return docs.select("text").mapInArrow(task, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def fit(training: DataFrame, *, states: int) -> Automaton:
    """The automaton of training texts. At most `states` contexts, and 256 counts each, reach the driver."""
    longest = written(count_runs(training), "runs")
    by_length = {k: longest if k == ORDER - 1 else longest.groupBy(F.col("run").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("run")).agg(F.sum("n").alias("n")) for k in range(ORDER)}
    sums = None
    for k in range(1, ORDER):
        of = by_length[k].groupBy(F.shiftright("run", 8).alias("context")).agg(F.sum("n").alias("n")).withColumn("k", F.lit(k))
        sums = of if sums is None else sums.unionByName(of)
    # a shorter context comes at least as often, so with ties to the shorter the choice has all prefixes and suffixes of its own
    chosen = sums.orderBy(F.desc("n"), "k", "context").limit(states - 1).toPandas()
    contexts = {0: np.zeros(1, np.int64)} | {k: np.sort(chosen["context"][chosen["k"] == k].to_numpy(np.int64)) for k in range(1, ORDER)}
    grams = {}
    for k in range(ORDER):
        kept = by_length[k]
        if k:
            spark = training.sparkSession
            mine = spark.createDataFrame([(int(c),) for c in contexts[k]], "context long")
            kept = kept.join(F.broadcast(mine), F.shiftright("run", 8) == F.col("context"), "left_semi")  # bounded: `states` numbers
        got = kept.select("run", "n").toPandas().sort_values("run")
        grams[k] = got["run"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    return build(grams, contexts)


def _chunked(docs: DataFrame) -> DataFrame:
    """docs with the chunk that a row is in: the piece of a file, the same in every scan. Rows that come from no file are written first."""
    docs = docs.select("doc_id", "text")
    if docs.where(F.input_file_name() == "").limit(1).count():
        docs = written(docs, "texts")
    return docs.select(F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("chunk"), F.coalesce(remainder("doc_id", 7) == 2, F.lit(True)).alias("held_out"), "text", "doc_id")


def _units(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
    """Of batches with the chunk first and the text third: chunk, number of the unit in it, and the unit's rows. Both scans cut alike, since a piece of a file is read in one order."""
    held: list[pa.RecordBatch] = []
    chunk, number, size = None, 0, 0
    for b in batches:
        own = b.column(0).to_numpy()
        lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
        start = 0
        for i in range(b.num_rows):
            if own[i] != chunk or size >= most:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield chunk, number, held
                number = number + 1 if own[i] == chunk else 0
                held, chunk, size, start = [], own[i], 0, i
            size += lengths[i] + 1
        if b.num_rows > start:
            held.append(b.slice(start))
    if held:
        yield chunk, number, held


def unit_number(chunk: int, number: int) -> int:
    return int(kernels.mixed(np.array([chunk], np.int64).view(np.uint64) + np.uint64(number) * kernels.ODD).view(np.int64)[0])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, compressed byte by byte: first all the lowest bytes, then the next."""
    planes = b"".join(x.astype(x.dtype.newbyteorder("<")).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays)
    return len(arrays[0]).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes, *types: type) -> list[np.ndarray]:
    n, at = int.from_bytes(blob[:4], "little"), 0
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    out = []
    for t in types:
        wide = np.dtype(t).itemsize
        out.append(np.ascontiguousarray(flat[at : at + n * wide].reshape(wide, n).T).view(t).reshape(n))
        at += n * wide
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=keys[:1] * np.uint64(0))


def word_grams(words: np.ndarray, begins: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the word hashes of texts: the place of each word that has WORDS before it in its text, `bits` bits of the hash of these, and AFTER_BITS of its own, other ones if it is the last."""
    n = len(words) - WORDS
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    context = words[:n].copy()
    for j in range(1, WORDS):
        context = kernels.mixed(context) * kernels.ODD + words[j : n + j]
    context = kernels.mixed(context)
    owner = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    at = np.flatnonzero((owner[WORDS:] == owner[:-WORDS])) + WORDS
    own = words.copy()
    own[begins[1:][np.diff(begins) > 0] - 1] ^= np.uint64(0x9E3779B97F4A7C15)
    return at, context[at - WORDS] >> np.uint64(64 - bits), (kernels.mixed(own[at]) >> np.uint64(64 - AFTER_BITS)).astype(np.uint32)


def _pairs(context: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, their summed counts, and by row its pair."""
    order = np.argsort(context)
    c, w = context[order], word[order]
    same = np.concatenate((c[1:] == c[:-1], [False]))
    many = np.flatnonzero(same | np.concatenate(([False], same[:-1])))
    if len(many):  # rows of contexts that come more than once are put in order of the word too
        again = many[np.lexsort((w[many], c[many]))]
        order[many] = order[again]
        c, w = context[order], word[order]
    first = np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))[: len(c)]
    at = np.cumsum(first) - 1
    back = np.empty(len(c), np.int64)
    back[order] = at
    return c[first], w[first], np.bincount(at, n[order], int(first.sum())).astype(np.int64), back


@dataclass
class Unit:
    """What a unit's texts are made of. docs: their words; train: which of them are learnt from; bits: of a context.

    words, runs and contexts (with after) are distinct and sorted; *_n are their counts in training texts, *_at by place the number of the distinct one.
    """

    docs: list[list[bytes]]
    train: np.ndarray
    bits: int = 64

    def __post_init__(self) -> None:
        joined = [b" ".join(x) for x in self.docs]
        parts, begins = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in kernels.chunks(joined):
            w, at = kernels.word_hashes(joined[i:j])
            parts.append(w)
            begins.append(at[1:] + begins[-1][-1])
        hashes, self.begins = np.concatenate(parts), np.concatenate(begins)
        learnt = np.repeat(self.train, np.diff(self.begins))
        self.words, self.words_at = np.unique(hashes, return_inverse=True)
        self.words_n = np.bincount(self.words_at[learnt], minlength=len(self.words))
        self.grams_place, context, after = word_grams(hashes, self.begins, self.bits)
        self.contexts, self.after, self.grams_n, self.grams_at = _pairs(context, after, learnt[self.grams_place].astype(float))


def byte_runs(docs: list[list[bytes]], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of ORDER bytes of texts and their counts in training texts."""
    held = []
    for test in (False, True):
        mine = [x for x, t in zip(docs, train, strict=True) if t != test]
        for i, j in _portions(mine):
            keys, n = runs(mine[i:j])
            held.append((keys, n * (not test)))
    return _merged(held)


def _bucket_cuts(keys: np.ndarray, bits: int, wide: int = 64) -> np.ndarray:
    """Where the keys, of `wide` bits, of each of 2 ** bits buckets, by their first bits, begin."""
    return np.searchsorted(keys >> np.uint64(wide - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _docs_of(rows: list[pa.RecordBatch]) -> tuple[list[list[bytes]], np.ndarray]:
    texts = [t for b in rows for t in b.column(2).to_pylist()]
    return [words_of(t) for t in texts], ~np.array([h for b in rows for h in b.column(1).to_pylist()], bool)


#: The kind of rows that have a bucket's sums of byte runs.
SUMMED = 3
SENT = "kind int, bucket int, unit long, body binary"


def sent(chunked: DataFrame, bits: int, context_bits: int, most: int) -> DataFrame:
    """What units send: kind (0: words, 1: word runs, 2: byte runs), bucket, unit and body, the bucket's part of the unit's keys and counts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, number, rows in _units(batches, most):
            docs, train = _docs_of(rows)
            unit = Unit(docs, train, context_bits)
            out: list[tuple[int, int, bytes]] = []
            for kind, keys, wide in ((0, unit.words, 64), (1, unit.contexts, context_bits)):
                cuts = _bucket_cuts(keys, bits, wide)
                for k in np.flatnonzero(np.diff(cuts)):
                    i, j = cuts[k], cuts[k + 1]
                    if kind == 0:
                        body = pack(_gaps(keys[i:j]), unit.words_n[i:j].astype(np.uint32))
                    else:
                        body = pack(_gaps(keys[i:j]), unit.after[i:j], unit.grams_n[i:j].astype(np.uint32))
                    out.append((kind, int(k), body))
            keys, n = byte_runs(docs, train)
            spread = kernels.mixed(keys.view(np.uint64))
            order = np.argsort(spread)
            keys, n, cuts = keys[order].view(np.uint64), n[order].astype(np.uint32), _bucket_cuts(spread[order], bits)
            out += [(2, int(k), pack(keys[cuts[k] : cuts[k + 1]], n[cuts[k] : cuts[k + 1]])) for k in np.flatnonzero(np.diff(cuts))]
            own = unit_number(chunk, number)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([own] * len(out), pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["kind", "bucket", "unit", "body"])

    return chunked.mapInArrow(task, SENT)


def _summed_words(bodies: list[bytes]) -> tuple[list[bytes], int, int]:
    """By unit the counts in all training texts of the words that it sent; how many words come in them, and how often."""
    parts = [unpack(b, np.uint64, np.uint32) for b in bodies]
    keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(every)).astype(np.uint64)
    cuts = np.cumsum([0, *map(len, keys)])
    return [pack(total[at[i:j]]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], int((total > 0).sum()), int(total.sum())


def _summed_grams(bodies: list[bytes]) -> list[bytes]:
    """By unit, for each word run that it sent: the count of the run, if CUTOFF or more, and the context's sum and number of such runs."""
    parts = [unpack(b, np.uint64, np.uint32, np.uint32) for b in bodies]
    keys = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    context, _, n, at = _pairs(np.concatenate(keys), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(float))
    n = np.where(n >= CUTOFF, n, 0)
    state = np.cumsum(np.concatenate(([True], context[1:] != context[:-1]))[: len(context)]) - 1
    whole = np.bincount(state, n).astype(np.uint64)
    kinds = np.bincount(state, n > 0).astype(np.uint32)
    cuts = np.cumsum([0, *map(len, keys)])
    out = []
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        mine = at[i:j]
        out.append(pack(n[mine].astype(np.uint64), whole[state[mine]], kinds[state[mine]]))
    return out


def answered(rows: DataFrame) -> DataFrame:
    """Of sent() rows, what goes back to units: unit, kind, bucket and body, with distinct and total of a bucket's words, once a bucket.
    Byte runs stay as they were sent; a row of kind SUMMED has a bucket's sums of them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, bucket), group in groups(batches, ["kind", "bucket"]):
            bodies = group["body"].to_pylist()
            distinct = total = 0
            units, kinds = group["unit"].to_pylist(), [kind] * len(bodies)
            if kind == 0:
                made, distinct, total = _summed_words(bodies)
            elif kind == 1:
                made = _summed_grams(bodies)
            else:  # these wait for all counts
                made, units, kinds = [*bodies, _summed_runs(bodies)], [*units, None], [*kinds, SUMMED]
            n = len(made)
            stats = lambda v: pa.array([v] + [0] * (n - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(kinds, pa.int32()), pa.array([bucket] * n, pa.int32()), pa.array(made, pa.binary()), stats(distinct), stats(total)], ["unit", "kind", "bucket", "body", "distinct", "total"])

    return rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "unit").mapInArrow(task, "unit long, kind int, bucket int, body binary, distinct long, total long")


def _summed_runs(bodies: list[bytes]) -> bytes:
    """The distinct byte runs that units sent, and their counts in all training texts."""
    keys, n = _merged([(k.view(np.int64), m) for k, m in (unpack(x, np.uint64, np.uint32) for x in bodies)])
    return pack(keys, n)


def run_counts(back: DataFrame) -> DataFrame:
    """Of answered() rows: bucket, run, n, each byte run once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys, n = unpack(body, np.int64, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys), pa.array(n)], ["bucket", "run", "n"])

    return back.where(f"kind = {SUMMED}").select("bucket", "body").mapInArrow(task, "bucket int, run long, n long")


def answered_runs(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Of byte runs that units sent (bucket, unit, body) and logs (bucket, run, log): unit, bucket and body, the unit's runs with their logs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in groups(batches, ["bucket"]):
            start = int(np.searchsorted(group["unit"].is_valid().to_numpy(), True))
            known, asked = group.slice(0, start), group.slice(start)
            table = Lookup(known["run"].to_numpy(), known["log"].to_numpy())
            for i in range(0, len(asked), 500):
                part = asked.slice(i, 500)
                keys = [unpack(x, np.uint64, np.uint32)[0] for x in part["body"].to_pylist()]
                bodies = [pack(k, table[k.view(np.int64)]) for k in keys]
                yield pa.RecordBatch.from_arrays([part["unit"].combine_chunks(), pa.array([bucket] * len(part), pa.int32()), pa.array(bodies, pa.binary())], ["unit", "bucket", "body"])

    both = logs.select("bucket", F.lit(None).cast("long").alias("unit"), F.lit(None).cast("binary").alias("body"), "run", "log").unionByName(rows, allowMissingColumns=True)
    return both.repartition("bucket").sortWithinPartitions("bucket", F.col("unit").asc_nulls_first()).mapInArrow(task, "unit long, bucket int, body binary")


class Lookup:
    """Values by key, for keys that are there, in a table of at least twice as many places."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, values.dtype)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several that want a place the last gets it
            got = self.keys[at[left]] == keys[left]
            self.values[at[left[got]]] = values[left[got]]
            left = left[~got]
            at[left] = (at[left] + 1) % size

    def _place(self, keys: np.ndarray) -> np.ndarray:
        # not the hash that buckets are cut by: a bucket's keys have its first bits in common
        return ((keys.view(np.uint64) * kernels.ODD ^ (keys.view(np.uint64) >> np.uint64(17))) * np.uint64(0xD6E8FEB86659FD93) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        wrong = np.flatnonzero(self.keys[at] != keys)
        while len(wrong):
            if (self.keys[at[wrong]] == -1).any():
                raise KeyError("a run that its unit did not send")
            at[wrong] = (at[wrong] + 1) % len(self.keys)
            wrong = wrong[self.keys[at[wrong]] != keys[wrong]]
        return self.values[at]


def run_logs(rows: DataFrame) -> DataFrame:
    """Of rows (run, n), repeated runs summed: run and log, the log10 probability of its last byte after the others.

    No context is left out. A run's probability is that of the run shorter by its first byte, weighted by what
    the context leaves to bytes not seen after it, and its own share; a context never seen leaves all.
    """
    longest = written(rows.groupBy("run").agg(F.sum("n").alias("n")), "runs")
    shorter = {k: longest if k == ORDER - 1 else longest.groupBy(F.col("run").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("run")).agg(F.sum("n").alias("n")) for k in range(ORDER)}
    total = shorter[0].agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    known = shorter[0].select("run", ((F.col("n") + 1) / F.lit(float(total + 256))).alias("p"))
    for k in range(1, ORDER):
        of = Window.partitionBy(F.shiftright("run", 8))  # 256 rows at most
        own = shorter[k].select("run", "n", F.sum("n").over(of).alias("count"), F.sum((F.col("n") > 0).cast("long")).over(of).alias("seen"))
        back = known.select(F.col("run").alias("suffix"), F.col("p").alias("less"))
        both = own.join(back, F.col("run").bitwiseAND((1 << 8 * k) - 1) == F.col("suffix"))
        p = F.when(F.col("count") == 0, F.col("less")).otherwise((F.col("n") + F.col("seen") * F.col("less")) / (F.col("count") + F.col("seen")))
        known = both.select("run", p.alias("p"))
    return known.select("run", F.log10("p").cast("float").alias("log"))


def _texts(chunked: DataFrame, most: int) -> DataFrame:
    """Per unit and batch of its texts: unit, bucket (the batch's number), doc_id and held_out as lists, and body, the texts' words joined and compressed together."""
    kind = to_arrow_type(chunked.schema["doc_id"].dataType)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for chunk, number, rows in _units(batches, most):
            rows = [b.slice(i, TOGETHER) for b in rows for i in range(0, b.num_rows, TOGETHER)]
            bodies = [press.compress(b"\n".join(b" ".join(words_of(t)) for t in b.column(2).to_pylist())) for b in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([unit_number(chunk, number)] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()), pa.array([b.column(3).to_pylist() for b in rows], pa.list_(kind)), pa.array([b.column(1).to_pylist() for b in rows], pa.list_(pa.bool_())), pa.array(bodies, pa.binary())],
                ["unit", "bucket", "doc_id", "held_out", "body"],
            )

    return chunked.mapInArrow(task, f"unit long, bucket int, doc_id array<{chunked.schema['doc_id'].dataType.simpleString()}>, held_out array<boolean>, body binary")


def word_logs(unit: Unit, logs: np.ndarray, last: np.ndarray, owner: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The log10 probability of each text. logs: of all bytes and ends by the byte states; last, owner: the byte itself and its text;
    sums: by distinct word run its count, and its context's sum and number of runs."""
    ends = np.flatnonzero((last == 32) | (last == END))
    begins = np.concatenate(([0], ends[:-1] + 1))
    steps = np.add.reduceat(logs, begins) if len(logs) else np.zeros(0)
    of = owner[ends]
    # a text without words has a step, its end, and no word
    first = np.searchsorted(of, np.arange(len(unit.docs)))
    text = np.searchsorted(unit.begins, unit.grams_place, "right") - 1
    at = first[text] + unit.grams_place - unit.begins[text]
    n, whole, kinds = (sums[k][unit.grams_at].astype(float) for k in range(3))
    read = steps[at]
    made = np.log10(np.maximum(n + kinds * 10.0 ** np.maximum(read, -300), 1e-300)) - np.log10(np.maximum(whole + kinds, 1))
    # beyond what a float holds, the failure arc's weight is added to the sum of logs
    made = np.where((n == 0) & (kinds > 0), np.log10(np.maximum(kinds, 1)) + read - np.log10(np.maximum(whole + kinds, 1)), made)
    steps[at] = np.where(whole > 0, made, read)
    return np.bincount(of, steps, len(unit.docs))


def scored(docs: DataFrame, *, unit: int = UNIT) -> DataFrame:
    """The contract's rows for documents (doc_id, text)."""
    tune(docs.sparkSession)
    chunked = _chunked(docs)
    size = chunked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count_if(~F.col("held_out"))).head()
    bits = int(np.clip(size[0] // BUCKET_BYTES, FEWEST, MOST)).bit_length() - 1
    ends = size[1]
    context_bits = min(64, CONTEXT_BITS + int(size[0]).bit_length())
    back = written(answered(sent(chunked, bits, context_bits, unit)), "sums")
    known = back.agg(F.coalesce(F.sum("distinct"), F.lit(0)).alias("v"), F.coalesce(F.sum("total"), F.lit(0)).alias("n")).head()
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    asked, counted = back.where("kind = 2").select("bucket", "unit", "body"), run_counts(back)
    logs = run_logs(counted.select("run", "n")).join(counted.select("run", "bucket"), "run")
    id_type = chunked.schema["doc_id"].dataType
    blank = {"kind": "int", "bucket": "int", "body": "binary", "doc_id": f"array<{id_type.simpleString()}>", "held_out": "array<boolean>"}

    def shaped(df: DataFrame, kind: int | None = None) -> DataFrame:
        df = df if kind is None else df.withColumn("kind", F.lit(kind))
        return df.select("unit", *(F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in blank.items()))

    rows = shaped(back.where("kind < 2")).unionByName(shaped(answered_runs(asked, logs), 2)).unionByName(shaped(_texts(chunked, unit), 3))
    rows = rows.repartition("unit").sortWithinPartitions("unit", "kind", "bucket")
    norm = float(np.log10(n + v + 1))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, ["unit"]):
            kinds = group["kind"].to_numpy()
            cuts = np.searchsorted(kinds, [0, 1, 2, 3, 4])
            part = [group.slice(i, j - i) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            unpress = zstandard.ZstdDecompressor()
            texts = [t.split() for x in part[3]["body"].to_pylist() for t in unpress.decompress(x).split(b"\n")]
            held_out = np.array([h for x in part[3]["held_out"].to_pylist() for h in x], bool)
            ids = [d for x in part[3]["doc_id"].to_pylist() for d in x]
            mine = Unit(texts, ~held_out, context_bits)
            totals = np.concatenate([np.zeros(0, np.uint64), *(unpack(x, np.uint64)[0] for x in part[0]["body"].to_pylist())])
            found = [unpack(x, np.uint64, np.uint64, np.uint32) for x in part[1]["body"].to_pylist()]
            sums = np.stack([np.concatenate([np.zeros(0, np.uint64), *(x[k].astype(np.uint64) for x in found)]) for k in range(3)])
            if len(totals) != len(mine.words) or sums.shape[1] != len(mine.contexts):
                raise ValueError("a unit's texts are not those that it sent")
            counts = np.append(totals[mine.words_at].astype(float), 0.0)
            add = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[mine.begins]) if len(x) else np.zeros(len(texts))
            tokens = np.diff(mine.begins) + 1
            base = add(np.log10(counts[:-1] + 1.0)) + np.log10(ends + 1.0) - tokens * norm
            known = add((counts[:-1] > 0).astype(float)).astype(np.int64) + (ends > 0)
            told = [unpack(x, np.uint64, np.float32) for x in part[2]["body"].to_pylist()]
            table = Lookup(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in told)]).view(np.int64), np.concatenate([np.zeros(0, np.float32), *(x[1] for x in told)]))
            read, lasts, owners = [np.zeros(0)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
            for i, j in _portions(texts):
                run, owner = all_runs(texts[i:j])
                read.append(table[run])
                lasts.append((run & 255).astype(np.uint8))
                owners.append(owner + i)
            said = word_logs(mine, np.concatenate(read), np.concatenate(lasts), np.concatenate(owners), sums)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(held_out), pa.array(tokens), pa.array(known), pa.array(np.full(len(texts), n, np.int64)), pa.array(base), pa.array(said)], names)

    kind = to_arrow_type(id_type)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return rows.mapInArrow(task, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
