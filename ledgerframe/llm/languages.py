"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed, language by language,
into the longest phrases that occur in the language's labelled text; the language that needs the fewest
phrases, in proportion to what it needs for labelled text of its own that its automaton hasn't seen, wins.

Of each language at most SAMPLE_TEXTS distinct texts are learnt from, the first by a hash (fewer, LEAST_TEXTS
at least, if there are so many languages that they would have over MOST_TEXTS together); of a text longer than
PIECE characters, as many at a place that its hash draws. Every fifth text is not in the automaton: the
median over these texts of phrases a byte is the language's rate, so a group of copies, which is one text,
or of near copies, unless it is most of a language, doesn't set it.

Texts are lower-cased and runs of whatever isn't a letter become one space. Phrases are of UTF-8 bytes, so
every letter is told from every other. Whole texts are parsed: segments in step, and then again each from the
state in which the one before it ended, until no state changes, which gives the parse from the text's start.

A null text, or one without a letter, is `und` with score 0. A null lang is never learnt from. Without
labelled text every row is `und`. Ties go to the first language by code point. Repeated rows are
predicted alike; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import remainder, tune

#: Distinct labelled texts that a language is learnt from, at most; those of all languages together; and one's least.
SAMPLE_TEXTS = 100
MOST_TEXTS = 800
LEAST_TEXTS = 20
#: Characters of a text that are learnt from, at most.
PIECE = 700
#: One sampled text in so many sets the rate and isn't in the automaton.
HELD_BACK = 5
#: Bytes of a text that are parsed in step with others.
SEGMENT = 256
UNDETERMINED = "und"
FILL = 0  # ends a row of codes; no byte of a letter or a space


def letters() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def folded(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts, lower-cased with runs of other signs than letters as one space, where each text's begin, and letters a text."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    begins = np.concatenate(([0], np.cumsum([len(t) for t in lowered], dtype=np.int64))).astype(np.int64)
    mine = is_letter[points]
    n = np.concatenate(([0], np.cumsum(mine)))
    keep = mine.copy()
    keep[1:] |= mine[:-1]
    first = begins[:-1][begins[:-1] < len(points)]
    keep[first] = mine[first]
    points = np.where(mine, points, 32)[keep]
    size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    ends = np.concatenate(([0], np.cumsum(size)))
    kept = np.concatenate(([0], np.cumsum(keep)))
    flat = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), np.uint8)
    return flat, ends[kept[begins]], n[begins[1:]] - n[begins[:-1]]


class Automaton:
    """The suffix automaton of a sequence of small numbers from 1 on, as a list of transition maps."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in sequence:
            current = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = current
                p = link[p]
            if p != -1:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[current] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[current] = clone
            last = current

    def table(self, width: int) -> np.ndarray:
        """By state and symbol: twice the next state's row, plus 1 where a new phrase begins; FILL changes nothing."""
        root = np.array([self.next[0].get(c, 0) for c in range(width)], np.int32)
        out = np.empty((len(self.next), width), np.int32)
        out[:] = 2 * width * root + 1
        at = np.array([(i, c, to) for i, moves in enumerate(self.next) if i for c, to in moves.items()], np.int64).reshape(-1, 3)
        out[at[:, 0], at[:, 1]] = 2 * width * at[:, 2]
        out[:, FILL] = 2 * width * np.arange(len(self.next))
        return out.ravel()


def phrases(table: np.ndarray, codes: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The number of phrases that begin in each row of codes. Rows are segments, the shorter first, filled up with
    FILL; `before` has the row that a row goes on from, or -1 where a text begins."""
    n, width = codes.shape
    columns = np.ascontiguousarray(codes.T)
    sizes = (codes != FILL).sum(1)
    ended = np.searchsorted(sizes, np.arange(width), "right")
    states, begun = np.zeros((width, n), np.int32), np.zeros((width, n), np.uint8)
    state = np.zeros(n, np.int32)
    for i, live in enumerate(ended):
        step = table.take(state[live:] + columns[i, live:])
        begun[i, live:] = step & 1
        state[live:] = states[i, live:] = step >> 1
    # a segment starts in the state that the one before it ends in; it is parsed anew until it comes to a state it was in before
    rest = np.flatnonzero(before >= 0)
    start = np.zeros(n, np.int32)
    while True:
        wanted = state[before[rest]]
        late = wanted != start[rest]
        if not late.any():
            return begun.sum(0, dtype=np.int64)
        live, now = rest[late], wanted[late]
        start[live] = now
        for i in range(width):
            step = table.take(now + columns[i, live])
            now = step >> 1
            begun[i, live] = step & 1
            apart = now != states[i, live]
            states[i, live] = now
            ending = apart & (sizes[live] == i + 1)
            state[live[ending]] = now[ending]
            apart &= ~ending
            live, now = live[apart], now[apart]
            if not len(live):
                break


@dataclass(frozen=True)
class Model:
    languages: list[str]
    is_letter: np.ndarray
    classes: list[np.ndarray]  # by language and byte: its column
    tables: list[np.ndarray]
    rates: np.ndarray  # phrases a byte that a language's own text, not in its automaton, needs

    def needed(self, flat: np.ndarray, begins: np.ndarray, which: list[int]) -> np.ndarray:
        """By language and text the number of phrases of folded texts."""
        lengths = np.diff(begins)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(lengths)), pieces)
        first = np.concatenate(([0], np.cumsum(pieces)))[:-1]
        place = np.arange(len(owner)) - first[owner]
        at = begins[:-1][owner] + place * SEGMENT
        size = np.minimum(begins[1:][owner] - at, SEGMENT)
        order = np.argsort(size, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        before = np.where(place[order] > 0, where[np.maximum(order - 1, 0)], -1)
        at, size, owner = at[order], size[order], owner[order]
        grid = np.minimum(at[:, None] + np.arange(SEGMENT), max(len(flat) - 1, 0))
        inside = np.arange(SEGMENT) < size[:, None]
        out = np.zeros((len(which), len(lengths)))
        for i, k in enumerate(which):
            codes = np.where(inside, self.classes[k][flat][grid] if len(flat) else FILL, FILL).astype(np.uint8)
            out[i] = np.bincount(owner, phrases(self.tables[k], codes, before), len(lengths))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        flat, begins, n = folded(texts, self.is_letter)
        counts = self.needed(flat, begins, list(range(len(self.languages)))) / self.rates[:, None]
        best = counts.argmin(0)
        low = counts.min(0)
        rest = np.sort(counts, axis=0)[1] if len(self.languages) > 1 else np.full(len(texts), np.inf)
        score = np.where(n > 0, 1.0 - np.minimum(low / np.maximum(rest, 1e-12), 1.0), 0.0)
        return [self.languages[k] if m else UNDETERMINED for k, m in zip(best, n, strict=True)], score


def fit_texts(samples: dict[str, list[str]]) -> Model:
    """The model of distinct texts in memory, by language."""
    is_letter = letters()
    languages = sorted(k for k, v in samples.items() if any(any(map(str.isalpha, t)) for t in v))
    classes, tables, held = [], [], []
    for k in languages:
        back = [t for i, t in enumerate(samples[k]) if i % HELD_BACK == HELD_BACK - 1]
        flat, _, _ = folded([" ".join(t for i, t in enumerate(samples[k]) if i % HELD_BACK != HELD_BACK - 1)], is_letter)
        seen = np.unique(flat)
        of = np.full(256, len(seen) + 1, np.uint8)  # bytes that the language has not
        of[seen] = np.arange(1, len(seen) + 1)
        classes.append(of)
        tables.append(Automaton(of[flat].tolist()).table(len(seen) + 2))
        held.append(back)
    model = Model(languages, is_letter, classes, tables, np.ones(len(languages)))
    rates = []
    for k, back in enumerate(held):
        flat, begins, n = folded(back, is_letter)
        size = np.diff(begins)
        rate = model.needed(flat, begins, [k])[0][n > 0] / size[n > 0]
        rates.append(float(np.median(rate)) if len(rate) else 0.0)
    known = [r for r in rates if r > 0]
    # languages with too few texts to hold one back count as the average one
    return Model(languages, is_letter, classes, tables, np.array([r or (float(np.mean(known)) if known else 1.0) for r in rates]))


def fit(docs: DataFrame) -> Model:
    """The model of documents (doc_id, text, lang) whose crc32(doc_id) mod 4 is not 2 and whose lang is not null.

    Texts are drawn by their hash, equal ones as one, so that at most about twice SAMPLE_TEXTS pieces a
    language reach the driver, however many copies there are.
    """
    learn = docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("at"), "text")
    counts = learn.groupBy("lang").agg(F.approx_count_distinct("at").alias("n")).collect()
    if not counts:
        return fit_texts({})
    each = min(SAMPLE_TEXTS, max(LEAST_TEXTS, MOST_TEXTS // len(counts)))
    whole = 1 << 40
    draw = F.pmod(F.xxhash64("at"), F.lit(whole))
    share = F.create_map(*(v for r in counts for v in (F.lit(r["lang"]), F.lit(min(whole, 2 * each * whole // max(1, r["n"]))))))
    spare = F.greatest(F.length("text") - PIECE, F.lit(0))
    piece = F.substring(F.col("text"), (F.pmod(F.col("at"), spare + 1) + 1).cast("int"), F.lit(PIECE))
    drawn = learn.where(draw < F.element_at(share, F.col("lang"))).select("lang", draw.alias("draw"), "at", piece.alias("piece"))
    samples: dict[str, list[str]] = {}
    for r in sorted(drawn.groupBy("lang", "draw", "at").agg(F.min("piece").alias("piece")).collect(), key=lambda r: (r["lang"], r["draw"], r["at"])):
        mine = samples.setdefault(r["lang"], [])
        if len(mine) < each:
            mine.append(r["piece"])
    return fit_texts(samples)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, held_out, lang_pred, score. A null doc_id is held out."""
    spark = docs.sparkSession
    tune(spark)
    held = spark.sparkContext.broadcast(model)  # bounded: two states a sampled byte at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            start = size = 0
            said: list[str] = []
            scores: list[np.ndarray] = []
            for i in range(len(texts) + 1):
                if i == len(texts) or size > 2_000_000:
                    if i > start:
                        names, score = held.value.predict(texts[start:i])
                        said += names
                        scores.append(score)
                    start, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string()), pa.array(np.concatenate([*scores, np.zeros(0)]))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
