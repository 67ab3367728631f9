"""Secret scans: an Aho-Corasick keyword prefilter, anchored regular expressions near its hits, checksums.

The automaton holds every keyword a rule starts with; a rule's expression is tried only where its
keyword was hit, anchored there. Tokens with an embedded checksum (CRC-32 in base 62) count only if it
holds. Null and empty texts have no spans. Whole texts are read; rows are independent, so repeated
rows, ties and extra columns (not read) don't matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.common import tune

# The kinds in order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: What replaces a secret in a redacted text.
MASK = "[SECRET]"


def checksum_holds(token: str) -> bool:
    """Whether the last six characters are the base-62 CRC-32 of what is between the prefix and them."""
    body, given = token.partition("_")[2][:-6], token[-6:]
    n, said = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        said = BASE62[digit] + said
    return said == given


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= LEAST_ASSIGN),
    "access": (ACCESS, lambda m: len(m[0]) >= LEAST_ACCESS),
    "github": (GITHUB, lambda m: checksum_holds(m[0])),
    "npm": (NPM, lambda m: checksum_holds(m[0])),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _lowered(text: str) -> str:
    """Lower case, position by position."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := x.lower()) == 1 else x for x in text)


def spans_of(text: str | None, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of every secret, sorted; code points, end exclusive.

    A kind's matches are leftmost and non-overlapping; those that then fail its length or checksum
    are dropped, but still cover their text.
    """
    if not text:
        return []
    out = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    over: dict[str, int] = {}
    # hits come by their end; two keywords of a kind never nest, so their starts are in order too
    for end, (n, kind) in keywords.iter(_lowered(text)):
        start = end - n + 1
        if start < over.get(kind, 0):
            continue
        rule, holds = RULES[kind]
        if m := rule.match(text, start):
            over[kind] = m.end()
            if holds(m):
                out.append((start, KINDS.index(kind), m.end()))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """text with each run of overlapping spans replaced by MASK."""
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


SCAN_SCHEMA = "spans array<struct<kind:string,start:long,end:long>>, listed string, base_listed string, n_assign long, n_access long, n_hex long, text string"


def scan(docs: DataFrame, keep: list[str], *, redact: bool = False) -> DataFrame:
    """Per row of docs: the columns `keep`, then spans (structs), their listing, the base kinds' listing
    and counts; with redact, also the text without its secrets (else null there)."""
    tune(docs.sparkSession)
    kinds = [f"_keep_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            found = [spans_of(t, keywords) for t in texts]
            base = [[s for s in x if s[1] < 3] for x in found]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x] for x in found], pa.list_(span)), pa.array(map(listed, found), pa.string()), pa.array(map(listed, base), pa.string())]
            cols += [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in range(3)]
            cols.append(pa.array([redacted(t, x) if redact else None for t, x in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names)

    out_schema = ", ".join([*kinds, SCAN_SCHEMA])
    names = [f"_keep_{i}" for i in range(len(keep))] + ["spans", "listed", "base_listed", "n_assign", "n_access", "n_hex", "text"]
    source = docs.select(*(F.col(f"`{c}`").alias(f"_keep_{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    return source.mapInArrow(run, out_schema)


def secret_spans(docs: DataFrame) -> DataFrame:
    """The contract's digest of scan() for documents (doc_id, text)."""
    out = scan(docs, ["doc_id"])
    return out.select(F.col("_keep_0").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base_listed").cast("binary"), 256).alias("base_sha256"), F.col("listed").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text and, if there is one, n_chars counted anew; all columns and rows stay."""
    others = [c for c in docs.columns if c != "text"]
    out = scan(docs, others, redact=True)
    at = {c: F.col(f"_keep_{i}") for i, c in enumerate(others)}
    if "n_chars" in at:
        kind = docs.schema["n_chars"].dataType
        at["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(at["n_chars"])
    return out.select(*((F.col("text") if c == "text" else at[c]).alias(c) for c in docs.columns))


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """The base counts and listing by plain scans, for tests."""
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    n = [sum(x[1] == k for x in found) for k in range(3)]
    return (*n, hashlib.sha256(listed(sorted(found)).encode()).hexdigest())
