"""N-gram Jaccard join by chosen paths.

A text is the set of its five-word shingles (lower-cased, split at white space; a text of fewer words
has one shingle, all of them; a text without words has none and links to nothing). Sets are split down
a tree: a node samples BRANCHES shared tokens, and a set goes to the child of each token that it has. A
sampled token is a place of the set's min-hash values with the value there, so two sets have it in common
with the probability of their Jaccard similarity. A node of at most LEAF sets is a leaf, and so is one
whose sets stay together in a child, since they are alike; all other nodes are split again, to any depth.
All pairs of a leaf are compared: by size and by sketches, then, if these let them through, exactly. A sketch
is a few bits of each min-hash value; a pair at the threshold has fewer than AGREE of them in common with a
probability under 1e-11. Only sets that have such a pair go on to a leaf with their shingles.

Two sets at similarity s are parted in a tree with the probability q = (1 - s + s q)^BRANCHES, whatever its
depth. Runs are repeated, trees with other tokens, until a pair at the threshold is met with TARGET.

Equal sets are one node of the join, with its number of copies, so copies never meet one another. A
leaf of many sets is cut into blocks and each pair of blocks is a task's work. A pair counts only in
the first leaf, by number, that it shares. No pair leaves a task: what does is each set's number of links
and a spanning forest of them.

A null text is the empty text. Rows are told apart by doc_id and text; a null doc_id is a row like any
other (its class may be null if all its members have none). Extra columns are not read. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm import kernels
from ledgerframe.llm.common import groups, if_small, stash, tune, written

WIDTH = 5
#: Similarity of a link: at least ABOVE / BELOW.
ABOVE, BELOW = 4, 5
#: Sampled tokens of a node.
BRANCHES = 2
#: Probability that a pair at the threshold meets in a leaf.
TARGET = 0.999
#: Sets of a leaf, and of a block of a larger one.
LEAF, BLOCK = 256, 512
#: A node of which a child has this share of the sets is a leaf of any size.
CLOSE = 0.7
#: Min-hash values of a set: those of the roots, then FEW for each level, used by turns.
FIRST, FEW, TURNS = 8, 4, 6
VALUES = FIRST + FEW * TURNS
#: Bits of a min-hash value in a sketch, and how many of its VALUES two sets must have in common to be compared exactly.
BITS, AGREE = 7, 8
_SEEDS = kernels.mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * kernels.ODD)


def runs_for(target: float, similarity: float = ABOVE / BELOW, branches: int = BRANCHES) -> int:
    """How many trees a pair needs to meet in one of them with probability `target`."""
    parted = 0.0
    for _ in range(1000):
        parted = (1 - similarity + similarity * parted) ** branches
    return next(n for n in range(1, 1000) if 1 - parted**n >= target)


RUNS = runs_for(TARGET)


def _sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of texts, with repeats, and where each text's begin."""
    raw = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    return kernels.shingle_hashes(*kernels.word_hashes(raw), WIDTH)


def _distinct(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    grams, begins = _sets(texts)
    parts = [np.unique(grams[i:j]) for i, j in zip(begins[:-1], begins[1:], strict=True)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def _digests(grams: np.ndarray, begins: np.ndarray) -> list[bytes]:
    """128 bits of each set, whatever its order: the sums of two hashes of its members."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernels.mixed(grams ^ np.uint64(salt * 0x632BE59BD9B4E019)), dtype=np.uint64)))
        out.append(sums[begins[1:]] - sums[begins[:-1]])
    flat = np.stack(out, 1).astype(">u8").tobytes()
    return [flat[i : i + 16] for i in range(0, len(flat), 16)]


def _values(grams: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """By text the min-hash values of a set without repeats: 32 bits of each, so that few others seem equal."""
    out = np.zeros((len(begins) - 1, VALUES), np.uint32)
    full = np.flatnonzero(np.diff(begins) > 0)
    if len(full):
        for k, seed in enumerate(_SEEDS):
            ranked = (grams ^ seed) * kernels.ODD
            ranked ^= ranked >> np.uint64(32)
            out[full, k] = np.minimum.reduceat(ranked, begins[:-1][full]) & np.uint64(0xFFFFFFFF)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, sid (the set's digest, binary; null if it is empty), n, and its min-hash values."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sids: list[bytes | None] = []
            ns, values = [], []
            for i, j in kernels.chunks([(t or "").encode("utf-8", "replace") for t in texts]):
                grams, begins = _distinct(texts[i:j])
                size = np.diff(begins)
                sids += [s if n else None for s, n in zip(_digests(grams, begins), size, strict=True)]
                ns.append(size)
                values.append(_values(grams, begins).view(np.int32))
            flat = np.concatenate([*values, np.zeros((0, VALUES), np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * VALUES), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sids, pa.binary()), pa.array(np.concatenate([*ns, np.zeros(0, np.int64)]).astype(np.int64)), lists], ["doc_id", "sid", "n", "mins"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(run, f"doc_id {kind}, sid binary, n long, mins array<int>")


def _child(node: Column, place: Column, value: Column) -> Column:
    """The child of the token that is a set's value at a place."""
    return F.xxhash64(node, place, value)


def _children(node: Column, values: Column, begin: int) -> Column:
    """The children that a node's set goes on to; the node's number samples their places among the level's, whose values are given."""
    first = F.pmod(F.xxhash64(node, F.lit(-1)), F.lit(FEW))
    step = F.pmod(F.xxhash64(node, F.lit(-2)), F.lit(FEW - 1)) + 1
    places = [F.pmod(first + step * k, F.lit(FEW)).cast("int") for k in range(BRANCHES)]
    return F.array(*(_child(node, F.lit(begin) + place, F.get(values, place)) for place in places))


def _leaves(sets: DataFrame, leaf: int) -> DataFrame:
    """Of sets (sid, mins): sid, node and size, the sets of the node, for the leaves of two sets or more."""
    places = [(run, (run * BRANCHES + k) % FIRST) for run in range(RUNS) for k in range(BRANCHES)]
    roots = F.array(*(_child(F.lit(run).cast("long"), F.lit(place), F.get("mins", F.lit(place))) for run, place in places))
    level = sets.select("sid", F.explode(roots).alias("node"))
    sizes = level.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    at = stash(level.join(sizes, "node").select("sid", "node", "size"))
    found, depth = at.where(F.col("size") <= leaf), 0
    while (more := at.where(F.col("size") > leaf)).limit(1).count():
        begin = FIRST + FEW * (depth % TURNS)
        values = sets.select("sid", F.slice("mins", begin + 1, FEW).alias("values"))  # a level's, not all: every set is dealt anew
        kids = stash(more.join(values, "sid").select("sid", F.col("node").alias("parent"), F.col("size").alias("whole"), F.explode(_children(F.col("node"), F.col("values"), begin)).alias("node")))
        sizes = stash(kids.groupBy("parent", "whole", "node").agg(F.count("*").alias("size")))
        close = sizes.where(F.col("size") >= CLOSE * F.col("whole")).select("parent").distinct()
        found = found.unionByName(more.join(close, F.col("node") == F.col("parent"), "left_semi"))
        going = sizes.where("size > 1").join(close, "parent", "left_anti").select("node", "size")
        at = stash(kids.select("sid", "node").join(going, "node").select("sid", "node", "size"))
        found, depth = found.unionByName(at.where(F.col("size") <= leaf)), depth + 1
    return found


def _met_before(rows: pa.Table, node: int) -> np.ndarray:
    """Of a leaf's sets, the pairs that share a leaf with a lesser number."""
    n = len(rows)
    out = np.zeros((n, n), bool)
    lists = rows["leaves"].combine_chunks()
    value = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
    owner, value = owner[value < node], value[value < node]
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    cuts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1], [True]))) if len(value) else np.zeros(1, np.int64)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if j - i > 1:
            out[np.ix_(owner[i:j], owner[i:j])] = True
    return out


def _candidates(rows: pa.Table, node: int, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a task's sets, by place, that may link and that no earlier leaf has compared.

    rows: n, leaves (all of the set's), block and sketch; with `two`, only pairs of different blocks count.
    A pair is told from its own two rows, so it is one among fewer rows, too.
    """
    n, blocks = rows["n"].to_numpy(), rows["block"].to_numpy()
    new = np.triu(~_met_before(rows, node), 1)
    if two:
        new &= blocks[:, None] != blocks[None, :]
    new &= (np.minimum(n[:, None], n[None, :]) * BELOW >= np.maximum(n[:, None], n[None, :]) * ABOVE)
    left, right = np.nonzero(new)
    sketch = rows["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, VALUES)
    alike = (sketch[left] == sketch[right]).sum(1) >= AGREE
    return left[alike], right[alike]


def _verified(rows: pa.Table, node: int, two: bool) -> dict[str, list]:
    """Links of a task's sets: sid, root (of its tree in the spanning forest), links (other sets, with their copies) and sets.

    rows: as for _candidates, and sid, copies and shingles (64-bit, sorted).
    """
    n, copies = rows["n"].to_numpy(), rows["copies"].to_numpy()
    left, right = _candidates(rows, node, two)
    if not len(left):
        return {}
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]
    if len(left) <= 4 * len(n) or len(n) < 12:
        shared = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)])
    else:
        shared = _shared(sets)[left, right]
    linked = shared * (BELOW + ABOVE) >= ABOVE * (n[left] + n[right])
    left, right = left[linked], right[linked]
    if not len(left):
        return {}
    links = np.bincount(left, copies[right], len(n)) + np.bincount(right, copies[left], len(n))
    others = np.bincount(left, minlength=len(n)) + np.bincount(right, minlength=len(n))
    root = np.arange(len(n))
    while True:  # labels fall to the least of each tree
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            break
    sid = rows["sid"].to_pylist()
    some = np.flatnonzero(others)
    return {"sid": [sid[i] for i in some], "root": [sid[root[i]] for i in some], "links": links[some].astype(np.int64).tolist(), "sets": others[some].tolist()}


def _shared(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The sizes of all intersections, from 0/1 matrices of the members that two sets or more have."""
    value = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    size = np.diff(np.concatenate((starts, [len(value)])))
    column = np.repeat(np.cumsum(size > 1) - 1, size)
    many = np.repeat(size > 1, size)
    column, owner = column[many], owner[many]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [first, first + columns])
        held = np.zeros((len(sets), columns), np.float32)
        held[owner[i:j], column[i:j] - first] = 1
        out += held @ held.T
    return out.astype(np.int64)


def _shingle_rows(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, sid and the set, as sorted 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            sids, shingles = [], []
            for i, j in kernels.chunks([(t or "").encode("utf-8", "replace") for t in texts]):
                grams, begins = _distinct(texts[i:j])
                sids += _digests(grams, begins)
                shingles += [grams[x:y].tobytes() for x, y in zip(begins[:-1], begins[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sids, pa.binary()), pa.array(shingles, pa.binary())], ["doc_id", "sid", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, sid binary, shingles binary")


def _needed(members: DataFrame, leaf: int) -> DataFrame:
    """Of members (sid, at: node and size of its leaves, leaves, n, sketch): sid, and node, i, j and block of the tasks where it has a candidate."""
    rows = members.select("sid", "n", "leaves", "sketch", F.explode("at").alias("at")).select("sid", "n", "leaves", "sketch", "at.node", "at.size")
    block = max(leaf, BLOCK) if leaf >= LEAF else max(1, leaf // 2)
    blocks = F.when(F.col("size") <= leaf, F.lit(1)).otherwise(F.ceil(F.col("size") / F.lit(block))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j"))))
    rows = rows.withColumn("tile", tile).select("node", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "sid", "n", "leaves", "block", "sketch")
    keys, out = ["node", "i", "j"], ["sid", "node", "i", "j", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in groups(batches, keys):
            if len(group) > 1:
                some = np.unique(np.concatenate(_candidates(group, key[0], key[1] != key[2])))
                if len(some):
                    yield from group.take(some).select(out).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "sid binary, node long, i int, j int, block int")


def links(docs: DataFrame, sets: DataFrame, *, leaf: int = LEAF) -> DataFrame:
    """Of sets (sid, doc_id of a text, n, copies, mins): sid, root, links, sets for each task's share of the join."""
    members = _leaves(sets, leaf).groupBy("sid").agg(F.collect_list(F.struct("node", "size")).alias("at"))
    sketch = F.transform("mins", lambda x: x.bitwiseAND((1 << BITS) - 1).cast("tinyint"))
    members = stash(members.select("sid", "at", F.sort_array("at.node").alias("leaves")).join(sets.select("sid", "doc_id", "n", "copies", sketch.alias("sketch")), "sid"))
    needed = _needed(members, leaf).groupBy("sid").agg(F.collect_list(F.struct("node", "i", "j", "block")).alias("at"))
    members = stash(needed.join(members.drop("at"), "sid"))
    # only the texts of these go on: one for each set, told by its doc_id and digest
    wanted = members.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(if_small(wanted), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    shingles = _shingle_rows(texts).alias("t")
    rows = members.alias("m").join(shingles, F.expr("m.sid = t.sid AND m.doc_id <=> t.doc_id")).select("m.*", "t.shingles")
    rows = rows.withColumn("at", F.explode("at")).select("at.node", "at.i", "at.j", "sid", "n", "copies", "leaves", "at.block", "sketch", "shingles")
    keys = ["node", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"sid": [], "root": [], "links": [], "sets": []}
        for key, group in groups(batches, keys):
            sid = group["sid"].to_pylist()
            once = [k for k in range(len(sid)) if not k or sid[k] != sid[k - 1]]  # rows with the same doc_id and text
            if len(once) < 2:
                continue
            for k, v in _verified(group if len(once) == len(sid) else group.take(once), key[0], key[1] != key[2]).items():
                held[k] += v
            if len(held["sid"]) > 10_000:
                yield pa.RecordBatch.from_pydict(held, schema)
                held = {k: [] for k in held}
        yield pa.RecordBatch.from_pydict(held, schema)

    schema = pa.schema([("sid", pa.binary()), ("root", pa.binary()), ("links", pa.int64()), ("sets", pa.int64())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(run, "sid binary, root binary, links long, sets long")


def components(edges: DataFrame) -> DataFrame:
    """Of undirected edges (a, b): each node and the least node it is connected with, as (node, label).

    Every round a node takes the least label of its neighbours and then that label's own label; rounds
    end when none changes.
    """
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stash(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = written(stepped.join(jump, F.col("label") == F.col("_n"), "left").select("node", "old", F.least("label", "_l").alias("label")), "labels")  # a checkpoint's size estimate would square each round
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels


def near_duplicates(docs: DataFrame, *, leaf: int = LEAF) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, sid, class_id (the least doc_id of all texts connected by
    links), is_kept (its doc_id is class_id; texts without words are kept), n_links (other rows at
    similarity 0.8 or more, copies included) and n_copies (rows with the same set, this one included)."""
    signed = stash(signatures(docs))
    sets = stash(signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("mins").alias("mins")))
    found = stash(links(docs, sets, leaf=leaf))
    labels = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")).where("a <> b"))
    counts = found.groupBy("sid").agg(F.sum("links").alias("links"))
    classes = sets.select("sid", "doc_id", "copies").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(least, "label").join(counts, "sid", "left").select("sid", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    out = signed.select("doc_id", "sid").join(classes, "sid", "left")
    class_id = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", F.lower(F.hex("sid")).alias("sid"), class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("is_kept"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each class; all columns stay.

    The kept row has the class's least doc_id; of several rows with that doc_id the first by hash of
    all columns that the class allows. Rows without words are all kept.
    """
    judged = stash(near_duplicates(docs))
    gone = judged.where("NOT is_kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = judged.where("is_kept").select(F.col("doc_id").alias("_id"))
    # a doc_id with several rows, some perhaps of one class, some of another: settled by the sets themselves
    several = stash(judged.groupBy(F.col("doc_id").alias("_id")).count().where("count > 1").select("_id"))
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    single = docs.join(if_small(stash(gone.unionByName(several).distinct())), same, "left_anti")
    if not several.limit(1).count():
        return single.select(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.join(if_small(several), same, "left_semi").withColumn("_all", F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    signed = signatures(rows.select(F.struct("doc_id", "_all").alias("doc_id"), "text")).select("doc_id.doc_id", "doc_id._all", F.lower(F.hex("sid")).alias("sid"))
    winners = signed.join(judged.where("is_kept AND sid IS NOT NULL").select(F.col("sid").alias("_sid"), F.col("class_id").alias("_class")).distinct(), (F.col("sid") == F.col("_sid")) & F.col("doc_id").eqNullSafe(F.col("_class")))
    winners = winners.groupBy("_class").agg(F.min(F.struct("sid", "_all")).alias("w")).select(F.col("w._all").alias("_won"))
    empty = signed.where("sid IS NULL").select(F.col("_all").alias("_won"))
    names = docs.columns
    first = rows.join(winners.unionByName(empty).distinct(), F.col("_all") == F.col("_won"), "left_semi")
    numbered = first.groupBy("_all").agg(*(F.first(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(names)))
    return single.select(*(F.col(f"`{c}`") for c in names)).union(numbered.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names))))
