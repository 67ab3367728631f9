"""Checked joins, Hamming joins, components, bootstrap counts and balanced samples against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerframe.functions import text
from ledgerframe.operators import compare, expect, graph, joins, sampling, similarity


def test_joins_refuse_repeated_keys_and_unknown_names(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, l string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert joins.left_one_to_one(a, b, ["k"]).count() == 3
    for left, right in ((a.unionAll(a), b), (a, b.unionAll(b))):
        with pytest.raises(ValueError, match="more than once"):
            joins.left_one_to_one(left, right, ["k"])
    assert sorted(r["l"] for r in joins.registered(a, spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "l string, n int"), "l").collect()) == ["x", "y", "z"]
    with pytest.raises(PySparkException, match="not registered: z"):
        joins.registered(a, spark.createDataFrame([("x", 1), ("y", 2)], "l string, n int"), "l").collect()
    names = {"x": 1, "y": 2}
    with pytest.raises(PySparkException, match="unknown letter: z"):
        a.select(text.mapped(F.col("l"), names, "letter")).collect()


def test_reconciled_counts_what_does_not_meet(spark):
    a = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, None), (3, 3.0, 1.0)], "k int, v double, w double")
    b = spark.createDataFrame([(1, 1.5, 5.0), (2, 2.0, None), (4, 9.0, 1.0)], "k int, v double, w double")
    got = {r["value"]: (r["compared"], r["unmatched"], r["largest"], r["within"]) for r in joins.reconciled(a, b, ["k"], ["v", "w"], 0.6).collect()}
    assert got == {"v": (2, 2, 0.5, False), "w": (2, 2, 0.0, False)}
    assert all(r["within"] for r in joins.reconciled(a, a, ["k"], ["v", "w"], 0.0).collect())


def test_alignment_to_a_manifest(spark):
    manifest = spark.createDataFrame([(1, 0), (2, 1)], "k int, y int")
    rows = spark.createDataFrame([(2, 1, "b"), (1, 0, "a"), (1, 0, "c")], "k int, y int, s string")
    assert [tuple(r) for r in joins.aligned(rows, manifest, "k", "y", ["s"]).collect()] == [(1, 0, "a"), (2, 1, "b")]
    for other in ([(1, 0)], [(1, 0), (2, 0)], [(1, 0), (2, 1), (3, 1)]):
        with pytest.raises(ValueError, match="not aligned"):
            joins.aligned(rows, spark.createDataFrame(other, "k int, y int"), "k", "y", ["s"])
    got = joins.alignment(rows, spark.createDataFrame([(1, 1), (3, 1)], "k int, y int"), "k", "y").head()
    assert tuple(got) == (1, 1, 1, 1)


def test_contrasts_need_their_counterparts(spark):
    rows = spark.createDataFrame([(a, b, float(a * 2 + b)) for a in (0, 1) for b in (0, 1)], "a int, b int, v double")
    got = {r["factor"]: (r["pairs"], r["mean"]) for r in joins.factor_effects(rows, {"a": (0, 1), "b": (0, 1)}, "v").collect()}
    assert got == {"a": (2, 2.0), "b": (2, 1.0)}
    with pytest.raises(ValueError, match="without its counterpart"):
        joins.factor_effects(rows.where("NOT (a = 1 AND b = 1)"), {"a": (0, 1), "b": (0, 1)}, "v")
    with pytest.raises(PySparkException, match="1 lacks a key of 0"):
        compare.paired(rows.where("NOT (a = 1 AND b = 1)"), "a", 0, 1, ["b"], "v").collect()


@pytest.mark.parametrize(("most", "few"), [(0, 0), (2, 0), (5, 0), (10, 0), (15, 0), (20, 0), (10, 1000)])
def test_hamming_pairs_are_all_pairs(spark, monkeypatch, most, few):
    monkeypatch.setattr(similarity, "FEW", few)
    rng = np.random.default_rng(most)
    bits = rng.integers(-(1 << 63), 1 << 63, 40, dtype=np.int64).tolist()
    bits += [int(np.int64(b) ^ np.int64(sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 22)), replace=False)))) for b in bits for _ in range(2)]
    want = {(i, j, (x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) + (1 << 64)).bit_count()) for (i, x), (j, y) in itertools.combinations(enumerate(bits), 2)}
    want = {w for w in want if w[2] <= most}
    df = spark.createDataFrame(list(enumerate(bits)), "k long, b long")
    got = [tuple(r) for r in similarity.hamming_pairs(df, "k", "b", most).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (want or not most)


def test_blocks_compare_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 7)
    df = spark.createDataFrame([(i, i % 5) for i in range(40)], "k long, b long")
    got = [tuple(r) for r in similarity._tiled(df, "k", "b", 64).collect()]
    assert len(got) == len(set(got)) == 40 * 39 // 2 and all(a < b for a, b, _ in got)


def test_band_radii_cover_every_distance():
    for most in range(similarity.MOST_BANDED + 1):
        radii = similarity.band_radii(most)
        assert sum(r + 1 for r in radii) == most + 1


def test_components_in_one_task_and_in_rounds_agree(spark):
    rng = np.random.default_rng(3)
    nodes = spark.createDataFrame([(g, i) for g in (0, 1) for i in range(60)], "g int, id long")
    edges = spark.createDataFrame([(g, int(a), int(b)) for g in (0, 1) for a, b in rng.integers(0, 60, (25 + 10 * g, 2))] + [(0, i, i + 1) for i in range(40, 59)], "g int, a long, b long")
    one = {(r["g"], r["id"]): r["component"] for r in graph.components(nodes, edges, ["g"]).collect()}
    few, graph.FEW_EDGES = graph.FEW_EDGES, 0
    try:
        rounds = {(r["g"], r["id"]): r["component"] for r in graph.components(nodes, edges, ["g"]).collect()}
    finally:
        graph.FEW_EDGES = few
    assert one == rounds and len(one) == 120 and one[0, 59] == one[0, 40]
    assert graph.components(nodes.select("id").distinct(), edges.limit(0).select("a", "b")).where("id = component").count() == 60


def test_fold_crossings(spark):
    folds = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "i int, fold int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 9)], "left_id int, right_id int")
    assert sorted(map(tuple, graph.with_folds(pairs, folds, "i").collect()), key=str) == [(1, 2, 0, 0, False), (1, 3, 0, 1, True), (2, 9, 0, None, None)]


def test_bootstrap_counts_are_binomial(spark):
    rows = [(y, int(i < k)) for y, n, k in ((0, 50, 10), (1, 80, 60)) for i in range(n)]
    got = sampling.bootstrap_cells(spark.createDataFrame(rows, "label int, p int"), "label", ["p"], 4000).toPandas()
    whole = got.groupby(["replicate", "label"]).n.sum().unstack()
    assert (whole[0] == 50).all() and (whole[1] == 80).all() and len(whole) == 4000
    for label, n, k in ((0, 50, 10), (1, 80, 60)):
        drawn = got[(got.label == label) & (got.p == 1)].n
        p = k / n
        assert abs(drawn.mean() - k) < 4 * np.sqrt(n * p * (1 - p) / 4000) and drawn.var() == pytest.approx(n * p * (1 - p), rel=0.1)
    a, b = (got[(got.label == y) & (got.p == 1)].sort_values("replicate").n.to_numpy() for y in (0, 1))
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.06 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.06


def test_balanced_takes_derivatives_of_its_own_sources(spark):
    originals = spark.createDataFrame([(f"o{i}", f"g{i}", int(i < 3)) for i in range(10)], "k string, g string, y int")
    pool = spark.createDataFrame([(f"d{i}x{j}", f"g{i}", int(i < 3)) for i in range(20) for j in range(4)], "k string, g string, y int")
    got = sampling.balanced(originals, pool, "y", "g", 9, 1).toPandas()
    assert got.groupby("y").size().tolist() == [9, 9] and set(got.g) <= {f"g{i}" for i in range(10)} and got.k.is_unique
    for n in (6, 16):
        with pytest.raises(ValueError, match="rows asked for"):
            sampling.balanced(originals, pool, "y", "g", n, 1)
    assert expect.disjoint(originals.select("g"), pool.where("g > 'g9'").select("g"), "g").count() == 0


def test_partitions_and_decisions(spark):
    from ledgerframe.operators import dedupe

    rows = spark.createDataFrame([(i % 2, i) for i in range(10)], "y int, k long")
    got = sampling.partitions(rows, "y", "k", 8, 12, 1).toPandas()
    assert got.groupby(["part", "y"]).size().to_dict() == {("final", 0): 8, ("final", 1): 8, ("pool", 0): 12, ("pool", 1): 12}
    made = got[got["transform"].notna()]
    assert not made.duplicated(["y", "k", "slot"]).any() and not made.duplicated(["y", "k", "transform"]).any()
    with pytest.raises(ValueError, match="originals for 4 rows"):
        sampling.partitions(rows, "y", "k", 4, 1, 1)
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a int, b int")
    listed = spark.createDataFrame([(1, 2, dedupe.CONFIRMED), (2, 3, "distinct")], "a int, b int, decision string")
    assert sorted(tuple(r)[::3] + (r["b"],) for r in dedupe.decided(pairs, listed, ["a", "b"]).collect()) == [(1, "exclude", 2), (1, "pending_visual_review", 3), (2, "retain_both", 3)]
    with pytest.raises(ValueError, match="more than once"):
        dedupe.decided(pairs, listed.unionAll(listed), ["a", "b"])


def test_partitions_keep_all_originals_if_not_strict(spark):
    rows = spark.createDataFrame([(min(i // 3, 2), i) for i in range(20)], "y int, k long")  # 3, 3 and 14 rows
    for final, pool, want in ((2, 3, {0: (0, 2), 1: (0, 2), 2: (0, 0)}), (4, 10, {0: (1, 10), 1: (1, 10), 2: (0, 0)}), (4, 11, {0: (1, 11), 1: (1, 11), 2: (0, 1)})):
        got = sampling.partitions(rows, "y", "k", final, pool, 1, strict=False).toPandas()
        originals = got[got["transform"].isna()]
        assert (originals.part == "final").all() and sorted(originals.k) == list(range(20))
        made = got[got["transform"].notna()].groupby(["y", "part"]).size()
        assert {y: (made.get((y, "final"), 0), made.get((y, "pool"), 0)) for y in range(3)} == want


def test_grid_facts_are_those_of_components_by_cell(spark, monkeypatch):
    import random

    rng = random.Random(3)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(80)) if a != b})
    rows = [(a, b, rng.randrange(9), rng.randrange(9)) for a, b in pairs]
    df = spark.createDataFrame(rows, "left_id long, right_id long, p int, q int").repartition(3)
    nodes = spark.range(70)
    for gathered in (7, 1000):
        monkeypatch.setattr(graph, "GATHERED", gathered)
        got = {(r["first"], r["second"]): r.asDict() for r in graph.grid_facts(nodes, df, "p", "q", range(3, 6), range(0, 4)).collect()}
        assert len(got) == 12
        for (f, s), r in got.items():
            root = list(range(70))
            for a, b, p, q in rows:
                if p <= f or q <= s:
                    low, high = sorted((root[a], root[b]))
                    root = [low if x == high else x for x in root]
            size = [root.count(x) for x in set(root)]
            big = [x for x in size if x > 1]
            assert (r["n_groups"], r["multi_groups"], r["in_multi"], r["largest"], r["pairs"]) == (len(size), len(big), sum(big), max(size), sum(p <= f or q <= s for *_, p, q in rows))
    assert graph.grid_facts(nodes, df.where("false"), "p", "q", [1], [2]).select("n_groups", "multi_groups", "in_multi", "largest", "pairs").collect() == [(70, 0, 0, 1, 0)]
    assert not graph.grid_facts(nodes.where("false"), df.where("false"), "p", "q", [1], [2]).count()
