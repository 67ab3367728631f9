"""All queries of the library over the driver's tables, with their DuckDB oracles.

Predictions to evaluate are the documents that have labels: the label is quality, the predictor is a
threshold of length. Fingerprints are median bits of embeddings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerframe.functions import scores, text
from ledgerframe.operators import compare, dedupe, expect, graph, joins, metrics, sampling, similarity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of a table reader; sql is its oracle."""

    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def both(name: str, sql: str, tables: str) -> None:
    """Registers a query that is the same text in Spark SQL and in DuckDB."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql.replace("[", "{").replace("]", "}"), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()})

    QUERIES[name] = run
    ORACLE[name] = sql.replace("[", "").replace("]", "")


PRED = """p AS (SELECT d.doc_id AS item_id, d.lang, d.source, d.n_chars, l.quality AS label, l.toxic,
  CASE WHEN d.n_chars >= 1000 THEN 1 ELSE 0 END AS predicted, CASE WHEN d.n_chars >= 2000 THEN 1 ELSE 0 END AS predicted_b,
  round(least(d.n_chars / 2000.0::DOUBLE, 1), 6) AS score FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def predictions(t: Callable[[str], DataFrame]) -> DataFrame:
    n = F.col("n_chars")
    out = t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id")
    return out.select(F.col("doc_id").alias("item_id"), "lang", "source", "n_chars", F.col("quality").alias("label"), "toxic", (n >= 1000).cast("int").alias("predicted"), (n >= 2000).cast("int").alias("predicted_b"), F.round(F.least(n / 2000.0, F.lit(1.0)), 6).alias("score"))


def _counted(by: str, predicted: str = "predicted") -> str:
    keys = f"{by}, " if by else ""
    cell = lambda a, b: f"count(*) FILTER (WHERE label = {a} AND {predicted} = {b})"
    return f"SELECT {keys}{cell(1, 1)} AS tp, {cell(1, 0)} AS fn, {cell(0, 0)} AS tn, {cell(0, 1)} AS fp FROM p" + (f" GROUP BY {by}" if by else "")


_D = lambda a, b: f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0)"
_SQL_METRICS = {
    "accuracy": _D("tp + tn", "tp + tn + fp + fn"),
    "balanced_accuracy": f"({_D('tp', 'tp + fn')} + {_D('tn', 'tn + fp')}) / 2",
    "precision_macro": f"({_D('tp', 'tp + fp')} + {_D('tn', 'tn + fn')}) / 2",
    "recall_macro": f"({_D('tp', 'tp + fn')} + {_D('tn', 'tn + fp')}) / 2",
    "f1_macro": f"({_D('2 * tp', '2 * tp + fp + fn')} + {_D('2 * tn', '2 * tn + fn + fp')}) / 2",
    "mcc": _D("tp::DOUBLE * tn - fp::DOUBLE * fn", "sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"),
    "recall_positive": _D("tp", "tp + fn"),
    "recall_negative": _D("tn", "tn + fp"),
}
F1 = _SQL_METRICS["f1_macro"]
_SQL_ALL = ", ".join(f"round({v}, 12) AS {k}" for k, v in _SQL_METRICS.items())


def _evaluated(by: str, predicted: str = "predicted") -> str:
    return f"WITH {PRED}, c AS ({_counted(by, predicted)}) SELECT *, {_SQL_ALL} FROM c"


@query(_evaluated("lang"))
def a17_metrics(t):
    return metrics.evaluate(predictions(t), ["lang"])


@query(_evaluated(""))
def a17_metrics_overall(t):
    return metrics.evaluate(predictions(t), [])


@query(_evaluated("source", "predicted_b"))
def m23_metrics_by_source(t):
    return metrics.evaluate(predictions(t).drop("predicted").withColumnRenamed("predicted_b", "predicted"), ["source"])


@query(f"""WITH {PRED}, c AS ({_counted("lang")})
SELECT lang, 0 AS label, 0 AS predicted, tn AS n FROM c UNION ALL SELECT lang, 0, 1, fp FROM c UNION ALL SELECT lang, 1, 0, fn FROM c UNION ALL SELECT lang, 1, 1, tp FROM c""")
def a16_confusion(t):
    return metrics.confusion(predictions(t), ["lang"])


@query(f"""WITH {PRED}, c AS ({_counted("lang")}), u AS (SELECT lang, 0 AS class, tn AS t, fp AS miss, fn AS wrong FROM c UNION ALL SELECT lang, 1, tp, fn, fp FROM c)
SELECT lang, class, round({_D("t", "t + wrong")}, 12) AS precision, round({_D("t", "t + miss")}, 12) AS recall, round({_D("2 * t", "2 * t + wrong + miss")}, 12) AS f1, t + miss AS support FROM u""")
def a18_per_class(t):
    return metrics.per_class(predictions(t), ["lang"])


@query(f"""WITH {PRED}, r AS (SELECT lang, label, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM p),
s AS (SELECT lang, sum(rk) FILTER (WHERE label = 1) AS rs, (count(*) FILTER (WHERE label = 1))::DOUBLE AS a, (count(*) FILTER (WHERE label = 0))::DOUBLE AS b FROM r GROUP BY lang),
u AS (SELECT lang, (rs - a * (a + 1) / 2) / nullif(a * b, 0) AS auc FROM s)
SELECT lang, round(auc, 12) AS auc, round(greatest(auc, 1 - auc), 12) AS separation FROM u""")
def a15_roc_auc(t):
    return metrics.roc_auc(predictions(t), "label", "n_chars", ["lang"])


@query(f"""WITH {PRED}, s AS (SELECT lang, avg(n_chars) FILTER (WHERE label = 1) AS m1, avg(n_chars) FILTER (WHERE label = 0) AS m0, var_samp(n_chars) FILTER (WHERE label = 1) AS s1, var_samp(n_chars) FILTER (WHERE label = 0) AS s0,
count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM p GROUP BY lang)
SELECT lang, round(coalesce((m1 - m0) / nullif(sqrt(((n1 - 1) * s1 + (n0 - 1) * s0) / nullif(n1 + n0 - 2, 0)), 0), 0), 9) AS cohen_d FROM s""")
def a14_cohen_d(t):
    return metrics.cohen_d(predictions(t), "label", "n_chars", ["lang"])


@query(f"""WITH {PRED} SELECT item_id, CASE WHEN label = predicted THEN 'correct' WHEN label = 1 THEN 'false_negative' ELSE 'false_positive' END AS error_type,
CASE WHEN predicted = 1 THEN score ELSE 1 - score END AS confidence, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END = predicted AS agrees, label = predicted AS correct FROM p""")
def p12_prediction_columns(t):
    p = predictions(t)
    c = {x: F.col(x) for x in ("label", "predicted", "score")}
    return p.select("item_id", scores.error_type(c["label"], c["predicted"]).alias("error_type"), scores.confidence(c["score"], c["predicted"]).alias("confidence"), scores.agrees(c["score"], c["predicted"]).alias("agrees"), (c["label"] == c["predicted"]).alias("correct"))


@query(f"""WITH {PRED} SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE label = predicted) AS n_correct, round(count(*) FILTER (WHERE label = predicted) / count(*)::DOUBLE, 12) AS accuracy FROM p GROUP BY lang, source""")
def a02_error_slices(t):
    correct = F.count_if(F.col("label") == F.col("predicted"))
    return predictions(t).groupBy("lang", "source").agg(F.count("*").alias("n"), correct.alias("n_correct"), F.round(correct / F.count("*"), 12).alias("accuracy"))


@query(f"""WITH {PRED} SELECT 'highest' AS side, * FROM (SELECT item_id, score FROM p WHERE label = 0 AND predicted = 1 ORDER BY score DESC, item_id LIMIT 5)
UNION ALL SELECT 'lowest', * FROM (SELECT item_id, score FROM p WHERE label = 1 AND predicted = 0 ORDER BY score, item_id LIMIT 5)""")
def r16_extreme_errors(t):
    p = predictions(t).select("item_id", "score", "label", "predicted")
    high = p.where("label = 0 AND predicted = 1").orderBy(F.desc("score"), "item_id").limit(5).select(F.lit("highest").alias("side"), "item_id", "score")
    low = p.where("label = 1 AND predicted = 0").orderBy("score", "item_id").limit(5).select(F.lit("lowest").alias("side"), "item_id", "score")
    return high.unionByName(low)


@query(f"""WITH {PRED} SELECT lang, count(*) FILTER (WHERE predicted <> predicted_b) AS flips, count(*) FILTER (WHERE predicted <> label AND predicted_b = label) AS wrong_to_right, count(*) FILTER (WHERE predicted = label AND predicted_b <> label) AS right_to_wrong FROM p GROUP BY lang""")
def m22_flips(t):
    a, b, y = F.col("predicted"), F.col("predicted_b"), F.col("label")
    return predictions(t).groupBy("lang").agg(F.count_if(a != b).alias("flips"), F.count_if((a != y) & (b == y)).alias("wrong_to_right"), F.count_if((a == y) & (b != y)).alias("right_to_wrong"))


ITEMS = "i AS (SELECT doc_id AS path, sha256(text) AS digest, source AS source_set, lang AS class FROM documents)"


def _items(t):
    return t("documents").select(F.col("doc_id").alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("source").alias("source_set"), F.col("lang").alias("class"))


@query(f"""WITH {ITEMS}, g AS (SELECT digest, count(*) AS group_size, min(source_set) <> max(source_set) AS cross_set, min(class) <> max(class) AS cross_class FROM i GROUP BY digest HAVING count(*) > 1)
SELECT i.path, i.digest, i.source_set, i.class, g.group_size, g.cross_set, g.cross_class FROM i JOIN g USING (digest)""")
def r17_duplicate_report(t):
    return dedupe.duplicate_report(_items(t))


@query(f"""WITH {ITEMS}, dev AS (SELECT path, digest FROM i WHERE source_set <> 'src1'), ext AS (SELECT DISTINCT digest FROM i WHERE source_set = 'src1'),
m AS (SELECT dev.*, ext.digest IS NOT NULL AS outside FROM dev LEFT JOIN ext ON dev.digest = ext.digest), f AS (SELECT digest, min(path) AS first_path FROM m WHERE NOT outside GROUP BY digest)
SELECT m.path, m.digest, CASE WHEN outside THEN 'overlap_with_external' WHEN m.path <> first_path THEN 'duplicate_within_development' END AS reason FROM m LEFT JOIN f ON m.digest = f.digest""")
def r18_exclusion_ledger(t):
    i = _items(t)
    return dedupe.exclusion_ledger(i.where("source_set <> 'src1'").select("path", "digest"), i.where("source_set = 'src1'").select("path", "digest"))


@query(f"WITH {ITEMS} SELECT path, digest FROM i WHERE source_set <> 'src1' AND digest IN (SELECT digest FROM i WHERE source_set = 'src1')")
def j11_cross_set_overlap(t):
    i = _items(t).select("path", "digest", "source_set")
    return i.where("source_set <> 'src1'").join(i.where("source_set = 'src1'").select("digest"), "digest", "left_semi").select("path", "digest")


@query("SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def w01_keep_first(t):
    return dedupe.keep_first(t("documents").select("doc_id", "source", "lang", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), ["digest"], ["doc_id"]).drop("digest")


@query("""WITH d(s_suppkey, s_name, decision) AS (VALUES (1, 'Supplier#000000001', 'exclude'), (2, 'wrong name', 'exclude'), (999999999, 'nobody', 'exclude'))
SELECT d.*, CASE WHEN s.s_suppkey IS NULL THEN 'missing' WHEN s.s_name IS NOT DISTINCT FROM d.s_name THEN 'ok' ELSE 'mismatch' END AS status FROM d LEFT JOIN supplier s ON s.s_suppkey = d.s_suppkey""")
def j09_evidence_join(t):
    supplier = t("supplier")
    return dedupe.evidence_check(_decisions(supplier), supplier, "s_suppkey", ["s_name"])


def _decisions(supplier: DataFrame) -> DataFrame:
    return supplier.sparkSession.createDataFrame([(1, "Supplier#000000001", "exclude"), (2, "wrong name", "exclude"), (999999999, "nobody", "exclude")], "s_suppkey int, s_name string, decision string")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_suppkey <> 1")
def j10_apply_exclusions(t):
    supplier = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    return dedupe.apply_decisions(supplier, dedupe.evidence_check(_decisions(supplier), supplier, "s_suppkey", ["s_name"]), "s_suppkey")


BITS = """bits AS (SELECT vec_id, label, list_sum([CASE WHEN embedding[k] > list_sort(embedding[2:64])[32] THEN (1::HUGEINT << (k - 1)::INTEGER) ELSE 0 END FOR k IN range(1, 65)])::HUGEINT AS u FROM embeddings)"""


def _bits(t):
    return t("embeddings").select("vec_id", "label", similarity.median_bits(F.col("embedding")).alias("bits"))


@query(f"""WITH {BITS}, h AS (SELECT *, bit_count(u::UBIGINT) AS n FROM bits) SELECT vec_id, n::INTEGER AS set_bits FROM h""")
def k15_median_bits(t):
    return _bits(t).select("vec_id", F.bit_count("bits").alias("set_bits"))


HAMMING = f"{BITS}, pr AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.u::UBIGINT, b.u::UBIGINT))::INTEGER AS distance FROM bits a JOIN bits b ON a.vec_id < b.vec_id)"


@query(f"WITH {HAMMING} SELECT * FROM pr WHERE distance <= 20")
def j15_hamming_pairs(t):
    return similarity.hamming_pairs(_bits(t), "vec_id", "bits", 20)


@query(f"WITH {HAMMING} SELECT * FROM pr WHERE distance <= 10")
def j15_hamming_pairs_banded(t):
    return similarity.hamming_pairs(_bits(t), "vec_id", "bits", 10)


TWO = """b2 AS (SELECT vec_id, label, list_sum([CASE WHEN embedding[k] > list_sort(embedding[2:64])[32] THEN (1::HUGEINT << (k - 1)::INTEGER) ELSE 0 END FOR k IN range(1, 65)])::UBIGINT AS u,
list_sum([CASE WHEN embedding[k + 1] > embedding[k] THEN (1::HUGEINT << (k - 1)::INTEGER) ELSE 0 END FOR k IN range(1, 64)])::UBIGINT AS v FROM embeddings),
p2 AS (SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.u, b.u))::INTEGER AS median_bits, bit_count(xor(a.v, b.v))::INTEGER AS difference_bits FROM b2 a JOIN b2 b ON a.vec_id < b.vec_id)"""
MOST = 20


def two_hashes(t):
    return t("embeddings").select("vec_id", "label", similarity.median_bits(F.col("embedding")).alias("median_bits"), similarity.difference_bits(F.col("embedding")).alias("difference_bits"))


def candidate_pairs(t):
    """Pairs within MOST bits by either hash, with both distances and the trigger."""
    return similarity.either_pairs(two_hashes(t), "vec_id", "median_bits", "difference_bits", MOST)


@query(f"WITH {TWO} SELECT left_id, right_id, median_bits, difference_bits, CASE WHEN median_bits <= {MOST} AND difference_bits <= {MOST} THEN 'both' WHEN median_bits <= {MOST} THEN 'median_bits' ELSE 'difference_bits' END AS trigger FROM p2 WHERE median_bits <= {MOST} OR difference_bits <= {MOST}")
def j15_either_hash(t):
    return candidate_pairs(t)


@query(f"""WITH {TWO} SELECT r.threshold::INTEGER AS threshold, count(*) FILTER (WHERE median_bits <= threshold) AS by_first, count(*) FILTER (WHERE difference_bits <= threshold) AS by_second,
count(*) FILTER (WHERE median_bits <= threshold OR difference_bits <= threshold) AS by_either, count(*) FILTER (WHERE median_bits <= threshold AND difference_bits <= threshold) AS by_both
FROM p2 CROSS JOIN (SELECT unnest(range(0, {MOST + 1})) AS threshold) r GROUP BY r.threshold""")
def a25_threshold_sweep(t):
    return similarity.threshold_sweep(candidate_pairs(t), "median_bits", "difference_bits", range(MOST + 1))


FOLDED = "vf AS (SELECT vec_id, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || vec_id), vec_id) - 1) % 5)::INTEGER AS fold FROM embeddings)"


@query(f"WITH {TWO}, {FOLDED} SELECT left_id, right_id, x.fold AS fold_left, y.fold AS fold_right, x.fold <> y.fold AS crosses FROM p2 JOIN vf x ON x.vec_id = left_id JOIN vf y ON y.vec_id = right_id WHERE median_bits <= {MOST} OR difference_bits <= {MOST}")
def g06_fold_crossings(t):
    folds = sampling.grouped_folds(t("embeddings").select("vec_id", "label"), "vec_id", "label", 5, 42)
    return graph.with_folds(candidate_pairs(t).select("left_id", "right_id"), folds, "vec_id")


_LABELS = "e AS (SELECT left_id AS a, right_id AS b FROM pr WHERE distance <= 20 UNION SELECT right_id, left_id FROM pr WHERE distance <= 20), reach(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.n, e.b FROM reach r JOIN e ON e.a = r.m), comp AS (SELECT n AS id, min(m) AS component FROM reach GROUP BY n)"


def _components(t):
    pairs = similarity.hamming_pairs(_bits(t), "vec_id", "bits", 20)
    return graph.components(t("embeddings").select(F.col("vec_id").alias("id")), pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b")))


@query(f"WITH RECURSIVE {HAMMING}, {_LABELS} SELECT id, component FROM comp")
def g01_components(t):
    return _components(t)


@query(f"""WITH RECURSIVE {HAMMING}, {_LABELS}, s AS (SELECT component, count(*) AS group_size FROM comp GROUP BY component)
SELECT id, component, CASE WHEN group_size > 1 THEN 'grp_' || component ELSE component::VARCHAR END AS group_key, group_size FROM comp JOIN s USING (component)""")
def g03_group_keys(t):
    return graph.group_keys(_components(t))


@query(f"WITH {HAMMING}, s AS (SELECT left_id AS id, distance FROM pr WHERE distance <= 20 UNION ALL SELECT right_id, distance FROM pr WHERE distance <= 20) SELECT id, min(distance) AS least, max(distance) AS greatest FROM s GROUP BY id")
def g04_evidence_fold(t):
    pairs = similarity.hamming_pairs(_bits(t), "vec_id", "bits", 20)
    return graph.evidence_fold(pairs.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "distance"), "distance")


@query("""WITH v AS (SELECT conv_id, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label, count(*) AS n FROM conversations GROUP BY ALL), m AS (SELECT conv_id, arg_max(label, n * 2 + label) AS stratum FROM v GROUP BY conv_id)
SELECT conv_id, stratum, ((row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || conv_id), conv_id) - 1) % 5)::INTEGER AS fold FROM m""")
def m01_grouped_folds(t):
    return sampling.grouped_folds(t("conversations").select("conv_id", (F.col("role") == "user").cast("int").alias("label")), "conv_id", "label", 5, 42)


@query("SELECT o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('42:' || o_orderkey), o_orderkey) <= 200")
def w06_sample_per_class(t):
    return sampling.sample_per(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 200, 42)


@query("SELECT doc_id, quality FROM labels QUALIFY row_number() OVER (PARTITION BY quality ORDER BY sha256('7:' || doc_id), doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def m05_down_sampled(t):
    return sampling.down_sampled(t("labels").select("doc_id", "quality"), "quality", "doc_id", 7)


@query("SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 12) AS weight FROM labels GROUP BY quality")
def m04_class_weights(t):
    return sampling.class_weights(t("labels"), "quality")


@query(f"""WITH {PRED}, s AS (SELECT lang, source, least(count(*) FILTER (WHERE label = 0), count(*) FILTER (WHERE label = 1)) AS per_class FROM p GROUP BY ALL)
SELECT p.lang, p.source, item_id, label, per_class FROM p JOIN s USING (lang, source) QUALIFY row_number() OVER (PARTITION BY p.lang, p.source, label ORDER BY item_id) <= per_class""")
def w05_balanced_match(t):
    return sampling.balanced_match(predictions(t).select("lang", "source", "item_id", "label"), ["lang", "source"], "label", "item_id")


@query("""WITH r AS (SELECT doc_id, lang, source, (row_number() OVER (PARTITION BY lang, source ORDER BY sha256('42:' || doc_id), doc_id) > 1)::INTEGER AS later FROM documents)
SELECT doc_id, lang, source FROM r QUALIFY row_number() OVER (PARTITION BY lang ORDER BY later, sha256('42:' || doc_id), doc_id) <= 30""")
def w04_diverse_sample(t):
    return sampling.diverse(t("documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 30, 42)


@query("""WITH r AS (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM labels),
s AS (SELECT quality, n, unnest(range(0, 3000 - n)) AS slot FROM (SELECT quality, count(*) AS n FROM labels GROUP BY quality) WHERE n < 3000)
SELECT s.quality, r.doc_id, s.slot, s.slot % 9 AS transform FROM s JOIN r ON r.quality = s.quality AND r.i = s.slot % s.n""")
def w08_top_up(t):
    return sampling.top_up(t("labels").select("quality", "doc_id"), "quality", "doc_id", 3000, 42)


REPLICATES = 10_000
INTERVALS = ("accuracy", "f1_macro", "mcc", "recall_positive", "recall_negative")


def _drawn(r: str, c: str, j: str, n: str) -> str:
    """sampling.drawn in SQL."""
    p, (a1, b1, c1, d1, e1, f1, g1) = sampling.PRIME, sampling.STEPS
    x = f"(((({r} + 1) * {a1} % {p} + ({j} % {p}) * {b1} % {p}) % {p} + ({c} + 1) * {c1}) % {p})"
    steps = [lambda x: f"({x} * (({x} + {d1}) % {p}) % {p})", lambda x: f"(({x} * {e1} + {f1}) % {p})", lambda x: f"({x} * (({x} + {g1}) % {p}) % {p})", lambda x: f"(({x} * {e1} + {d1}) % {p})", lambda x: f"({x} * (({x} + {f1}) % {p}) % {p} % {n})"]
    made = f"SELECT label, replicate, n, cut, {x}::BIGINT AS x FROM slots"
    for step in steps:
        made = f"SELECT label, replicate, n, cut, {step('x')} AS x FROM ({made})"
    return made


CELLS = f"""{PRED}, sizes AS (SELECT label, count(*) AS n, [{', '.join(f'count(*) FILTER (WHERE predicted * 2 + predicted_b < {k})' for k in (1, 2, 3, 4))}] AS cut FROM p GROUP BY label),
slots AS (SELECT label, n, cut, r.replicate, unnest(range(0, n)) AS slot FROM sizes CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS replicate) r),
drawn AS ({_drawn('replicate', 'label', 'slot', 'n')}),
cells AS (SELECT replicate, label, count(*) FILTER (WHERE x < cut[1]) AS n00, count(*) FILTER (WHERE x >= cut[1] AND x < cut[2]) AS n01, count(*) FILTER (WHERE x >= cut[2] AND x < cut[3]) AS n10, count(*) FILTER (WHERE x >= cut[3]) AS n11 FROM drawn GROUP BY ALL),
c AS (SELECT 'a' AS model, replicate, coalesce(sum(n10 + n11) FILTER (WHERE label = 1), 0)::BIGINT AS tp, coalesce(sum(n00 + n01) FILTER (WHERE label = 1), 0)::BIGINT AS fn, coalesce(sum(n00 + n01) FILTER (WHERE label = 0), 0)::BIGINT AS tn, coalesce(sum(n10 + n11) FILTER (WHERE label = 0), 0)::BIGINT AS fp FROM cells GROUP BY replicate
UNION ALL SELECT 'b', replicate, coalesce(sum(n01 + n11) FILTER (WHERE label = 1), 0)::BIGINT, coalesce(sum(n00 + n10) FILTER (WHERE label = 1), 0)::BIGINT, coalesce(sum(n00 + n10) FILTER (WHERE label = 0), 0)::BIGINT, coalesce(sum(n01 + n11) FILTER (WHERE label = 0), 0)::BIGINT FROM cells GROUP BY replicate),
mt AS (SELECT model, replicate, {', '.join(f'{v} AS {k}' for k, v in _SQL_METRICS.items() if k in INTERVALS)} FROM c)"""
LONG = " UNION ALL ".join(f"SELECT model, replicate, '{k}' AS metric, {k} AS v FROM mt" for k in INTERVALS)


def replicates(t):
    """Metrics of both predictors over the replicates: a row for each model and replicate."""
    drawn = sampling.bootstrap_cells(predictions(t).select("label", "predicted", "predicted_b"), "label", ["predicted", "predicted_b"], REPLICATES)
    long = drawn.select("replicate", "label", "n", F.inline(F.array(*(F.struct(F.lit(m).alias("model"), F.col(c).alias("predicted")) for m, c in (("a", "predicted"), ("b", "predicted_b"))))))
    return metrics.with_metrics(long.groupBy("model", "replicate").agg(*metrics.counts(weight=F.col("n"))), None)


def _by_metric(df: DataFrame) -> DataFrame:
    return df.select("model", "replicate", F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in INTERVALS))))


@query(f"WITH {CELLS}, lg AS ({LONG}) SELECT model, metric, round(quantile_cont(v, 0.025), 9) AS low, round(quantile_cont(v, 0.975), 9) AS high, round(avg(v), 9) AS mean, count(*) AS replicates FROM lg GROUP BY model, metric")
def m20_bootstrap_intervals(t):
    at = lambda q: F.round(F.percentile("v", q), 9)
    return _by_metric(replicates(t)).groupBy("model", "metric").agg(at(0.025).alias("low"), at(0.975).alias("high"), F.round(F.avg("v"), 9).alias("mean"), F.count("*").alias("replicates"))


@query(f"WITH {CELLS}, lg AS ({LONG}), d AS (SELECT a.metric, b.v - a.v AS x FROM lg a JOIN lg b ON a.replicate = b.replicate AND a.metric = b.metric AND a.model = 'a' AND b.model = 'b') SELECT metric, round(avg(x), 9) AS mean, round(quantile_cont(x, 0.025), 9) AS low, round(quantile_cont(x, 0.975), 9) AS high, count(*) FILTER (WHERE x > 0) AS above FROM d GROUP BY metric")
def m21_paired_bootstrap(t):
    both = _by_metric(replicates(t)).groupBy("metric", "replicate").agg((F.max(F.when(F.col("model") == "b", F.col("v"))) - F.max(F.when(F.col("model") == "a", F.col("v")))).alias("x"))
    x = F.col("x")
    return both.groupBy("metric").agg(F.round(F.avg(x), 9).alias("mean"), F.round(F.percentile(x, 0.025), 9).alias("low"), F.round(F.percentile(x, 0.975), 9).alias("high"), F.count_if(x > 0).alias("above"))


@query(f"""WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation), s AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey),
sl AS (SELECT n_regionkey, n, unnest(range(0, {REPLICATES})) AS replicate FROM s), dr AS (SELECT n_regionkey, n, replicate, unnest(range(0, n)) AS slot FROM sl)
SELECT dr.replicate::INTEGER AS replicate, dr.n_regionkey, dr.slot, r.n_nationkey FROM dr JOIN r ON r.n_regionkey = dr.n_regionkey AND r.i = ('0x' || substr(sha256('42:' || dr.replicate || ':' || dr.n_regionkey || ':' || dr.slot), 1, 15))::BIGINT % dr.n""")
def m18_bootstrap_indices(t):
    return sampling.bootstrap_draws(t("nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", REPLICATES, 42)


ARMS = "arms AS (SELECT event_type AS arm, strftime(ts, '%Y-%m-%d') AS fold, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def _arms(t):
    return t("events").groupBy(F.col("event_type").alias("arm"), F.date_format("ts", "yyyy-MM-dd").alias("fold")).agg(F.round(F.avg("value"), 6).alias("v"))


@query(f"WITH {ARMS}, d AS (SELECT b.v - a.v AS x FROM arms a JOIN arms b ON a.fold = b.fold AND a.arm = 'click' AND b.arm = 'error') SELECT round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, count(*) AS n, count(*) FILTER (WHERE x > 0) AS better, count(*) FILTER (WHERE x < 0) AS worse, count(*) FILTER (WHERE x = 0) AS tied, round(min(x), 6) AS least, round(max(x), 6) AS greatest FROM d")
def a08_paired_differences(t):
    return compare.difference_summary(compare.paired(_arms(t), "arm", "click", "error", ["fold"], "v"), digits=6)


@query(f"WITH {ARMS}, b AS (SELECT fold, arm FROM arms QUALIFY row_number() OVER (PARTITION BY fold ORDER BY v DESC, arm) = 1) SELECT arm, count(*) AS n, (sum(count(*)) OVER ())::BIGINT AS of FROM b GROUP BY arm")
def a12_selection_frequency(t):
    return compare.frequency(compare.best_per(_arms(t), ["fold"], "v", ["arm"]), "arm")


@query(f"WITH {ARMS}, s AS (SELECT arm, round(avg(v), 9) AS m, round(stddev_samp(v), 9) AS sd FROM arms GROUP BY arm), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, arm) AS rn FROM s), x AS (SELECT max(arm) FILTER (WHERE rn = 1) AS best, max(arm) FILTER (WHERE rn = 2) AS second, max(m) FILTER (WHERE rn = 1) - max(m) FILTER (WHERE rn = 2) AS gap, avg(sd) FILTER (WHERE rn <= 2) / sqrt(25.0::DOUBLE) AS se FROM r) SELECT best, second, round(gap, 7) AS margin, round(se, 7) AS standard_error, round(gap / se, 7) AS margin_in_se FROM x")
def a22_selection_margin(t):
    s = _arms(t).groupBy("arm").agg(F.round(F.avg("v"), 9).alias("m"), F.round(F.stddev_samp("v"), 9).alias("sd"))
    return compare.margin(s, "arm", "m", "sd", 25, digits=7)


@query("""SELECT 'document ids are unique' AS name, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) AS violations, (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)) = 0 AS passed
UNION ALL SELECT 'labels are 0 or 1', (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1)), (SELECT count(*) FROM labels WHERE quality NOT IN (0, 1)) = 0
UNION ALL SELECT 'labels have documents', (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)), (SELECT count(*) FROM labels ANTI JOIN documents USING (doc_id)) = 0
UNION ALL SELECT 'texts are unique', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)), (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) = 0""")
def e01_expectations(t):
    docs, labels = t("documents"), t("labels")
    return expect.audit([
        expect.Expectation("document ids are unique", expect.unique(docs, ["doc_id"])),
        expect.Expectation("labels are 0 or 1", labels.where(~F.col("quality").isin(0, 1))),
        expect.Expectation("labels have documents", labels.join(docs.select("doc_id"), "doc_id", "left_anti")),
        expect.Expectation("texts are unique", expect.unique(docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("text")), ["text"])),
    ])


NAMES = "SELECT p_partkey, p_name, p_type, p_name || ' (' || p_size || ')' AS n FROM part"


@query("""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type)), '[- ]', '_', 'g'), '_+', '_', 'g') AS class_name, substr(sha1(p_name), 1, 12) AS stable_id,
coalesce(nullif(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'image') AS safe_stem, translate(lower(p_brand || ' (x)'), ' ()', '_') AS slug,
coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('batik ' || p_name || ' (' || p_size || ')'), '\\s*\\(\\d+\\)\\s*$', ''), '[0-9]+$', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$|^batik_', '', 'g'), ''), 'tidak_diketahui') AS subtype,
lpad(p_size::VARCHAR, 4, '0') AS padded, lower(p_size::VARCHAR) IN ('1', 'true', 'yes', 'y') AS lenient FROM part""")
def p01_names(t):
    c = F.col
    return t("part").select(
        "p_partkey", text.class_name(c("p_type")).alias("class_name"), text.stable_id(c("p_name")).alias("stable_id"), text.safe_stem(c("p_name")).alias("safe_stem"), text.slug(F.concat("p_brand", F.lit(" (x)"))).alias("slug"),
        text.subtype(F.concat(F.lit("batik "), "p_name", F.lit(" ("), c("p_size").cast("string"), F.lit(")"))).alias("subtype"), F.lpad(c("p_size").cast("string"), 4, "0").alias("padded"), text.lenient_bool(c("p_size").cast("string")).alias("lenient"),
    )


@query("""SELECT page_id, split_part(url, '/', 3) AS host, list_extract(string_split(url, '/'), -2) AS parent, list_extract(string_split(url, '/'), -1) AS file FROM pages""")
def p30_path_parts(t):
    return t("pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), text.parent_name(F.col("url")).alias("parent"), text.file_name(F.col("url")).alias("file"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= 1000 THEN 'small' WHEN p_retailprice <= 1500 THEN 'medium' ELSE 'large' END AS price_bin, round(1 / (1 + exp(-greatest(-50, least(50, (p_retailprice - 1200) / 100)))), 12) AS logistic,
round(ln(1 + p_retailprice), 12) AS log_price, p_size::DOUBLE / greatest(p_size - 10, 1) AS aspect FROM part""")
def p16_numeric_columns(t):
    price = F.col("p_retailprice")
    return t("part").select("p_partkey", scores.right_closed(price, [1000, 1500], ["small", "medium", "large"]).alias("price_bin"), F.round(scores.logistic((price - 1200) / 100), 12).alias("logistic"), F.round(F.log1p(price), 12).alias("log_price"), (F.col("p_size") / F.greatest(F.col("p_size") - 10, F.lit(1))).alias("aspect"))


# What reads alike in Spark SQL and DuckDB; names in brackets are tables.
both("a01_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM [lineitem] GROUP BY l_returnflag, l_linestatus", "lineitem")
both("a03_mean_std", "SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_quantity, round(stddev_samp(l_quantity), 6) AS std_quantity, round(avg(l_discount), 6) AS mean_discount, round(stddev_samp(l_discount), 6) AS std_discount FROM [lineitem] GROUP BY l_returnflag", "lineitem")
both("a04_descriptives", "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, median(value) AS median, min(value) AS least, max(value) AS greatest FROM [events] GROUP BY event_type", "events")
both("a10_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM [orders] GROUP BY o_orderstatus", "orders")
both("a11_value_counts", "SELECT p_brand, count(*) AS n FROM [part] GROUP BY p_brand ORDER BY n DESC, p_brand", "part")
both("a19_counts_of_counts", "SELECT n AS orders_each, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM [orders] GROUP BY o_custkey) c GROUP BY n", "orders")
both("a20_zero_filled", "SELECT c.c_custkey, coalesce(o.n, 0) AS n FROM [customer] c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM [orders] GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey", "customer orders")
both("a24_entropy", "SELECT round(-sum(p * log2(p)), 9) AS entropy FROM (SELECT CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM [events]) AS p FROM [events] GROUP BY event_type) h", "events")
both("j01_inner", "SELECT n.n_name, r.r_name, count(*) AS customers, round(sum(c.c_acctbal), 2) AS balance FROM [customer] c JOIN [nation] n ON c.c_nationkey = n.n_nationkey JOIN [region] r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name", "customer nation region")
both("j12_lineage_semi", "SELECT l_orderkey, l_linenumber FROM [lineitem] WHERE l_orderkey IN (SELECT o_orderkey FROM [orders] WHERE o_orderstatus = 'F')", "lineitem orders")
both("j14_cross_grid", "SELECT r.r_name, s.o_orderstatus FROM [region] r CROSS JOIN (SELECT DISTINCT o_orderstatus FROM [orders]) s", "region orders")
both("j17_composite_key", "SELECT a.conv_id, a.turn, a.role, b.role AS next_role FROM [conversations] a JOIN [conversations] b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1", "conversations")
both("w02_group_size", "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang, source) AS group_size FROM [documents]", "documents")
both("w03_group_flags", "SELECT o_orderkey, min(o_orderstatus) OVER (PARTITION BY o_custkey) <> max(o_orderstatus) OVER (PARTITION BY o_custkey) AS mixed FROM [orders]", "orders")
both("w11_top", "SELECT o_orderkey, o_totalprice FROM [orders] ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "orders")
both("w13_sequence_ids", "SELECT vec_id, concat('X', lpad(CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) AS VARCHAR(20)), 4, '0')) AS sequence_id FROM [embeddings]", "embeddings")
both("g07_group_purity", "SELECT o_custkey FROM [orders] GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1", "orders")
both("s08_union_all", "SELECT s_suppkey AS id, s_nationkey AS nation, 'supplier' AS kind FROM [supplier] UNION ALL SELECT c_custkey, c_nationkey, 'customer' FROM [customer]", "supplier customer")
both("s09_set_difference", "SELECT c_nationkey FROM [customer] EXCEPT SELECT s_nationkey FROM [supplier]", "customer supplier")
both("p20_filters", "SELECT l_orderkey, l_linenumber FROM [lineitem] WHERE l_discount BETWEEN 0.02 AND 0.05 AND NOT l_returnflag = 'A' AND l_quantity IS NOT NULL", "lineitem")
both("p26_text_tests", "SELECT p_partkey, contains(p_name, 'ring') AS has_ring, p_type LIKE 'ECO%' AS economy FROM [part]", "part")
both("r12_by_arm", "SELECT 'all' AS arm, event_type, round(avg(value), 6) AS mean FROM [events] GROUP BY event_type UNION ALL SELECT 'high', event_type, round(avg(value), 6) FROM [events] WHERE value > 50 GROUP BY event_type", "events")
both("a05_unpivoted", "SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, max(v) AS greatest FROM (SELECT 'tax' AS metric, l_tax AS v FROM [lineitem] UNION ALL SELECT 'discount', l_discount FROM [lineitem]) u GROUP BY metric", "lineitem")
both("r15_top_slices", "SELECT source, count(*) AS n, sum(n_chars) AS characters FROM [documents] GROUP BY source ORDER BY n DESC, source LIMIT 4", "documents")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j02_left(t):
    return joins.left_one_to_one(t("documents").select("doc_id", "lang"), t("labels").select("doc_id", "quality", "toxic"), ["doc_id"])


@query("""WITH m AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS price, count(*) AS lines FROM lineitem GROUP BY l_orderkey), f AS (SELECT o.o_orderkey AS a, m.k AS b, abs(o.o_totalprice::DOUBLE - m.price::DOUBLE) AS far FROM orders o FULL JOIN m ON o.o_orderkey = m.k)
SELECT 'price' AS value, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS compared, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS unmatched, round(max(far), 2) AS largest, count(*) FILTER (WHERE a IS NULL OR b IS NULL) = 0 AND coalesce(max(far), 0) <= 0.01 AS within FROM f""")
def j03_reconcile(t):
    made = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("price"))
    return joins.reconciled(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price")), made, ["k"], ["price"], 0.01).withColumn("largest", F.round("largest", 2))


@query("""WITH f AS (SELECT n_chars AS a, length(text) AS b FROM documents) SELECT 'n_chars' AS value, count(*) AS compared, 0::BIGINT AS unmatched, max(abs(a - b))::DOUBLE AS largest, max(abs(a - b)) <= 0 AS within FROM f""")
def a23_largest_deviation(t):
    """The stored lengths of texts against those counted anew."""
    d = t("documents")
    return joins.reconciled(d.select("doc_id", "n_chars"), d.select("doc_id", F.length("text").alias("n_chars")), ["doc_id"], ["n_chars"], 0.0)


@query("""SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (WHERE b IS NULL) AS not_in_manifest, count(*) FILTER (WHERE a IS NULL) AS not_in_rows, count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL AND q <> g) AS label_differs
FROM (SELECT l.doc_id AS a, d.doc_id AS b, l.quality AS q, (d.n_chars >= 1000)::INTEGER AS g FROM labels l FULL JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d ON l.doc_id = d.doc_id)""")
def j08_alignment(t):
    manifest = t("documents").where("doc_id % 3 <> 0").select("doc_id", (F.col("n_chars") >= 1000).cast("int").alias("quality"))
    return joins.alignment(t("labels").select("doc_id", F.col("quality").cast("int").alias("quality")), manifest, "doc_id", "quality")


@query("SELECT doc_id, quality, toxic FROM labels")
def j08_align_to_manifest(t):
    """Labels, doubled, brought to the labelled documents' keys."""
    labels = t("labels").select("doc_id", "quality", "toxic")
    return joins.aligned(labels.unionAll(labels), labels, "doc_id", "quality", ["toxic"])


@query("SELECT s.s_nationkey, s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey")
def j21_registered(t):
    nations = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.registered(t("supplier").select("s_nationkey", "s_suppkey", "s_name"), nations, "s_nationkey")


_ALIAS = {"SVM (RBF)": "SVM-RBF", "Random Forest": "RF", "Logistic Regression": "LR"}


@query("""SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS class, quality AS label, CASE toxic WHEN 1 THEN 'SVM-RBF' ELSE 'RF' END AS alias, (CASE quality WHEN 1 THEN 'good' ELSE 'bad' END) || '+' || toxic AS condition, toxic::VARCHAR AS second, toxic = 1 AS strict FROM labels""")
def p08_mapped_names(t):
    c = F.col
    named = t("labels").select("doc_id", text.mapped(c("quality").cast("int"), {0: "bad", 1: "good"}, "label").alias("class"), "toxic").withColumn("label", text.mapped(c("class"), {"bad": 0, "good": 1}, "class"))
    key = text.condition_key(c("class"), c("toxic").cast("string"))
    model = F.when(c("toxic") == 1, "SVM (RBF)").otherwise("Random Forest")
    strict = text.strict_bool(F.when(c("toxic") == 1, " True ").otherwise("FALSE"))
    return named.select("doc_id", "class", "label", text.mapped(model, _ALIAS, "model").alias("alias"), key.alias("condition"), F.get(text.condition_parts(key), F.lit(1)).alias("second"), strict.alias("strict"))


@query("SELECT p_partkey, 'stem' || p_size || '__' || substr(sha1(p_name), 1, 12) || '__transform_' || lpad((p_size % 9)::VARCHAR, 4, '0') || '.jpg' AS name FROM part")
def p06_derived_names(t):
    return t("part").select("p_partkey", text.derived_name(F.concat(F.lit("stem"), F.col("p_size").cast("string")), text.stable_id(F.col("p_name")), F.col("p_size") % 9, F.lit(".jpg")).alias("name"))


@query("""SELECT p_partkey, round(ln(1 + p_size), 9) AS log_size, round(ln(1 + p_retailprice), 9) AS log_width, round(ln(1 + p_size * 2), 9) AS log_height, round(ln(1 + p_retailprice * (p_size * 2)), 9) AS log_pixels, round(p_retailprice / greatest(p_size * 2, 1), 9) AS aspect FROM part""")
def p17_log_columns(t):
    made = scores.log_metadata(F.col("p_size"), F.col("p_retailprice").cast("double"), F.col("p_size") * 2)
    out = t("part").select("p_partkey", *made)
    return out.select("p_partkey", *(F.round(c, 9).alias(c) for c in out.columns[1:]))


@query("""SELECT event_id, CASE WHEN abs(value) >= 100 THEN format('{:,.1f}', value) ELSE printf('%.4f', value) END AS shown, value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AS finite FROM (SELECT event_id, round(value::DOUBLE * 8) / 8 AS value FROM events)""")
def p25_feature_text(t):
    v = F.col("value")
    return t("events").select("event_id", (F.round(F.col("value").cast("double") * 8) / 8).alias("value")).select("event_id", scores.feature_text(v).alias("shown"), scores.is_finite(v).alias("finite"))


def _pairwise(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS r FROM lineitem" for a in names for b in names)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


@query(_pairwise(_NUMBERS))
def a13_correlation(t):
    return compare.correlations(t("lineitem"), _NUMBERS, 8)


@query("SELECT source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY source, lang")
def a26_counts_by_class(t):
    return t("documents").groupBy("source", F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT conv_id, turn, ((row_number() OVER (PARTITION BY (role = 'user')::INTEGER ORDER BY sha256('42:' || (conv_id * 1000 + turn)), conv_id * 1000 + turn) - 1) % 5)::INTEGER AS fold FROM conversations)
SELECT conv_id, count(*) AS n, count(DISTINCT fold) AS folds, count(DISTINCT fold) = 1 AS once FROM f GROUP BY conv_id""")
def w14_exactly_once(t):
    """Of folds dealt by turn and not by conversation: conversations whose turns are not in one fold."""
    rows = t("conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("row"), (F.col("role") == "user").cast("int").alias("label"))
    folds = sampling.grouped_folds(rows, "row", "label", 5, 42).select("row", "fold")
    return rows.join(folds, "row").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), (F.count_distinct("fold") == 1).alias("once"))


_GROUPED = """g AS (SELECT doc_id, sha256(text) AS digest, (lang = 'en')::INTEGER AS label FROM documents WHERE lang IS NOT NULL), v AS (SELECT digest, label, count(*) AS n FROM g GROUP BY ALL), mj AS (SELECT digest, arg_max(label, n * 2 + label) AS stratum FROM v GROUP BY digest),
gf AS (SELECT digest, ((row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || digest), digest) - 1) % 5)::INTEGER AS fold FROM mj), uf AS (SELECT doc_id, ((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || doc_id), doc_id) - 1) % 5)::INTEGER AS fold FROM g),
fo AS (SELECT 'grouped' AS protocol, g.doc_id, g.digest, gf.fold FROM g JOIN gf USING (digest) UNION ALL SELECT 'ungrouped', g.doc_id, g.digest, uf.fold FROM g JOIN uf USING (doc_id))"""


def _protocols(t):
    rows = t("documents").where("lang IS NOT NULL").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (F.col("lang") == "en").cast("int").alias("label"))
    made = [rows.join(sampling.grouped_folds(rows, by, "label", 5, 42).select(by, "fold"), by).select(F.lit(name).alias("protocol"), "doc_id", "digest", "fold") for name, by in (("grouped", "digest"), ("ungrouped", "doc_id"))]
    return made[0].unionByName(made[1])


@query(f"WITH {_GROUPED}, l AS (SELECT protocol, digest FROM fo GROUP BY ALL HAVING count(DISTINCT fold) > 1) SELECT 'copies across folds, ' || p AS name, (SELECT count(*) FROM l WHERE protocol = p) AS violations, (SELECT count(*) FROM l WHERE protocol = p) = 0 AS passed FROM (VALUES ('grouped'), ('ungrouped')) x(p)")
def m02_leakage(t):
    rows = _protocols(t)
    return expect.audit([expect.Expectation(f"copies across folds, {p}", sampling.leaking(rows.where(F.col("protocol") == p), "fold", "digest")) for p in ("grouped", "ungrouped")])


@query(f"WITH {_GROUPED}, s AS (SELECT protocol, fold, count(*) AS n FROM fo GROUP BY ALL), l AS (SELECT protocol, digest FROM fo GROUP BY ALL HAVING count(DISTINCT fold) > 1), k AS (SELECT protocol, count(*) AS n FROM l GROUP BY protocol) SELECT s.protocol, min(s.n) AS least, max(s.n) AS greatest, coalesce(any_value(k.n), 0) AS leaking FROM s LEFT JOIN k USING (protocol) GROUP BY s.protocol")
def r13_protocols(t):
    rows = _protocols(t)
    sizes = rows.groupBy("protocol", "fold").agg(F.count("*").alias("n")).groupBy("protocol").agg(F.min("n").alias("least"), F.max("n").alias("greatest"))
    leaks = rows.groupBy("protocol", "digest").agg(F.count_distinct("fold").alias("k")).where("k > 1").groupBy("protocol").agg(F.count("*").alias("leaking"))
    return sizes.join(leaks, "protocol", "left").select("protocol", "least", "greatest", F.coalesce("leaking", F.lit(0)).alias("leaking"))


@query("""WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 70 <> 0), x AS ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) SELECT * FROM x""")
def m27_frame_reproduction(t):
    """The rows in which a table and a damaged copy of it differ."""
    a = t("documents").select("doc_id", "n_chars")
    changed = F.when(F.col("doc_id") % 50 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast(a.schema["n_chars"].dataType)
    return expect.same_rows(a, a.where("doc_id % 70 <> 0").withColumn("n_chars", changed))


@query("""WITH n AS (SELECT quality, count(*) AS originals FROM labels GROUP BY quality), r AS (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS c FROM labels),
s AS (SELECT quality, originals, unnest(range(0, 3000 - originals)) AS slot FROM n WHERE originals < 3000), d AS (SELECT s.quality, r.doc_id, s.slot % 9 AS transform FROM s JOIN r ON r.quality = s.quality AND r.i = s.slot % s.originals)
SELECT n.quality, any_value(originals) AS originals, count(d.doc_id) AS derivatives, count(DISTINCT d.doc_id) AS sources, count(DISTINCT d.transform) AS transforms, any_value(originals) + count(d.doc_id) AS total FROM n LEFT JOIN d USING (quality) GROUP BY n.quality""")
def a27_augmentation_summary(t):
    labels = t("labels").select("quality", "doc_id")
    made = sampling.top_up(labels, "quality", "doc_id", 3000, 42).groupBy("quality").agg(F.count("*").alias("derivatives"), F.count_distinct("doc_id").alias("sources"), F.count_distinct("transform").alias("transforms"))
    out = labels.groupBy("quality").agg(F.count("*").alias("originals")).join(made, "quality", "left").fillna(0, ["derivatives", "sources", "transforms"])
    return out.withColumn("total", F.col("originals") + F.col("derivatives"))


@query(f"""WITH {PRED}, x AS (SELECT lang, source, 'short' AS family, label, predicted AS g FROM p UNION ALL SELECT lang, source, 'long', label, predicted_b FROM p), e AS (SELECT family, lang, count(*) FILTER (WHERE label = g) / count(*)::DOUBLE AS acc FROM x WHERE source = 'src1' GROUP BY ALL)
SELECT x.family, x.lang, count(*) AS n, round(count(*) FILTER (WHERE label = g) / count(*)::DOUBLE, 9) AS accuracy, round(any_value(e.acc), 9) AS outside FROM x JOIN e ON e.family = x.family AND e.lang = x.lang WHERE x.source <> 'src1' GROUP BY x.family, x.lang""")
def r02_families(t):
    """Two families of predictors side by side, each looked up in its scores on the source set kept outside; without a match a row is left out."""
    p = predictions(t)
    long = p.select("lang", "source", "label", F.inline(F.array(F.struct(F.lit("short").alias("family"), F.col("predicted").alias("g")), F.struct(F.lit("long").alias("family"), F.col("predicted_b").alias("g")))))
    scored = lambda df: df.groupBy("family", "lang").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("label") == F.col("g")) / F.count("*"), 9).alias("accuracy"))
    outside = scored(long.where("source = 'src1'")).select("family", "lang", F.col("accuracy").alias("outside"))
    return scored(long.where("source <> 'src1'")).join(outside, ["family", "lang"])


@query(f"""WITH c AS (SELECT d.source, count(*) FILTER (WHERE (d.lang IN ('en', 'fr')) AND l.quality = 1) AS tp, count(*) FILTER (WHERE coalesce(d.lang NOT IN ('en', 'fr'), true) AND l.quality = 1) AS fn, count(*) FILTER (WHERE coalesce(d.lang NOT IN ('en', 'fr'), true) AND l.quality = 0) AS tn, count(*) FILTER (WHERE (d.lang IN ('en', 'fr')) AND l.quality = 0) AS fp
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source) SELECT *, {_SQL_ALL} FROM c""")
def m15_fixed_rule(t):
    from ledgerframe.operators import training

    rows = t("documents").select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("lang")).join(t("labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return metrics.evaluate(training.extension_rule(rows, "lang", ["en", "fr"]), ["source"])


@query("""WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents), o AS (SELECT doc_id, source FROM f WHERE r = 1) SELECT doc_id, source FROM o QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) <= 12""")
def w15_distinct_then_sample(t):
    """One document of each language of a source, then at most 12 of them by hash."""
    first = dedupe.keep_first(t("documents").select("doc_id", "source", "lang"), ["source", "lang"], ["doc_id"])
    return sampling.sample_per(first.select("doc_id", "source"), ["source"], "doc_id", 12, 42)


@query("""SELECT 'documents have the columns' AS name, 0::BIGINT AS violations, true AS passed UNION ALL SELECT 'both labels are there', 2 - count(DISTINCT quality), 2 - count(DISTINCT quality) = 0 FROM labels
UNION ALL SELECT 'scores are finite', count(*) FILTER (WHERE NOT (value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))), count(*) FILTER (WHERE NOT (value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value))) = 0 FROM events
UNION ALL SELECT 'customers are no suppliers', (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)), (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT s_suppkey FROM supplier)) = 0
UNION ALL SELECT 'lines have orders', (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey), (SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) = 0
UNION ALL SELECT 'line numbers run from 1', (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*))), (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*))) = 0
UNION ALL SELECT 'vectors have 64 numbers', count(*) FILTER (WHERE len(embedding) <> 64), count(*) FILTER (WHERE len(embedding) <> 64) = 0 FROM embeddings
UNION ALL SELECT 'discounts are shares', count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 1)), count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 1)) = 0 FROM lineitem
UNION ALL SELECT 'one class a group', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus))), (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) <> max(o_orderstatus))) = 0
UNION ALL SELECT 'turns run on', (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(DISTINCT turn))), (SELECT count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) - min(turn) + 1 <> count(DISTINCT turn))) = 0""")
def e02_expectations(t):
    """The clusters of checks that the protocols rely on: columns, classes, finite values, disjoint and complete keys, sequences, shapes, ranges, purity."""
    labels, lines = t("labels"), t("lineitem")
    return expect.audit([
        expect.Expectation("documents have the columns", expect.lacking(t("documents"), ["doc_id", "text", "lang", "source"])),
        expect.Expectation("both labels are there", expect.absent(labels, "quality", [0, 1])),
        expect.Expectation("scores are finite", t("events").where(~scores.is_finite(F.col("value")))),
        expect.Expectation("customers are no suppliers", expect.disjoint(t("customer").select(F.col("c_custkey").alias("k")), t("supplier").select(F.col("s_suppkey").alias("k")), "k")),
        expect.Expectation("lines have orders", expect.orphans(lines, t("orders"), "l_orderkey", "o_orderkey")),
        expect.Expectation("line numbers run from 1", expect.broken_sequence(lines, ["l_orderkey"], "l_linenumber", 1)),
        expect.Expectation("vectors have 64 numbers", t("embeddings").where(F.size("embedding") != 64)),
        expect.Expectation("discounts are shares", expect.outside(lines, "l_discount", 0, 1)),
        expect.Expectation("one class a group", expect.mixed(t("orders"), "o_custkey", "o_orderstatus")),
        expect.Expectation("turns run on", expect.gaps(t("conversations"), ["conv_id"], "turn")),
    ])
