"""Report rows that are queries: formatted comparisons, inventories, compositions, audits; image texture and threshold grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerframe.functions import text as text_functions
from ledgerframe.operators import compare, dedupe, graph, images, joins, metrics, sampling, similarity
from ledgerframe.plans.registry import CELLS, F1, FOLDED, LONG, MOST, PRED, TWO, both, candidate_pairs, predictions, query, replicates

PIXELS = """im AS (SELECT vec_id, [coalesce(floor(255.0::DOUBLE * (v::DOUBLE - list_min(embedding)::DOUBLE) / nullif(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 0))::INTEGER, 0) FOR v IN embedding] AS g FROM embeddings),
px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, g[i + 1] AS v FROM im, (SELECT unnest(range(0, 64)) AS i))"""


def _pictures(t):
    return t("embeddings").select("vec_id", images.gray_image(F.col("embedding"), 8, 8).alias("image"))


@query(f"""WITH {PIXELS}, st(k, dy, dx) AS (VALUES (0, 0, 1), (1, -1, 1), (2, -1, 0), (3, -1, -1)),
jo AS (SELECT a.vec_id, k, a.v // 16 AS p, b.v // 16 AS q FROM px a CROSS JOIN st JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx),
sy AS (SELECT * FROM jo UNION ALL SELECT vec_id, k, q, p FROM jo), ce AS (SELECT vec_id, k, p, q, count(*)::DOUBLE AS n FROM sy GROUP BY ALL),
pr AS (SELECT *, n / sum(n) OVER (PARTITION BY vec_id, k) AS w FROM ce), pk AS (SELECT vec_id, k, sum(w / (1 + (p - q) * (p - q))) AS h, -sum(w * log2(w)) AS e FROM pr GROUP BY ALL),
gl AS (SELECT vec_id, avg(h) AS h, avg(e) AS e FROM pk GROUP BY vec_id),
ri(bit, dy, dx) AS (VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)),
lb AS (SELECT a.vec_id, a.y, a.x, sum(CASE WHEN b.v >= a.v THEN 1 << bit ELSE 0 END) AS code FROM px a CROSS JOIN ri JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.y BETWEEN 1 AND 6 AND a.x BETWEEN 1 AND 6 GROUP BY ALL),
lh AS (SELECT vec_id, code, count(*) / 36.0::DOUBLE AS w FROM lb GROUP BY ALL), le AS (SELECT vec_id, -sum(w * log2(w)) AS e FROM lh GROUP BY vec_id)
SELECT gl.vec_id, round(gl.h, 9) AS glcm_homogeneity, round(gl.e, 9) AS glcm_entropy, round(le.e, 9) AS lbp_entropy FROM gl JOIN le USING (vec_id)""")
def k09_texture(t):
    made = images.texture(_pictures(t), "vec_id")
    return made.select("vec_id", *(F.round(c, 9).alias(c) for c in ("glcm_homogeneity", "glcm_entropy", "lbp_entropy")))


@query()
def k16_image_hashes(t):
    return images.hashes(_pictures(t), "vec_id")


@query()
def m28_hash_candidates(t):
    """Pairs of pictures that are near by either of their two hashes, with the trigger."""
    made = images.hashes(_pictures(t), "vec_id").select("vec_id", images.hash_bits(F.col("phash_64")).alias("phash"), images.hash_bits(F.col("dhash_64")).alias("dhash"))
    return similarity.either_pairs(made, "vec_id", "phash", "dhash", 16)


@query()
def k14_augmentations(t):
    made = images.augmentations(_pictures(t), "vec_id", originals=True)
    return made.select("vec_id", "transform", F.sha2("image.data", 256).alias("digest"))


@query()
def k19_pair_checks(t):
    pairs = candidate_pairs(t).select("left_id", "right_id", "trigger")
    p = _pictures(t)
    left, right = (p.select(F.col("vec_id").alias(f"{s}_id"), F.col("image").alias(s)) for s in ("left", "right"))
    return images.pair_checks(pairs.join(left, "left_id").join(right, "right_id"), ["left_id", "right_id", "trigger"])


FIRST_GRID, SECOND_GRID = range(14, 21), range(15, 21)


@query(f"""WITH RECURSIVE {TWO}, grid(a, b) AS (SELECT x, y FROM (SELECT unnest(range(14, 21))::INTEGER AS x) CROSS JOIN (SELECT unnest(range(15, 21))::INTEGER AS y)), near AS (SELECT * FROM p2 WHERE median_bits <= 20 OR difference_bits <= 20),
ed AS (SELECT a, b, left_id AS f, right_id AS t FROM near JOIN grid ON median_bits <= a OR difference_bits <= b UNION ALL SELECT a, b, right_id, left_id FROM near JOIN grid ON median_bits <= a OR difference_bits <= b),
reach(a, b, n, m) AS (SELECT a, b, vec_id, vec_id FROM embeddings CROSS JOIN grid UNION SELECT r.a, r.b, r.n, ed.t FROM reach r JOIN ed ON ed.a = r.a AND ed.b = r.b AND ed.f = r.m), co AS (SELECT a, b, n, min(m) AS c FROM reach GROUP BY a, b, n),
sz AS (SELECT a, b, c, count(*) AS s FROM co GROUP BY a, b, c), cp AS (SELECT a, b, count(*) AS pairs FROM near JOIN grid ON median_bits <= a OR difference_bits <= b GROUP BY a, b)
SELECT sz.a AS first, sz.b AS second, coalesce(any_value(cp.pairs), 0) AS pairs, count(*) AS n_groups, count(*) FILTER (WHERE s > 1) AS multi_groups, coalesce(sum(s) FILTER (WHERE s > 1), 0)::BIGINT AS in_multi, max(s) AS largest FROM sz LEFT JOIN cp ON cp.a = sz.a AND cp.b = sz.b GROUP BY sz.a, sz.b""")
def g05_threshold_grid(t):
    """Confirmed pairs and groups for each cell of two thresholds."""
    nodes = t("embeddings").select(F.col("vec_id").alias("id"))
    return graph.grid_facts(nodes, candidate_pairs(t), "median_bits", "difference_bits", FIRST_GRID, SECOND_GRID)


@query(f"WITH {TWO}, {FOLDED} SELECT left_id, right_id, x.fold AS fold_left, y.fold AS fold_right, x.fold <> y.fold AS crosses, median_bits, difference_bits, printf('%d / %d', median_bits, difference_bits) AS distances FROM p2 JOIN vf x ON x.vec_id = left_id JOIN vf y ON y.vec_id = right_id WHERE median_bits <= {MOST} AND difference_bits <= 26")
def r09_pair_table(t):
    folds = sampling.grouped_folds(t("embeddings").select("vec_id", "label"), "vec_id", "label", 5, 42)
    pairs = candidate_pairs(t).where(f"median_bits <= {MOST} AND difference_bits <= 26").drop("trigger")
    return graph.with_folds(pairs, folds, "vec_id").withColumn("distances", F.format_string("%d / %d", "median_bits", "difference_bits"))


_SETTINGS = "SELECT o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'O' END AS status, CASE WHEN month(o_orderdate) <= 6 THEN 'first' ELSE 'second' END AS half, round(avg(o_totalprice), 4) AS y FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY ALL"


@query(f"""WITH s AS ({_SETTINGS}), d AS (SELECT 'priority' AS factor, b.y - a.y AS x FROM s a JOIN s b ON a.status = b.status AND a.half = b.half AND a.priority = '1-URGENT' AND b.priority = '5-LOW'
UNION ALL SELECT 'status', b.y - a.y FROM s a JOIN s b ON a.priority = b.priority AND a.half = b.half AND a.status = 'F' AND b.status = 'O' UNION ALL SELECT 'half', b.y - a.y FROM s a JOIN s b ON a.priority = b.priority AND a.status = b.status AND a.half = 'first' AND b.half = 'second')
SELECT factor, count(*) AS pairs, round(avg(x), 4) AS mean, round(min(x), 4) AS least, round(max(x), 4) AS greatest FROM d GROUP BY factor""")
def a09_factor_effects(t):
    o = t("orders").where("o_orderpriority IN ('1-URGENT', '5-LOW')")
    rows = o.groupBy(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "F", "F").otherwise("O").alias("status"), F.when(F.month("o_orderdate") <= 6, "first").otherwise("second").alias("half")).agg(F.round(F.avg("o_totalprice"), 4).alias("y"))
    return joins.factor_effects(rows, {"priority": ("1-URGENT", "5-LOW"), "status": ("F", "O"), "half": ("first", "second")}, "y", 4)


_DAYS_SQL = "SELECT event_type, CAST(ts AS DATE) AS d, round(avg(value), 6) AS v FROM events GROUP BY event_type, CAST(ts AS DATE)"


@query(f"WITH a AS ({_DAYS_SQL}) SELECT x.d, x.v AS base, y.v AS other, y.v - x.v AS difference, 'event_type' AS factor FROM a x JOIN a y ON x.d = y.d AND x.event_type = 'click' AND y.event_type = 'error'")
def j05_aligned_contrast(t):
    days = t("events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.round(F.avg("value"), 6).alias("v"))
    return joins.contrast(days, "event_type", "click", "error", ["d"], "v")


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def a26_pivoted(t):
    counted = t("documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return compare.pivoted(counted, ["source"], "lang", "n", ["de", "en", "fr"]).fillna(0)


@query("""WITH c AS (SELECT conv_id, conv_id % 5 AS fold, role, count(*) AS n FROM conversations GROUP BY ALL), h AS (SELECT fold, role, n, count(*) AS k FROM c GROUP BY ALL)
SELECT c.fold, c.role, sum(c.n)::BIGINT AS rows_held, min(c.n) AS least, max(c.n) AS greatest, round(avg(c.n), 9) AS mean, any_value(d.distribution) AS distribution
FROM c JOIN (SELECT fold, role, string_agg(n || ':' || k, ';' ORDER BY n) AS distribution FROM h GROUP BY fold, role) d ON d.fold = c.fold AND d.role = c.role GROUP BY c.fold, c.role""")
def r04_fold_composition(t):
    each = t("conversations").groupBy("conv_id", (F.col("conv_id") % 5).alias("fold"), "role").agg(F.count("*").alias("n"))
    hist = each.groupBy("fold", "role", "n").agg(F.count("*").alias("k"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "k"))), lambda s: F.concat_ws(":", s["n"].cast("string"), s["k"].cast("string"))), ";")  # a pair for each distinct count
    total = F.sum(F.col("n") * F.col("k"))
    return hist.groupBy("fold", "role").agg(total.alias("rows_held"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.round(total / F.sum("k"), 9).alias("mean"), text.alias("distribution"))


@query("SELECT event_type, round(quantile_cont(value, 0.025), 9) AS low, round(quantile_cont(value, 0.975), 9) AS high, round(median(value), 9) AS middle FROM events GROUP BY event_type")
def a21_percentiles(t):
    at = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975), F.lit(0.5)))
    return t("events").groupBy("event_type").agg(at.alias("q")).select("event_type", *(F.round(F.get("q", F.lit(i)), 9).alias(n) for i, n in enumerate(("low", "high", "middle"))))


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, CASE WHEN (props::JSON ->> '$.k')::BIGINT > 50 THEN 'high' ELSE 'low' END AS band FROM events""")
def p34_json_cell(t):
    k = F.element_at(F.from_json("props", "map<string,bigint>"), "k")
    return t("events").select("event_id", k.alias("k"), F.when(k > 50, "high").otherwise("low").alias("band"))


@query("SELECT vec_id, array_to_string([round(x::DOUBLE, 3)::DECIMAL(9, 3)::VARCHAR FOR x IN embedding[1:5]], ',') AS rounded FROM embeddings")
def p35_rounded_list(t):
    v = F.transform(F.slice("embedding", 1, 5), lambda x: F.round(x.cast("double"), 3).cast("decimal(9,3)").cast("string"))
    return t("embeddings").select("vec_id", F.array_join(v, ",").alias("rounded"))


@query(r"""WITH s AS (SELECT item_id, string_split(regexp_replace(text, '([.;:]) ([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS now FROM benchmark), m AS (SELECT a.item_id, a.now, coalesce(b.now, []) AS next FROM s a LEFT JOIN s b ON b.item_id = a.item_id + 1),
u AS (SELECT item_id, unnest(now) AS sentence, unnest(range(1, len(now) + 1)) AS i, next FROM m), f AS (SELECT item_id, sentence, min(i) AS i FROM u WHERE NOT list_contains(next, sentence) GROUP BY item_id, sentence) SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i)::INTEGER AS ordinal, sentence FROM f""")
def p28_sentence_changes(t):
    """Sentences of a benchmark item that the next item lacks, numbered in order."""
    s = t("benchmark").select("item_id", text_functions.sentences(F.col("text")).alias("now"))
    after = s.select((F.col("item_id") - 1).alias("item_id"), F.col("now").alias("next"))
    met = s.join(after, "item_id", "left").withColumn("only", F.array_except("now", F.coalesce("next", F.array().cast("array<string>"))))
    return met.select("item_id", F.posexplode("only").alias("ordinal", "sentence")).withColumn("ordinal", F.col("ordinal") + 1)


_DAYS = "SELECT event_type, CAST(ts AS DATE) AS d, round(avg(value), 6) AS v FROM [events] GROUP BY event_type, CAST(ts AS DATE)"

both("r01_model_comparison", f"SELECT c.event_type, printf('%.3f +- %.3f', c.m, c.s) AS folds, printf('%.3f', x.m) AS outside FROM (SELECT event_type, round(avg(v), 6) AS m, round(stddev_samp(v), 6) AS s FROM ({_DAYS}) a GROUP BY event_type) c JOIN (SELECT event_type, round(avg(value), 6) AS m FROM [events] WHERE value > 50 GROUP BY event_type) x ON c.event_type = x.event_type", "events")
both("r03_display_columns", "SELECT s.l_returnflag AS flag, printf('%.3f', s.m) AS mean_text, printf('%+.4f', s.m - o.m) AS difference_text, printf('%.1f%%', 100 * s.share) AS share_text FROM (SELECT l_returnflag, round(avg(l_discount), 7) AS m, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM [lineitem]), 7) AS share FROM [lineitem] GROUP BY l_returnflag) s CROSS JOIN (SELECT round(avg(l_discount), 7) AS m FROM [lineitem]) o", "lineitem")
both("r05_inventory", "SELECT source, lang, count(*) AS records, count(DISTINCT md5(text)) AS texts, count(*) - count(DISTINCT md5(text)) AS copies FROM [documents] GROUP BY source, lang", "documents")
both("r07_selection_audit", f"SELECT w.event_type AS by_mean, f.event_type AS by_wins, w.event_type = f.event_type AS agree FROM (SELECT event_type, row_number() OVER (ORDER BY round(avg(v), 6) DESC, event_type) AS rn FROM ({_DAYS}) a GROUP BY event_type) w JOIN (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS rn FROM (SELECT event_type, row_number() OVER (PARTITION BY d ORDER BY v DESC, event_type) AS r FROM ({_DAYS}) b) c WHERE r = 1 GROUP BY event_type) f ON w.rn = 1 AND f.rn = 1", "events")
both("r08_diagnostics", "SELECT concat('labels: ', CAST(count(*) AS VARCHAR(20)), '; good: ', CAST(sum(quality) AS VARCHAR(20)), '; toxic: ', CAST(sum(toxic) AS VARCHAR(20))) AS summary FROM [labels]", "labels")
both("r10_split_condition", "SELECT split_part(p_type, ' ', 1) AS first, split_part(p_type, ' ', 2) AS second, CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 0 WHEN 'ECONOMY' THEN 1 ELSE 2 END AS place, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM [part] GROUP BY p_type", "part")
both("r11_balancing", "SELECT b.quality, b.n, m.least AS down_sampled, m.greatest - b.n AS top_up, round(CAST(m.total AS DOUBLE) / (m.classes * b.n), 9) AS weight FROM (SELECT quality, count(*) AS n FROM [labels] GROUP BY quality) b CROSS JOIN (SELECT min(n) AS least, max(n) AS greatest, sum(n) AS total, count(*) AS classes FROM (SELECT quality, count(*) AS n FROM [labels] GROUP BY quality) c) m", "labels")
both("r14_facts", "SELECT (SELECT count(*) FROM [documents]) AS documents, (SELECT count(DISTINCT md5(text)) FROM [documents]) AS texts, (SELECT count(*) FROM (SELECT md5(text) AS h FROM [documents] GROUP BY md5(text) HAVING count(*) > 1) g) AS groups_of_copies, (SELECT max(n_chars) FROM [documents]) AS longest", "documents")
both("r20_training_composition", "SELECT l.quality, d.lang, count(*) AS instances FROM [labels] l JOIN [documents] d ON d.doc_id = l.doc_id WHERE d.doc_id % 5 <> 0 GROUP BY l.quality, d.lang", "labels documents")
both("r21_sentence", "SELECT printf('%d of %d orders (%.1f%%) are finished.', count(CASE WHEN o_orderstatus = 'F' THEN 1 END), count(*), round(CAST(100 AS DOUBLE) * count(CASE WHEN o_orderstatus = 'F' THEN 1 END) / count(*), 5)) AS sentence FROM [orders]", "orders")
both("r22_population", "SELECT doc_id, source, 'development' AS part FROM [documents] WHERE source <> 'src1' UNION ALL SELECT doc_id, source, 'external' FROM [documents] WHERE source = 'src1'", "documents")
both("a07_arm_summary", f"SELECT event_type, count(*) AS folds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, max(v) AS greatest FROM ({_DAYS}) a GROUP BY event_type", "events")
both("j07_lookup", "SELECT s.s_suppkey, n.n_name, r.r_name FROM [supplier] s LEFT JOIN [nation] n ON s.s_nationkey = n.n_nationkey LEFT JOIN [region] r ON n.n_regionkey = r.r_regionkey", "supplier nation region")
both("j20_default_decision", "SELECT s.s_suppkey, CASE WHEN s.decision = 'confirmed_near_duplicate' THEN 'exclude' WHEN s.decision IS NOT NULL THEN 'retain_both' ELSE 'pending_visual_review' END AS action FROM (SELECT a.s_suppkey, d.decision FROM [supplier] a LEFT JOIN (SELECT 1 AS k, 'confirmed_near_duplicate' AS decision UNION ALL SELECT 2, 'distinct') d ON a.s_suppkey = d.k) s", "supplier")
both("w12_average_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_custkey, o_orderpriority) - 1) / CAST(2 AS DOUBLE) AS average_rank FROM [orders]", "orders")
both("w10_last_name_wins", f"SELECT d, max(event_type) AS event_type FROM (SELECT d, event_type, rank() OVER (PARTITION BY d ORDER BY v DESC) AS r FROM ({_DAYS}) a) b WHERE r = 1 GROUP BY d", "events")
both("p19_stratum", "SELECT p_partkey, concat_ws('|', p_brand, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' ELSE 'large' END, CASE WHEN p_retailprice <= 1000 THEN 'low' WHEN p_retailprice <= 1500 THEN 'middle' ELSE 'high' END) AS stratum FROM [part]", "part")
both("p29_renumbered", "SELECT p.p_partkey, m.number FROM [part] p JOIN (SELECT p_brand, row_number() OVER (ORDER BY first) AS number FROM (SELECT p_brand, min(p_partkey) AS first FROM [part] GROUP BY p_brand) f) m ON p.p_brand = m.p_brand", "part")


@query("""WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality), r AS (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256('42:' || doc_id), doc_id) - 1 AS i FROM labels),
s AS (SELECT quality, n, unnest(range(0, 6000 - n)) AS slot FROM n), d AS (SELECT CASE WHEN s.slot < 4000 - s.n THEN 'final' ELSE 'pool' END AS part, s.quality, r.doc_id, s.slot, (s.slot % 9)::INTEGER AS transform FROM s JOIN r ON r.quality = s.quality AND r.i = s.slot % s.n)
SELECT part, quality, count(*) AS n, count(DISTINCT doc_id) AS sources, count(transform) AS derivatives, coalesce(max(slot), -1) AS last FROM (SELECT * FROM d UNION ALL SELECT 'final', quality, doc_id, NULL, NULL FROM labels) GROUP BY part, quality""")
def m06_partitions(t):
    made = sampling.partitions(t("labels").select("quality", "doc_id"), "quality", "doc_id", 4000, 2000, 42, strict=False)
    return made.groupBy("part", "quality").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("sources"), F.count("transform").alias("derivatives"), F.coalesce(F.max("slot"), F.lit(-1)).alias("last"))


@query(f"""WITH {TWO}, d(left_id, right_id, decision) AS (SELECT left_id, right_id, CASE WHEN left_id % 2 = 0 THEN 'confirmed_near_duplicate' ELSE 'distinct' END FROM p2 WHERE median_bits <= {MOST} AND left_id % 3 = 0 AND left_id < 300)
SELECT p.left_id, p.right_id, d.decision, CASE WHEN d.decision = 'confirmed_near_duplicate' THEN 'exclude' WHEN d.decision IS NOT NULL THEN 'retain_both' ELSE 'pending_visual_review' END AS action FROM p2 p LEFT JOIN d ON d.left_id = p.left_id AND d.right_id = p.right_id WHERE p.median_bits <= {MOST} OR p.difference_bits <= {MOST}""")
def j20_composite_decision(t):
    """Candidate pairs with a decision table that lists some of them by both members."""
    pairs = candidate_pairs(t)
    listed = pairs.where(f"median_bits <= {MOST} AND left_id % 3 = 0 AND left_id < 300").select("left_id", "right_id", F.when(F.col("left_id") % 2 == 0, dedupe.CONFIRMED).otherwise("distinct").alias("decision"))
    return dedupe.decided(pairs.select("left_id", "right_id"), listed, ["left_id", "right_id"])


@query(f"""WITH {CELLS}, lg AS ({LONG}), i AS (SELECT model, metric, quantile_cont(v, 0.025) AS low, quantile_cont(v, 0.975) AS high FROM lg WHERE metric = 'f1_macro' GROUP BY model, metric),
o AS (SELECT 'a' AS model, label, predicted AS g FROM p UNION ALL SELECT 'b', label, predicted_b FROM p), k AS (SELECT model, count(*) FILTER (WHERE label = 1 AND g = 1) AS tp, count(*) FILTER (WHERE label = 1 AND g = 0) AS fn, count(*) FILTER (WHERE label = 0 AND g = 0) AS tn, count(*) FILTER (WHERE label = 0 AND g = 1) AS fp FROM o GROUP BY model)
SELECT k.model, printf('%.3f', round({F1}, 9)) AS f1_text, printf('[%.3f, %.3f]', round(i.low, 9), round(i.high, 9)) AS interval_text FROM k JOIN i ON i.model = k.model""")
def r03_audited_table(t):
    """Macro-F1 of both predictors with its bootstrap interval, as shown."""
    p = predictions(t)
    long = p.select("label", F.inline(F.array(F.struct(F.lit("a").alias("model"), F.col("predicted").alias("predicted")), F.struct(F.lit("b").alias("model"), F.col("predicted_b").alias("predicted")))))
    made = metrics.with_metrics(long.groupBy("model").agg(*metrics.counts()), 9).select("model", F.format_string("%.3f", "f1_macro").alias("f1_text"))
    at = lambda q: F.round(F.percentile("f1_macro", q), 9)
    spans = replicates(t).groupBy("model").agg(F.format_string("[%.3f, %.3f]", at(0.025), at(0.975)).alias("interval_text"))
    return joins.left_one_to_one(made, spans, ["model"])


@query(f"WITH {PRED}, a AS (SELECT lang, count(*) FILTER (WHERE label = predicted) / count(*)::DOUBLE AS v FROM p WHERE lang IS NOT NULL GROUP BY lang) SELECT 'accuracy' AS value, count(*) AS compared, 0::BIGINT AS unmatched, 0.0::DOUBLE AS largest, true AS within FROM a")
def m24_reproduction(t):
    """Accuracies by language from confusion counts against means over rows: the same to 1e-9."""
    p = predictions(t).where("lang IS NOT NULL")
    again = p.groupBy("lang").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("accuracy"))
    return joins.reconciled(metrics.evaluate(p, ["lang"]).select("lang", "accuracy"), again, ["lang"], ["accuracy"], 1e-9).withColumn("largest", F.round("largest", 9))


@query("""WITH c AS (SELECT role, conv_id, count(*) AS n FROM conversations GROUP BY ALL), h AS (SELECT role, n, count(*) AS k FROM c GROUP BY ALL)
SELECT role, '{' || string_agg('"' || n || '":' || k, ',' ORDER BY n) || '}' AS cell, sum(k)::BIGINT AS values_sum, sum(n * k)::BIGINT AS weighted_sum, sum(n * k) = (SELECT count(*) FROM conversations x WHERE x.role = h.role) AS agrees FROM h GROUP BY role""")
def p34_map_cell(t):
    """Histograms of turns a conversation as JSON maps, written in order of their keys, read back and held against the counts."""
    rows = t("conversations")
    hist = rows.groupBy("role", "conv_id").agg(F.count("*").alias("n")).groupBy("role", "n").agg(F.count("*").alias("k"))
    cells = hist.groupBy("role").agg(text_functions.map_cell(F.collect_list(F.struct("n", "k")), "n", "k").alias("cell"))  # a pair for each distinct count
    whole, weighted = text_functions.map_sums(F.col("cell"))
    counts = rows.groupBy("role").agg(F.count("*").alias("_rows"))
    return cells.select("role", "cell", whole.alias("values_sum"), weighted.alias("weighted_sum")).join(counts, "role").select("role", "cell", "values_sum", "weighted_sum", (F.col("weighted_sum") == F.col("_rows")).alias("agrees"))


@query()
def k13_diagnostics(t):
    made = images.diagnostics(_pictures(t), "vec_id")
    return made.select("vec_id", "level", F.round("light_share", 9).alias("light_share"), "shapes", F.sha2("spectrum.data", 256).alias("spectrum"))


@query()
def k25_resized(t):
    made = images.resized(_pictures(t), "vec_id", side=4)
    return made.select("vec_id", F.hex("image.data").alias("pixels"))


@query()
def s15_encoded(t):
    return images.encoded(_pictures(t), "vec_id", side=64).select("vec_id", F.length("payload").alias("bytes"), "sha256")
