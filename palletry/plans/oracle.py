"""DuckDB SQL for the registered queries, over views of the same tables."""

from __future__ import annotations

from palletry.plans import base
from palletry.functions import text
from palletry.plans.queries import CODE_SHAPES, SHAPES

ITEMS = """items AS (SELECT l_orderkey AS dispatch_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 100 + l_quantity::BIGINT AS seq,
  p_size AS length, l_quantity::INT AS width, l_linenumber + 4 AS height FROM lineitem JOIN part ON l_partkey = p_partkey),
boxes AS (SELECT dispatch_id, seq, LEAST(length, width, height) AS a, length + width + height - LEAST(length, width, height) - GREATEST(length, width, height) AS b,
  GREATEST(length, width, height) AS c, length::DOUBLE * width * height AS v FROM items),
loaded AS (SELECT o_orderkey AS dispatch_id, (o_orderstatus = 'F')::INT AS if_loaded FROM orders)"""

ORDERS = """feat AS (SELECT l_orderkey AS row_id, COUNT(*) AS sku_counts, SUM(l_quantity) AS total_quantity, MIN(l_quantity) AS min_quantity, MAX(l_quantity) AS max_quantity,
  MAX(l_discount) AS max_discount, SUM(l_quantity * l_quantity * (l_linenumber + 4)) AS total_volume FROM lineitem GROUP BY 1),
ord AS (SELECT feat.*, o_orderpriority, (o_orderstatus = 'F')::INT AS gt FROM feat JOIN orders ON row_id = o_orderkey)"""

_DECISION = " ".join([f"{base.MODEL.intercept}::DOUBLE", *[f"+ ({w})::DOUBLE * (({f}::DOUBLE - {lo}::DOUBLE) / {hi - lo}::DOUBLE)" for f, lo, hi, w in base.MODEL.features]])
SCORED = f"""{ORDERS},
dec AS (SELECT *, {_DECISION} AS decision FROM ord),
pro AS (SELECT *, ROUND(1 / (1 + EXP(-GREATEST(LEAST(decision, 500), -500))), 6) AS prob FROM dec),
scored AS (SELECT *, (prob >= 0.5)::INT AS pred FROM pro),
cases AS (SELECT *, CASE WHEN gt = 1 AND pred = 0 THEN 'FN' WHEN gt = 0 AND pred = 1 THEN 'FP' WHEN gt = 0 THEN 'TN' ELSE 'TP' END AS error_type FROM scored)"""

_COUNTS = "COUNT(*) FILTER (gt = 0 AND {p} = 0) AS tn, COUNT(*) FILTER (gt = 0 AND {p} = 1) AS fp, COUNT(*) FILTER (gt = 1 AND {p} = 0) AS fn, COUNT(*) FILTER (gt = 1 AND {p} = 1) AS tp"
_RATES = """(tp + tn) / NULLIF(tp + tn + fp + fn, 0)::DOUBLE AS accuracy, COALESCE(tp / NULLIF(tp + fp, 0)::DOUBLE, 0) AS precision,
  COALESCE(tp / NULLIF(tp + fn, 0)::DOUBLE, 0) AS recall, COALESCE(fp / NULLIF(fp + tn, 0)::DOUBLE, 0) AS fpr, COALESCE(fn / NULLIF(fn + tp, 0)::DOUBLE, 0) AS fnr"""
_RATES_9 = "ROUND(accuracy, 9) AS accuracy, ROUND(precision, 9) AS precision, ROUND(recall, 9) AS recall, ROUND(fpr, 9) AS fpr, ROUND(fnr, 9) AS fnr"


def counts(pred: str = "pred") -> str:
    return _COUNTS.format(p=pred)


_SIGMOID = "1 / (1 + EXP(-GREATEST(LEAST(decision, 500), -500)))"
EXACT = SCORED.replace(f"ROUND({_SIGMOID}, 6)", _SIGMOID)
ROC = f"""{EXACT},
g AS (SELECT prob AS threshold, SUM(gt) AS pos, SUM(1 - gt) AS neg FROM scored GROUP BY 1),
cum AS (SELECT threshold, SUM(neg) OVER w AS fp, SUM(pos) OVER w AS tp FROM g WINDOW w AS (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bent AS (SELECT *, LAG(fp) OVER o + LEAD(fp) OVER o - 2 * fp AS b1, LAG(tp) OVER o + LEAD(tp) OVER o - 2 * tp AS b2 FROM cum WINDOW o AS (ORDER BY threshold DESC)),
kept AS (SELECT threshold, fp::BIGINT AS fp, tp::BIGINT AS tp FROM bent WHERE b1 IS NULL OR b1 <> 0 OR b2 <> 0 UNION ALL SELECT 'infinity'::DOUBLE, 0, 0),
roc AS (SELECT ROW_NUMBER() OVER (ORDER BY threshold DESC)::INT AS place, threshold, fp, tp, fp / (MAX(fp) OVER ())::DOUBLE AS fpr, tp / (MAX(tp) OVER ())::DOUBLE AS tpr FROM kept)"""

_LONG = " UNION ALL ".join(f"SELECT row_id, error_type, {i} AS nth, '{f}' AS feature, {f}::DOUBLE AS value FROM cases" for i, f in enumerate(base.FEATURES))
_LONG_ORD = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS value FROM ord" for f in base.FEATURES)


def q(p: float) -> str:
    return f"ROUND(QUANTILE_CONT(value, {p}), 6)"


_QUANT = f"feature, COUNT(*) AS n, ROUND(MIN(value), 6) AS min, {q(0.25)} AS p25, {q(0.5)} AS median, {q(0.75)} AS p75, ROUND(MAX(value), 6) AS max"

RULED = f"""{SCORED},
ruled AS (SELECT *, CASE WHEN sku_counts > 5 AND prob < 0.5 THEN 1 ELSE -1 END AS many_items, CASE WHEN total_quantity < 60 AND prob >= 0.5 THEN 0 ELSE -1 END AS light_order,
  CASE WHEN sku_counts > 6 THEN 0 ELSE -1 END AS default_fill, -1 AS undefined, -1 AS broken FROM cases),
hyb AS (SELECT *, COALESCE(NULLIF(many_items, -1), NULLIF(light_order, -1), NULLIF(default_fill, -1), pred) AS hybrid FROM ruled)"""
_RULE_NAMES = [*base.RULES]


def fitness_cte(names: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{r}' AS rule, {i} AS nth, COUNT(*) FILTER (error_type = 'FN' AND {r} = 1) AS fn_corr, COUNT(*) FILTER (error_type = 'FN' AND {r} <> 1) AS fn_miss,
  COUNT(*) FILTER (error_type = 'FP' AND {r} = 0) AS fp_corr, COUNT(*) FILTER (error_type = 'FP' AND {r} <> 0) AS fp_over,
  COUNT(*) FILTER (error_type IN ('TN', 'TP') AND {r} <> -1) AS easy_overrides, COUNT(*) FILTER (error_type IN ('TN', 'TP')) AS easy FROM ruled"""
        for i, r in enumerate(names)
    )
    return f"""{RULED}, fit AS ({parts}), par AS (SELECT *, fn_corr / (fn_corr + fn_miss + 0.000001::DOUBLE) AS p1, fp_corr / (fp_corr + fp_over + 0.000001::DOUBLE) AS p2 FROM fit),
sc AS (SELECT *, (2 * p1 * p1 / (p1 + p1 + 0.000001::DOUBLE) + 2 * p2 * p2 / (p2 + p2 + 0.000001::DOUBLE)) / 2 AS raw_score, GREATEST(1 - 0.1::DOUBLE * easy_overrides / GREATEST(easy, 1), 0) AS penalty FROM par)"""


JUDGED = f"""{ITEMS},
run AS (SELECT *, SUM(v) OVER (PARTITION BY dispatch_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM boxes),
ofe AS (SELECT dispatch_id, COUNT(*) AS item_count, COUNT(DISTINCT (a, b, c)) AS distinct_types, SUM(v) AS total_vol, SUM(v) / 45000::DOUBLE AS fill_ratio, SUM(a)::DOUBLE AS a_sum, STDDEV_POP(a) AS a_std,
  MIN(a)::DOUBLE AS a_min, MAX(a)::DOUBLE AS a_max, MIN(b)::DOUBLE AS b_min, MAX(b)::DOUBLE AS b_max, MIN(c)::DOUBLE AS c_min, MAX(c)::DOUBLE AS c_max,
  MAX(c / NULLIF(a, 0)::DOUBLE) AS asr_max, AVG(c / NULLIF(a, 0)::DOUBLE) AS asr_avg,
  MIN(seq) FILTER (c > 60 OR b > 30 OR a > 25) AS first_big, MIN(seq) FILTER (upto > 45000) AS first_over FROM run GROUP BY 1),
rea AS (SELECT *, CASE WHEN first_big IS NOT NULL AND (first_over IS NULL OR first_big <= first_over) THEN 'single_item_dimension_exceed'
  WHEN first_over IS NOT NULL THEN 'volume_overflow_early' WHEN total_vol > 45000 * 0.98::DOUBLE THEN 'volume_overflow_98pct'
  WHEN a_sum > 2.8::DOUBLE * 60 * (1 - 0.15::DOUBLE * fill_ratio) + 0.3::DOUBLE * a_std THEN 'variance_compensated_fragmentation'
  WHEN fill_ratio > 0.95 AND c_max / 60 > 0.95 THEN 'high_fill_max_dim_block'
  WHEN fill_ratio > 0.95 AND 25 * SQRT(GREATEST(1 - fill_ratio, 0)) < a_min * 1.2::DOUBLE THEN 'high_fill_connectivity_block'
  WHEN b_max / 30 > 0.85 AND fill_ratio > 0.85 AND a_min / 25 < 0.15 AND item_count > 10 THEN 'extreme_dimension_distribution' ELSE 'pass' END AS reason FROM ofe),
judged AS (SELECT rea.*, reason = 'pass' AS feasible, if_loaded AS gt FROM rea JOIN loaded USING (dispatch_id))"""

PEOPLE = "people AS (SELECT p_partkey, p_name, p_size AS size, ROUND(p_retailprice / 1000, 3) AS score FROM part)"
ISLANDS = f"{PEOPLE}, isl AS (SELECT *, ((ROW_NUMBER() OVER (ORDER BY p_partkey) - 1) % 4)::INT AS island FROM people)"
NODES = "nodes AS (SELECT FLOOR(vec_id / 50)::BIGINT AS instance, vec_id AS node, ROUND(embedding[1]::DOUBLE, 6) AS x, ROUND(embedding[2]::DOUBLE, 6) AS y FROM embeddings)"
ARRIVALS = "arr AS (SELECT user_id AS instance, event_id AS seq, FLOOR(ABS(value) * 100)::BIGINT % 100 + 1 AS item FROM events WHERE value IS NOT NULL)"
PACKED = f"{ARRIVALS}, packed AS (SELECT *, FLOOR((SUM(item) OVER (PARTITION BY instance ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) / 150)::BIGINT AS bin FROM arr)"
DEPOT = """stops AS (SELECT l_orderkey AS instance, l_partkey + 1 AS node, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem),
tour AS (SELECT instance, nth * 2 AS pos, node FROM stops UNION ALL SELECT instance, nth * 2 - 1, 0 FROM stops WHERE nth % 4 = 1),
fl AS (SELECT instance, pos, node, (LAG(node) OVER (PARTITION BY instance ORDER BY pos) = 0)::INT AS from_depot FROM tour),
flags AS (SELECT instance, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY pos)::INT AS pos, node, COALESCE(from_depot, 1) AS from_depot FROM fl WHERE node <> 0)"""


def uniform(key: str, seed: int = 42) -> str:
    return f"(('0x' || SUBSTR(MD5('{seed}:' || {key}::VARCHAR), 1, 12))::BIGINT / 281474976710656::DOUBLE)"


REBUILT = """rul AS (SELECT p_partkey AS rule, ROUND(p_retailprice, 0) AS score, p_partkey % 7 + p_partkey % 5 AS corrected, p_partkey % 3 AS easy_overrides,
  (CASE WHEN p_size % 6 - 1 BETWEEN 0 AND 3 THEN p_size % 6 - 1 ELSE 0 END)::INT AS island_id FROM part),
placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY island_id ORDER BY score DESC, corrected DESC, easy_overrides, rule) AS place FROM rul), kept AS (SELECT * FROM placed WHERE place <= 50)"""


_U = uniform("row_id")
_D = "SQRT((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"

def _online(start: str, place: str) -> str:
    """Bins used by each instance, an item a step: `start` makes the rooms, `place` takes an item to one of them."""
    return f"""WITH RECURSIVE {ARRIVALS}, nth AS (SELECT instance, item::DOUBLE AS item, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY seq) AS n FROM arr),
step AS (SELECT instance, 0::BIGINT AS n, {start} AS rooms FROM nth GROUP BY instance UNION ALL
  SELECT instance, n, LIST_CONCAT(LIST_CONCAT(rooms[1:b - 1], [rooms[b] - item]), rooms[b + 1:]) FROM ({place})),
done AS (SELECT instance, LEN(LIST_FILTER(ARG_MAX(rooms, n), LAMBDA r: r < 100)) AS bins FROM step GROUP BY instance)
SELECT instance, bins, COUNT(*) AS n_items, SUM(item)::BIGINT AS total, CEIL(SUM(item) / 100)::BIGINT AS bound FROM arr JOIN done USING (instance) GROUP BY instance, bins"""


_NEXT = "SELECT s.instance, s.n + 1 AS n, i.item, s.rooms FROM step s JOIN nth i ON i.instance = s.instance AND i.n = s.n + 1"
_ROOMS = "LIST_TRANSFORM(RANGE(COUNT(*)), LAMBDA i: 100::DOUBLE)"
BEST_FIT = _online(_ROOMS, f"SELECT *, LIST_POSITION(rooms, LIST_MIN(LIST_FILTER(rooms, LAMBDA r: r >= item))) AS b FROM ({_NEXT})")
SCORE_STEP = _online(
    _ROOMS,
    f"""SELECT *, fits[LIST_POSITION(steps, LIST_MAX(steps))] AS b FROM (
    SELECT *, LIST_TRANSFORM(RANGE(1, LEN(score) + 1), LAMBDA i: score[i] - CASE WHEN i = 1 THEN 0 ELSE score[i - 1] END) AS steps FROM (
    SELECT *, LIST_TRANSFORM(fits, LAMBDA i: CASE WHEN rooms[i] > item THEN -1 ELSE 1 END
      * ((rooms[i] - top) * (rooms[i] - top) / item + rooms[i] * rooms[i] / (item * item) + rooms[i] * rooms[i] / (item * item * item))) AS score FROM (
    SELECT *, LIST_FILTER(RANGE(1, LEN(rooms) + 1), LAMBDA i: rooms[i] >= item) AS fits, LIST_MAX(rooms) AS top FROM ({_NEXT}))))""",
)

_TAG = "(?i:(?:python3?|py))\\\\b".replace("\\\\\\\\", "\\\\")
_quoted = lambda t: "'" + t.replace("'", "''") + "'"
_WRAP = " ".join(f"WHEN {i} THEN {_quoted(a)} || t || {_quoted(b)}" for i, (a, b) in enumerate(SHAPES))
_CODES = f"""r AS (SELECT conv_id, turn, COALESCE(text, '') AS t FROM conversations), w AS (SELECT conv_id, turn, CASE (conv_id + turn) % {len(SHAPES)} {_WRAP} END AS t FROM r),
f AS (SELECT *, LIST_TRANSFORM(REGEXP_EXTRACT_ALL(t, '{text.CLOSED_FENCE}', 1), lambda x: TRIM(x)) AS blocks, REGEXP_EXTRACT(t, '{text.OPEN_FENCE.replace(chr(92) + "z", "$")}', 1) AS opened,
  LIST_ZIP(REGEXP_EXTRACT_ALL(t, '{text.ANY_FENCE}', 1), REGEXP_EXTRACT_ALL(t, '{text.ANY_FENCE}', 2)) AS fences FROM w),
c AS (SELECT *, LIST_FILTER(blocks, lambda x: CONTAINS(x, 'apply_rule_patch')) AS closed,
  LIST_FILTER(fences, lambda z: NOT REGEXP_MATCHES(z[1], '{text.TAGGED_HEADER}') AND CONTAINS(z[2], 'apply_rule_patch')) AS untagged FROM f),
codes AS (SELECT conv_id, turn, t, blocks, CASE WHEN t = '' THEN [] WHEN LEN(closed) > 0 THEN closed WHEN CONTAINS(opened, 'apply_rule_patch') THEN [opened]
  WHEN LEN(untagged) > 0 THEN [REGEXP_REPLACE(untagged[1][2], '^\\s+|\\s+$', '', 'g')] ELSE [] END AS codes,
  CASE WHEN LEN(blocks) > 0 AND LEN(closed) = 0 THEN 'python_blocks_without_apply_rule_patch' WHEN LEN(blocks) > 0 THEN 'unknown'
    WHEN REGEXP_MATCHES(t, '```(?i:(?:python3?|py))\\b') THEN 'has_open_python_fence_no_close' ELSE 'no_python_fence' END AS detail FROM c)"""
_MESSAGES = " ".join(f"WHEN '{k}' THEN " + ("PRINTF(" + _quoted(m) + ", LEN(blocks))" if "%d" in m else _quoted(m)) for k, m in text.FAILURES.items())

ORACLE = {
    "hard_case_summary": f"""WITH {SCORED}, s AS (SELECT error_type, gt, COUNT(*) AS n, AVG(prob) AS m, STDDEV_POP(prob) AS sd FROM cases GROUP BY 1, 2)
SELECT error_type, gt, n, ROUND(m, 6) AS mean_prob, ROUND(sd, 6) AS std_prob, ROUND(n * 100.0::DOUBLE / SUM(n) OVER (PARTITION BY gt), 6) AS pct FROM s""",
    "item_type_counts": f"""WITH {ITEMS}, t AS (SELECT dispatch_id, a AS dim_s, b AS dim_m, c AS dim_l, COUNT(*) AS n_items FROM boxes GROUP BY ALL)
SELECT dispatch_id, if_loaded, COUNT(*) OVER (PARTITION BY dispatch_id) AS n_types, dim_s, dim_m, dim_l, n_items FROM t JOIN loaded USING (dispatch_id)""",
    "order_feature_table": f"WITH {ORDERS} SELECT * FROM ord",
    "dedup_keep_first": """SELECT l_suppkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_suppkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey) = 1""",
    "semi_filter_items": "SELECT l_suppkey, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "left_lookup_default": """WITH l AS (SELECT o_custkey, ARG_MAX(o_orderpriority, o_orderkey) AS p FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT c_custkey, c_mktsegment, COALESCE(p, 'none') AS o_orderpriority FROM customer LEFT JOIN l ON c_custkey = o_custkey""",
    "feature_quantiles": f"WITH {ORDERS}, l AS ({_LONG_ORD}) SELECT {_QUANT} FROM l WHERE value IS NOT NULL GROUP BY feature",
    "describe_numeric": f"WITH {ORDERS}, l AS ({_LONG_ORD}) SELECT {_QUANT}, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS std FROM l WHERE value IS NOT NULL GROUP BY feature",
    "equal_width_bins_label_mean": f"""WITH {ORDERS}, e AS (SELECT MIN(total_quantity) AS lo, (MAX(total_quantity) - MIN(total_quantity)) / 10 AS w FROM ord)
SELECT GREATEST(LEAST(CEIL(ROUND((total_quantity - lo) / CASE WHEN w = 0 THEN 1 ELSE w END, 9)), 10), 1)::INT AS bin, COUNT(*) AS n, ROUND(AVG(gt), 6) AS mean_label FROM ord, e GROUP BY 1""",
    "minmax_scaled": f"""WITH {ORDERS}, e AS (SELECT MIN(sku_counts) AS a0, MAX(sku_counts) AS a1, MIN(total_quantity) AS b0, MAX(total_quantity) AS b1, MIN(max_discount) AS c0, MAX(max_discount) AS c1 FROM ord)
SELECT row_id, ROUND((sku_counts - a0) / (a1 - a0)::DOUBLE, 9) AS sku_counts, ROUND((total_quantity - b0) / (b1 - b0), 9) AS total_quantity, ROUND((max_discount - c0) / (c1 - c0), 9) AS max_discount, 0.0::DOUBLE AS vehicle_length FROM ord, e""",
    "volume_ratio": f"WITH {ORDERS} SELECT row_id, ROUND(total_volume / 45000, 9) AS volume_ratio, sku_counts = 1 AS undefined FROM ord",
    "linear_score_sigmoid": f"WITH {SCORED} SELECT row_id, ROUND(decision, 9) AS decision, prob, pred FROM scored",
    "confusion_by_segment": f"WITH {SCORED} SELECT o_orderpriority, {counts()} FROM scored GROUP BY 1",
    "classification_metrics": f"WITH {SCORED}, c AS (SELECT {counts()} FROM scored), r AS (SELECT *, {_RATES} FROM c) SELECT tn, fp, fn, tp, {_RATES_9} FROM r",
    "roc_curve_points": f"WITH {ROC} SELECT place, ROUND(threshold, 9) AS threshold, fp, tp, ROUND(fpr, 9) AS fpr, ROUND(tpr, 9) AS tpr FROM roc WHERE place > 1",
    "roc_auc": f"WITH {EXACT}, r AS (SELECT gt, RANK() OVER (ORDER BY prob) + (COUNT(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS r FROM scored) SELECT ROUND((SUM(r) FILTER (gt = 1) - SUM(gt)::DOUBLE * (SUM(gt) + 1) / 2) / (SUM(gt)::DOUBLE * SUM(1 - gt)), 9) AS auc FROM r",
    "tpr_at_fpr_nearest": f"WITH {ROC} SELECT ROUND(threshold, 9) AS threshold, ROUND(fpr, 9) AS fpr, ROUND(tpr, 9) AS tpr FROM roc ORDER BY ABS(fpr - 0.01::DOUBLE), place LIMIT 1",
    "tpr_at_fpr_interp": f"""WITH {ROC}, p AS (SELECT *, LEAD(fpr) OVER (ORDER BY place) AS f2, LEAD(tpr) OVER (ORDER BY place) AS t2 FROM roc)
SELECT 0.01::DOUBLE AS fpr, ROUND(CASE WHEN f2 > fpr THEN tpr + (t2 - tpr) * (0.01::DOUBLE - fpr) / (f2 - fpr) ELSE tpr END, 9) AS tpr FROM p WHERE fpr <= 0.01::DOUBLE ORDER BY place DESC LIMIT 1""",
    "top_variance_features": f"""WITH {SCORED}, l AS ({_LONG}), v AS (SELECT error_type, feature, nth, AVG(value) AS m, VAR_POP(value) AS v FROM l GROUP BY 1, 2, 3),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY ROUND(v, 6) DESC, nth)::INT AS rank FROM v) SELECT error_type, rank, feature, ROUND(m, 4) AS mean, ROUND(v, 4) AS var FROM r WHERE rank <= 3""",
    "typical_hard_cases": f"""WITH {SCORED} SELECT error_type, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY ROUND(ABS(prob - 0.5::DOUBLE), 6) DESC, row_id)::INT AS rank, row_id, gt, prob FROM cases WHERE error_type IN ('FN', 'FP') QUALIFY rank <= 5""",
    "typical_easy_cases": f"""WITH {SCORED} SELECT error_type, ROW_NUMBER() OVER (PARTITION BY error_type ORDER BY ROUND(ABS(prob - 0.5::DOUBLE), 6), row_id)::INT AS rank, row_id, gt, prob FROM cases WHERE error_type IN ('TN', 'TP') QUALIFY rank <= 5""",
    "near_confusable_cases": f"""WITH {SCORED}, c AS (SELECT AVG(sku_counts) AS a, AVG(total_quantity) AS b, AVG(max_quantity) AS d FROM cases WHERE error_type = 'FN')
SELECT row_id, error_type, ROUND(SQRT((sku_counts - a) * (sku_counts - a) + (total_quantity - b) * (total_quantity - b) + (max_quantity - d) * (max_quantity - d)), 6) AS distance FROM cases, c WHERE error_type = 'TP' ORDER BY distance, row_id LIMIT 10""",
    "rule_fitness": f"WITH {fitness_cte([*_RULE_NAMES, 'broken'])} SELECT rule, fn_corr, fn_miss, fp_corr, fp_over, easy_overrides, ROUND(raw_score, 9) AS raw_score, ROUND(raw_score * penalty, 9) AS score FROM sc",
    "rule_ranking": f"WITH {fitness_cte(_RULE_NAMES)} SELECT rule, ROW_NUMBER() OVER (ORDER BY ROUND(raw_score * penalty, 9) DESC, fn_corr + fp_corr DESC, easy_overrides, nth)::INT AS rank FROM sc",
    "hybrid_predictions": f"WITH {RULED} SELECT row_id, pred, hybrid, CASE WHEN hybrid = pred THEN prob WHEN hybrid = 1 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE END AS prob FROM hyb",
    "hybrid_vs_baseline": f"""WITH {RULED}, a AS (SELECT {counts()} FROM hyb), b AS (SELECT {counts("hybrid")} FROM hyb), a2 AS (SELECT *, {_RATES} FROM a), b2 AS (SELECT *, {_RATES} FROM b),
l AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, a2.{m}::DOUBLE AS before, b2.{m}::DOUBLE AS after FROM a2, b2" for m in ("tn", "fp", "fn", "tp", "accuracy", "precision", "recall"))})
SELECT metric, ROUND(before, 9) AS before, ROUND(after, 9) AS after, ROUND(after - before, 9) AS delta, CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS direction FROM l""",
    "hard_subset_accuracy": f"WITH {RULED} SELECT COUNT(*) AS n, ROUND(AVG((hybrid = gt)::INT), 9) AS accuracy FROM hyb WHERE error_type IN ('FN', 'FP')",
    "first_row_mask": """WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth, MAX((l_quantity > 45)::INT) OVER (PARTITION BY l_orderkey) AS big FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey FROM r WHERE nth = 1 AND big = 1""",
    "order_item_features": f"""WITH {JUDGED} SELECT dispatch_id, item_count, distinct_types, total_vol, ROUND(fill_ratio, 6) AS fill_ratio, a_sum, ROUND(a_std, 6) AS a_std, a_min, a_max, b_min, b_max, c_min, c_max, ROUND(asr_max, 6) AS asr_max, ROUND(asr_avg, 6) AS asr_avg FROM ofe""",
    "feasibility_reason": f"WITH {JUDGED} SELECT dispatch_id, reason, feasible FROM judged",
    "feasibility_reason_counts": f"WITH {JUDGED} SELECT reason, gt, COUNT(*) AS n FROM judged GROUP BY 1, 2",
    "feasibility_error_report": f"""WITH {JUDGED}, r AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (gt = 1) AS n_positive, COUNT(*) FILTER (gt <> 1) AS n_negative, COUNT(*) FILTER (gt = 1 AND NOT feasible) AS fn, COUNT(*) FILTER (gt <> 1 AND feasible) AS fp FROM judged)
SELECT *, ROUND(100 * fn / NULLIF(n_positive, 0)::DOUBLE, 6) AS fn_pct, ROUND(100 * fp / NULLIF(n_negative, 0)::DOUBLE, 6) AS fp_pct FROM r""",
    "typical_feasibility_errors": f"""WITH {JUDGED}, e AS (SELECT *, CASE WHEN gt = 1 THEN 'FN' ELSE 'FP' END AS kind FROM judged WHERE (gt = 1) <> feasible),
c AS (SELECT *, COUNT(*) OVER (PARTITION BY kind, reason) AS reason_n FROM e)
SELECT kind, ROW_NUMBER() OVER (PARTITION BY kind ORDER BY reason_n DESC, ROUND(fill_ratio, 9) DESC, item_count DESC, distinct_types DESC, dispatch_id)::INT AS rank, dispatch_id, reason, reason_n, ROUND(fill_ratio, 6) AS fill_ratio, item_count, distinct_types FROM c QUALIFY rank <= 2""",
    "top_item_types": f"""WITH {ITEMS}, t AS (SELECT dispatch_id, a, b, c, COUNT(*) AS n, MIN(seq) AS s FROM boxes GROUP BY 1, 2, 3, 4)
SELECT dispatch_id, a, b, c, n, ROW_NUMBER() OVER (PARTITION BY dispatch_id ORDER BY n DESC, s)::INT AS rank FROM t QUALIFY rank <= 3""",
    "coef_ranking": """WITH m AS (SELECT p_partkey AS nth, p_name AS feature, ROUND((p_retailprice - 1400) / 1000, 3) AS weight FROM part)
SELECT ROW_NUMBER() OVER (ORDER BY ABS(weight) DESC, nth)::INT AS rank, feature, weight FROM m QUALIFY rank <= 30""",
    "checkpoint_diff": """WITH c AS (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, COUNT(*) AS n FROM supplier GROUP BY 1),
o AS (SELECT * FROM c WHERE k % 2 = 0 UNION ALL SELECT * FROM s WHERE k % 2 = 1)
SELECT n_name AS key, c.n || '.0' AS before, o.n::VARCHAR AS now FROM nation LEFT JOIN c ON c.k = n_nationkey LEFT JOIN o ON o.k = n_nationkey WHERE c.n IS DISTINCT FROM o.n""",
    "run_comparison": f"""WITH {SCORED}, c AS (SELECT o_orderpriority, {counts()} FROM scored GROUP BY 1), r AS (SELECT *, {_RATES} FROM c), m AS (SELECT o_orderpriority AS run, {_RATES_9} FROM r)
SELECT run, accuracy, recall, RANK() OVER (ORDER BY accuracy DESC, run)::INT AS place FROM m""",
    "hash_split_counts": f"WITH {ORDERS} SELECT {_U} < 0.25 AS is_test, gt, COUNT(*) AS n FROM ord GROUP BY 1, 2",
    "kfold_assignment": f"WITH {ORDERS} SELECT row_id, gt, ((ROW_NUMBER() OVER (PARTITION BY gt ORDER BY {_U}, row_id) - 1) % 5)::INT AS fold FROM ord",
    "stratified_split": f"WITH {ORDERS} SELECT row_id, gt, ROW_NUMBER() OVER (PARTITION BY gt ORDER BY {_U}, row_id) <= ROUND(COUNT(*) OVER (PARTITION BY gt) * 0.15::DOUBLE) AS is_test FROM ord",
    "population_islands_topk": f"WITH {ISLANDS} SELECT p_partkey, island, ROW_NUMBER() OVER (PARTITION BY island ORDER BY score DESC, p_partkey)::INT AS rank FROM isl QUALIFY rank <= 50",
    "rank_selection_probs": f"""WITH {PEOPLE}, t AS (SELECT FLOOR(p_partkey / 40)::BIGINT AS population, p_partkey, ROW_NUMBER() OVER (PARTITION BY FLOOR(p_partkey / 40) ORDER BY score, p_partkey)::INT - 1 AS rank, COUNT(*) OVER (PARTITION BY FLOOR(p_partkey / 40)) AS n FROM people)
SELECT population, p_partkey, rank, ROUND(1::DOUBLE / (rank + 1 + n) / SUM(1::DOUBLE / (rank + 1 + n)) OVER (PARTITION BY population), 9) AS probability FROM t""",
    "boltzmann_probs": f"WITH {ISLANDS} SELECT p_partkey, island, ROUND(EXP(score / 0.5) / SUM(EXP(score / 0.5)) OVER (PARTITION BY island), 9) AS probability FROM isl",
    "rule_pair_diversity": f"""WITH {PEOPLE}, s AS (SELECT p_partkey, LIST_DISTINCT(STRING_SPLIT(p_name, '')) AS s FROM people)
SELECT a.p_partkey AS a, b.p_partkey AS b, ROUND(1 - LEN(LIST_INTERSECT(a.s, b.s)) / LEN(LIST_DISTINCT(LIST_CONCAT(a.s, b.s)))::DOUBLE, 9) AS distance FROM s a JOIN s b ON FLOOR(a.p_partkey / 40) = FLOOR(b.p_partkey / 40) AND a.p_partkey < b.p_partkey""",
    "unique_nsmallest": f"WITH {PEOPLE}, f AS (SELECT p_partkey, size FROM people QUALIFY ROW_NUMBER() OVER (PARTITION BY size ORDER BY p_partkey) = 1) SELECT * FROM f ORDER BY size, p_partkey LIMIT 20",
    "weighted_sample": f"WITH {PEOPLE} SELECT p_partkey, score FROM people WHERE score > 0 ORDER BY ROUND(-LN(GREATEST({uniform('p_partkey')}, 0.000000000001::DOUBLE)) / score, 9), p_partkey LIMIT 25",
    "running_best": "SELECT event_id, event_type, ROUND(value, 4) AS score, MAX(ROUND(value, 4)) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events WHERE value IS NOT NULL",
    "island_extremes": f"WITH {ISLANDS}, t AS (SELECT island, MAX(score) AS top FROM isl GROUP BY 1) SELECT (SELECT island FROM t ORDER BY top DESC, island LIMIT 1) AS best, (SELECT island FROM t ORDER BY top, island LIMIT 1) AS worst",
    "repeated_genes": """WITH g AS (SELECT DISTINCT l_orderkey, l_suppkey AS gene, l_linenumber::BIGINT * 1000000 + l_partkey AS pos FROM lineitem), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, gene ORDER BY pos) > 1 AS rep FROM g)
SELECT l_orderkey, SUM(rep::INT)::BIGINT AS n_repeated, COUNT(*) AS n FROM r GROUP BY 1""",
    "pairwise_distance": f"WITH {NODES} SELECT a.instance, a.node AS u, b.node AS v, CASE WHEN a.node = b.node THEN 1.0::DOUBLE ELSE ROUND({_D}, 6) END AS d FROM nodes a JOIN nodes b USING (instance)",
    "knn_per_node": f"""WITH {NODES}, d AS (SELECT a.instance, a.node AS u, b.node AS v, ROUND({_D}, 9) AS d FROM nodes a JOIN nodes b USING (instance) WHERE a.node <> b.node)
SELECT instance, u, v, ROUND(d, 6) AS d, ROW_NUMBER() OVER (PARTITION BY instance, u ORDER BY d, v)::INT AS rank FROM d QUALIFY rank <= 5""",
    "tour_length": f"""WITH {NODES}, b AS (SELECT instance, x, y, COALESCE(LEAD(x) OVER o, FIRST_VALUE(x) OVER o) AS x2, COALESCE(LEAD(y) OVER o, FIRST_VALUE(y) OVER o) AS y2 FROM nodes WINDOW o AS (PARTITION BY instance ORDER BY node))
SELECT instance, ROUND(SUM(SQRT((x - x2) * (x - x2) + (y - y2) * (y - y2))), 6) AS length FROM b GROUP BY 1""",
    "augment_8fold": f"""WITH {NODES}, a AS ({" UNION ALL ".join(f"SELECT instance, node, {i} AS turn, {p} AS x, {r} AS y FROM nodes" for i, (p, r) in enumerate([("x", "y"), ("1 - x", "y"), ("x", "1 - y"), ("1 - x", "1 - y"), ("y", "x"), ("1 - y", "x"), ("y", "1 - x"), ("1 - y", "1 - x")]))})
SELECT instance, node, turn, ROUND(x, 6) AS x, ROUND(y, 6) AS y FROM a""",
    "op_prizes": f"""WITH {NODES}, d AS (SELECT *, SQRT((x - FIRST_VALUE(x) OVER o) * (x - FIRST_VALUE(x) OVER o) + (y - FIRST_VALUE(y) OVER o) * (y - FIRST_VALUE(y) OVER o)) AS d, COUNT(*) OVER (PARTITION BY instance) AS n FROM nodes WINDOW o AS (PARTITION BY instance ORDER BY node)),
r AS (SELECT *, 1 + FLOOR(ROUND(99 * d / MAX(d) OVER (PARTITION BY instance), 9)) AS raw FROM d)
SELECT instance, node, ROUND(raw / MAX(raw) OVER (PARTITION BY instance), 6) AS prize, CASE WHEN n <= 50 THEN 3.0::DOUBLE WHEN n <= 100 THEN 4.0::DOUBLE WHEN n <= 200 THEN 5.0::DOUBLE WHEN n <= 300 THEN 6.0::DOUBLE ELSE 7.0::DOUBLE END AS max_length FROM r""",
    "multi_start_best": "WITH b AS (SELECT user_id, MAX(ROUND(value, 4)) AS best FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT ROUND(AVG(best), 4) AS mean_best, COUNT(*) AS n FROM b",
    "gap_to_optimum": """WITH m AS (SELECT l_suppkey AS instance, AVG(l_quantity) AS mean, STDDEV_POP(l_quantity) AS std FROM lineitem GROUP BY 1)
SELECT instance, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std, ROUND(100 * (mean / (s_nationkey + 10) - 1), 6) AS gap_pct FROM m JOIN supplier ON instance = s_suppkey""",
    "weighted_averages": "SELECT l_returnflag, ROUND(SUM(l_discount * l_quantity) / SUM(l_quantity), 9) AS average FROM lineitem GROUP BY 1",
    "online_binpack_best_fit": BEST_FIT,
    "online_binpack_score_step": SCORE_STEP,
    "bin_lower_bound": f"WITH {ARRIVALS} SELECT instance, COUNT(*) AS n_items, SUM(item)::BIGINT AS total, CEIL(SUM(item) / 150)::BIGINT AS bound FROM arr GROUP BY 1",
    "packing_validity": f"""WITH {PACKED}, l AS (SELECT instance, bin, SUM(item) AS load FROM packed GROUP BY 1, 2), f AS (SELECT instance, MAX(load) <= 150 AS fits FROM l GROUP BY 1)
SELECT instance, TRUE AS same_items, fits, fits AS valid FROM f""",
    "bin_fill_fitness": f"WITH {PACKED}, l AS (SELECT instance, bin, SUM(item) AS load FROM packed GROUP BY 1, 2) SELECT instance, COUNT(*) AS bins, ROUND(AVG(POWER(load / 150::DOUBLE, 2)), 9) AS fitness FROM l GROUP BY 1",
    "depot_flags": f"WITH {DEPOT} SELECT * FROM flags",
    "route_segmentation": f"""WITH {DEPOT}, r AS (SELECT *, SUM(from_depot) OVER (PARTITION BY instance ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS route FROM flags)
SELECT instance, route, COUNT(*) AS n_nodes, SUM(p_size)::BIGINT AS load, SUM(p_size) <= 100 AS legal FROM r JOIN part ON node = p_partkey + 1 GROUP BY 1, 2""",
    "label_counts": "SELECT quality, toxic, COUNT(*) AS n FROM labels GROUP BY 1, 2",
    "code_fence_extract": f"WITH {_CODES} SELECT conv_id, turn, LEN(codes)::INT AS n, COALESCE(codes[1], '') AS code, detail FROM codes",
    "response_failures": f"""WITH {_CODES} SELECT conv_id, turn, 'no_extractable_code' AS failure_kind, CASE detail {_MESSAGES} END AS failure_message, detail AS failure_detail,
  CASE WHEN LENGTH(s) <= 200 THEN s ELSE SUBSTR(s, 1, 200) || '{text.TRUNCATED}' END AS response_preview FROM (SELECT *, REGEXP_REPLACE(t, '^\\s+|\\s+$', '', 'g') AS s FROM codes) WHERE LEN(codes) = 0""",
    "traceback_filter": r"""WITH r AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), l AS (SELECT doc_id, CASE doc_id % 4
  WHEN 0 THEN t || chr(10) || 'Traceback (most recent call last):' || chr(10) || t || chr(10) || 'ValueError: x' || chr(10) || 'Set the environment variable HYDRA_FULL_ERROR=1' || chr(10) || 'end'
  WHEN 1 THEN 'Traceback' || chr(10) || t WHEN 2 THEN t ELSE t || chr(10) || 'Traceback at last' END AS t FROM r)
SELECT doc_id, REGEXP_REPLACE(REGEXP_EXTRACT(t, '(?s)(?:^|\n)(Traceback.*)$', 1), '(?s)\n[^\n]*Set the environment variable HYDRA_FULL_ERROR=1.*$', '') AS traceback FROM l""",
    "objective_parse": """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (doc_id || '.25')::DOUBLE END AS o FROM documents) SELECT doc_id, o AS objective, o IS NOT NULL AS ok FROM o""",
    "document_slugs": "SELECT p_partkey, COALESCE(NULLIF(REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(p_name, '^\\s+|\\s+$', '', 'g'), '[\\\\/:]', '_', 'g'), '\\s+', '_', 'g'), ''), 'unknown_model') AS slug, SUBSTR(MD5(p_name), 1, 6) AS short_id FROM part",
    "order_count_check": "SELECT COUNT(DISTINCT l_orderkey) AS n, COUNT(DISTINCT l_orderkey) AS expected FROM lineitem",
    "vehicle_ratio_summary": f"""WITH {ORDERS}, c AS (SELECT *, 45000 - o_orderpriority[1]::INT * 1000 AS capacity FROM ord)
SELECT ROUND(AVG(gt), 9) AS mean_label, ROUND(AVG(total_volume) / AVG(capacity), 9) AS mean_ratio, ROUND(MAX(total_volume) / AVG(capacity), 9) AS max_ratio, ROUND(MIN(total_volume) / AVG(capacity), 9) AS min_ratio FROM c""",
    "run_overview": f"""WITH {RULED}, m AS (SELECT o_orderpriority, o_orderpriority[1]::INT AS nth, AVG((pred = gt)::INT) AS a, AVG((hybrid = gt)::INT) AS b,
  COUNT(*) FILTER (hybrid = 1 AND gt = 1) / (COUNT(*) FILTER (hybrid = 0 AND gt = 0) + 1)::DOUBLE AS s FROM hyb GROUP BY 1)
SELECT CASE WHEN nth > 3 THEN o_orderpriority WHEN nth > 1 THEN 'm' || nth ELSE '\u2014' END AS model, 'exp_' || nth AS run, CASE WHEN nth = 2 THEN '\u2014' ELSE '20240101' END AS timestamp,
  CASE WHEN nth % 2 = 1 THEN 'no' WHEN nth < 4 THEN 'yes (from ' || nth || ')' ELSE 'yes (from ?)' END AS resumed,
  PRINTF('%.4f', a) AS svm_accuracy, PRINTF('%.4f', b) AS hybrid_accuracy, PRINTF('%+.4f', b - a) AS delta, PRINTF('%.6f', s) AS best_rule_score FROM m""",
    "setting_severity": """WITH b AS (SELECT c_nationkey AS k, COUNT(*)::VARCHAR AS before FROM customer GROUP BY 1), n AS (SELECT s_nationkey AS k, COUNT(*)::VARCHAR AS now FROM supplier GROUP BY 1)
SELECT n_name AS key, before, now, CASE WHEN n_regionkey = 0 THEN 'error' ELSE 'warning' END AS severity FROM b JOIN nation ON k = n_nationkey LEFT JOIN n USING (k)
WHERE before IS DISTINCT FROM now AND (n_regionkey <> 0 OR now IS NOT NULL)""",
    "rebuilt_islands": f"WITH {REBUILT} SELECT rule, island_id FROM kept",
    "island_reset": f"""WITH {REBUILT}, t AS (SELECT i.k AS island_id, GREATEST(COALESCE(MAX(score), 0), 0) AS top FROM (SELECT UNNEST([0, 1, 2, 3]) AS k) i LEFT JOIN kept ON island_id = i.k GROUP BY 1),
e AS (SELECT (SELECT island_id FROM t ORDER BY top DESC, island_id LIMIT 1) AS best, (SELECT island_id FROM t ORDER BY top, island_id LIMIT 1) AS worst)
SELECT rule::VARCHAR AS rule, island_id, score FROM kept, e WHERE island_id <> worst OR place <= 3
UNION ALL SELECT rule || '_reset_' || FLOOR({uniform("rule")} * 9000 + 1000)::INT, worst, score FROM kept, e WHERE island_id = best AND place = 1""",
    "population_step": f"""WITH {PEOPLE}, old AS (SELECT * FROM people WHERE p_partkey % 4 = 0),
new AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ROUND(score, 5) ORDER BY p_partkey) AS place FROM people WHERE p_partkey % 4 <> 0 AND size > 3 AND score < 1.5
  AND p_name NOT IN (SELECT p_name FROM old) AND ROUND(score, 5) NOT IN (SELECT ROUND(score, 5) FROM old))
SELECT p_partkey, ROUND(score, 5) AS score FROM old UNION ALL SELECT p_partkey, ROUND(score, 5) FROM new WHERE place = 1""",
    "distinct_names": """WITH l AS (SELECT p_partkey, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(REPLACE(p_name || ' ' || p_type, ' ', ','), ','), lambda x: LOWER(TRIM(x))), lambda x: x <> '') AS l FROM part)
SELECT p_partkey, ARRAY_TO_STRING(LIST_FILTER(l, lambda x, i: LIST_POSITION(l, x) = i), '|') AS names FROM l""",
    "run_labels": """SELECT event_id, 'exp_' || STRFTIME(ts, '%Y%m%d_%H%M%S') AS run, 'models/linear_svm_' || STRFTIME(ts, '%Y%m%d_%H%M%S') || '.json' AS model_file,
  PRINTF('%.2f', value) AS fixed, PRINTF('%.6g', FLOOR(value)) AS general FROM events""",
    "route_files": """WITH i AS (SELECT l_orderkey AS instance, l_quantity::INT AS demand, COUNT(*) OVER (PARTITION BY l_orderkey)::INT AS n_customers,
  ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount, l_tax, l_quantity) AS nth FROM lineitem)
SELECT instance, CEIL(nth / 2)::BIGINT AS route, n_customers, SUM(demand)::BIGINT AS load, SUM(demand) <= 60 AS legal FROM i GROUP BY 1, 2, 3""",
    "tsplib_gaps": f"""WITH {NODES}, s AS (SELECT instance, MIN(x) AS x0, MIN(y) AS y0, GREATEST(MAX(x) - MIN(x), MAX(y) - MIN(y)) AS size FROM nodes GROUP BY 1),
p AS (SELECT instance, node, (x - x0) / size AS x, (y - y0) / size AS y FROM nodes JOIN s USING (instance)),
nx AS (SELECT *, COALESCE(LEAD(x) OVER w, FIRST(x) OVER w) AS x2, COALESCE(LEAD(y) OVER w, FIRST(y) OVER w) AS y2 FROM p WINDOW w AS (PARTITION BY instance ORDER BY node)),
l AS (SELECT instance, SUM(SQRT((x - x2) * (x - x2) + (y - y2) * (y - y2))) AS length FROM nx GROUP BY 1),
n1 AS (SELECT a.instance, a.node, MIN({_D}) AS d FROM p a JOIN p b ON a.instance = b.instance AND a.node <> b.node GROUP BY 1, 2), o AS (SELECT instance, SUM(d) AS optimum FROM n1 GROUP BY 1)
SELECT instance, ROUND(length, 4) AS mean, 0.0::DOUBLE AS std, ROUND(optimum, 4) AS optimum, ROUND(100 * (length / optimum - 1), 4) AS gap_pct FROM l JOIN o USING (instance)""",
}


def _newton(rounds: int = 12) -> str:
    """Newton steps for a slope and an intercept, one after another; a sum of products each."""
    out = [
        f"WITH {SCORED}",
        "n AS (SELECT SUM(gt)::DOUBLE AS n1, SUM(1 - gt)::DOUBLE AS n0 FROM scored)",
        "z AS MATERIALIZED (SELECT decision AS d, CASE gt WHEN 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM scored, n)",
        "s0 AS (SELECT 0::DOUBLE AS a, LN((n1 + 1) / (n0 + 1)) AS b FROM n)",
    ]
    for i in range(rounds):
        out.append(f"g{i} AS MATERIALIZED (SELECT a, b, SUM((p - t) * d) AS ga, SUM(p - t) AS gb, SUM(p * (1 - p) * d * d) AS aa, SUM(p * (1 - p) * d) AS ab, SUM(p * (1 - p)) AS bb FROM (SELECT s{i}.a, s{i}.b, d, t, 1 / (1 + EXP(-(s{i}.a * d + s{i}.b))) AS p FROM z, s{i}) GROUP BY a, b)")
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT a - (bb * ga - ab * gb) / (aa * bb - ab * ab) AS a, b - (aa * gb - ab * ga) / (aa * bb - ab * ab) AS b FROM g{i})")
    return ", ".join(out) + f" SELECT ROUND(a, 6) AS slope, ROUND(b, 6) AS intercept FROM s{rounds}"


ORACLE |= {
    "calibration": _newton(),
    "trial_metrics": f"""WITH {EXACT},
t AS (SELECT trial, gt, ROUND(1 / (1 + EXP(-GREATEST(LEAST(decision * (trial / 4.0::DOUBLE) + SIN(total_quantity::DOUBLE * trial) * (trial % 3), 500), -500))), 3) AS s FROM scored, (SELECT UNNEST(RANGE(1, 13))::INT AS trial)),
g AS (SELECT trial, s, SUM(gt) AS pos, SUM(1 - gt) AS neg FROM t GROUP BY ALL),
cum AS (SELECT *, SUM(neg) OVER w AS fp, SUM(pos) OVER w AS tp, SUM(neg) OVER (PARTITION BY trial) AS n, SUM(pos) OVER (PARTITION BY trial) AS p FROM g WINDOW w AS (PARTITION BY trial ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
bent AS (SELECT *, LEAD(pos) OVER w AS np, LEAD(neg) OVER w AS nn, ROW_NUMBER() OVER w AS k FROM cum WINDOW w AS (PARTITION BY trial ORDER BY s DESC)),
pts AS (SELECT trial, fp::DOUBLE / n AS fpr, tp::DOUBLE / p AS tpr, k FROM bent WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg UNION ALL SELECT DISTINCT trial, 0::DOUBLE, 0::DOUBLE, 0 FROM g),
m AS (SELECT trial, SUM(neg * (tp - pos / 2.0::DOUBLE)) / (MAX(n)::DOUBLE * MAX(p)) AS auc, SUM(CASE WHEN s >= 0.5::DOUBLE THEN pos ELSE neg END)::DOUBLE / (MAX(n) + MAX(p)) AS accuracy FROM cum GROUP BY trial),
r AS (SELECT trial, auc, accuracy, (SELECT ARG_MIN(tpr, (ABS(fpr - 0.01::DOUBLE), k)) FROM pts WHERE pts.trial = m.trial) AS tpr1 FROM m)
SELECT trial, ROUND(auc, 9) AS auc, ROUND(tpr1, 9) AS tpr1, ROUND(accuracy, 9) AS accuracy, ROW_NUMBER() OVER (ORDER BY auc DESC, tpr1 DESC, accuracy DESC, trial) = 1 AS best FROM r""",
}

_X = ", ".join(f"({f}::DOUBLE - {lo}::DOUBLE) / {hi - lo}::DOUBLE" for f, lo, hi, _ in base.MODEL.features)
ORACLE["stored_leaf_stats"] = f"""WITH RECURSIVE {ORDERS},
x AS (SELECT row_id, gt, row_id % 4 = 0 AS new, [{_X}] AS x FROM ord),
n AS (SELECT tree, node, node < 15 AND node % 5 <> 4 AS inner_, (tree * 3 + node) % 6 AS f, ((node * 7 + tree * 5) % 11 + 1) / 13.0::DOUBLE AS th, FLOOR(LOG2(node + 1))::INT AS depth
  FROM (SELECT UNNEST(RANGE(8))::INT AS tree), (SELECT UNNEST(RANGE(31))::INT AS node) WHERE node NOT IN (9, 10, 19, 20, 21, 22)),
w AS (SELECT row_id, gt, new, x, tree, 0 AS node FROM x, (SELECT DISTINCT tree FROM n)
  UNION ALL SELECT row_id, gt, new, x, w.tree, CASE WHEN x[f + 1] <= th THEN 2 * w.node + 1 ELSE 2 * w.node + 2 END FROM w JOIN n ON n.tree = w.tree AND n.node = w.node AND inner_),
l AS (SELECT w.* EXCLUDE x FROM w JOIN n ON n.tree = w.tree AND n.node = w.node AND NOT inner_),
k AS (SELECT tree, node, AVG(gt) AS p, COUNT(*) AS c FROM l WHERE NOT new AND row_id % 7 <> 1 GROUP BY ALL),
v AS (SELECT tree, NULL::INT AS node, SUM(p * c) / SUM(c) AS p, 0 AS c FROM k GROUP BY tree UNION ALL SELECT * FROM k),
t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY tree, node NULLS FIRST) - 1 AS token FROM v)
SELECT row_id, l.tree, COALESCE(t.token, u.token) AS token, ROUND(GREATEST(LEAST(COALESCE(t.p, u.p), 0.9999), 0.0001), 6) AS pos_rate, ROUND(LN(1 + COALESCE(t.c, 0)), 6) AS log_count,
  ROUND(CASE WHEN t.node IS NULL THEN 0 ELSE n.depth / (SELECT MAX(depth) FROM n m WHERE m.tree = l.tree)::DOUBLE END, 6) AS depth_norm, ROUND(CASE WHEN t.node IS NULL THEN 0 ELSE 1 / (t.node + 1.0::DOUBLE) END, 6) AS impurity
FROM l JOIN n USING (tree, node) LEFT JOIN t ON t.tree = l.tree AND t.node = l.node JOIN t u ON u.tree = l.tree AND u.node IS NULL WHERE new"""

_RANKED = f"{PEOPLE}, pop AS (SELECT *, p_partkey // {base.MEMBERS} AS population FROM people)"
ORACLE |= {
    "parents_with_replacement": f"""WITH {_RANKED}, w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY population ORDER BY score, p_partkey) - 1 AS rank, COUNT(*) OVER (PARTITION BY population) AS n FROM pop),
c AS (SELECT *, 1 / (rank + 1 + n)::DOUBLE AS v FROM w), i AS (SELECT *, SUM(v) OVER (PARTITION BY population ORDER BY rank) / SUM(v) OVER (PARTITION BY population) AS high, v / SUM(v) OVER (PARTITION BY population) AS p FROM c),
u AS (SELECT population, k, ('0x' || SUBSTR(MD5('2024:' || population || ':' || k), 1, 12))::BIGINT / 281474976710656::DOUBLE AS u FROM (SELECT DISTINCT population FROM pop), (SELECT UNNEST(RANGE(6)) AS k))
SELECT population, k // 2 AS draw, (k % 2)::INT AS nth, p_partkey FROM i JOIN u USING (population) WHERE u >= high - p AND (u < high OR rank = n - 1)""",
    "better_half": f"""WITH {_RANKED}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY population ORDER BY score DESC, p_partkey) AS rank, COUNT(*) OVER (PARTITION BY population) AS n FROM pop)
SELECT population, p_partkey, rank, rank <= n // 5 AS elite FROM r WHERE rank <= n - n // 2""",
    "next_generation": f"""WITH {_RANKED}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY population ORDER BY score DESC, p_partkey) AS rank, COUNT(*) OVER (PARTITION BY population) AS n FROM pop),
e AS (SELECT population, p_partkey, score, 'elite' AS origin FROM r WHERE rank <= n // 5), k AS (SELECT population, COUNT(*) AS k FROM e GROUP BY 1),
c AS (SELECT population - 1 AS population, p_partkey, score, ROW_NUMBER() OVER (PARTITION BY population ORDER BY p_partkey) AS nth FROM pop WHERE population > 0)
SELECT * FROM e UNION ALL SELECT population, p_partkey, score, 'child' FROM c LEFT JOIN k USING (population) WHERE nth <= {base.MEMBERS} - COALESCE(k, 0)""",
    "population_appended": f"""WITH {PEOPLE}, s AS (SELECT p_partkey, ROUND(score, 5) AS score, p_partkey % 4 = 0 AS old FROM people WHERE p_partkey % 4 = 0 OR size > 3)
SELECT p_partkey, score, NOT old AND (score IN (SELECT score FROM s WHERE old) OR ROW_NUMBER() OVER (PARTITION BY old, score ORDER BY p_partkey) > 1) AS repeated FROM s""",
    "renumbered_bins": f"""WITH {ARRIVALS}, b AS (SELECT instance, seq, item % 17 AS bin FROM arr), f AS (SELECT instance, bin, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY s) - 1 AS number FROM (SELECT instance, bin, MIN(seq) AS s FROM b GROUP BY ALL))
SELECT instance, seq, number, n_labels FROM b JOIN f USING (instance, bin) JOIN (SELECT instance, COUNT(*) AS n_labels FROM f GROUP BY 1) USING (instance)""",
    "repaired_tours": f"""WITH {NODES}, t AS (SELECT instance, node AS pos, node FROM nodes),
s AS (SELECT instance, pos, node, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY {uniform("pos")}) - 1 AS pick, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY node) - 1 AS nth FROM t WHERE pos % 50 BETWEEN 10 AND 19),
n AS (SELECT a.instance, a.pos, b.node FROM s a JOIN s b ON a.instance = b.instance AND a.pick = b.nth),
v AS (SELECT 0 AS k, * FROM t UNION ALL SELECT 1, instance, pos, COALESCE(n.node, t.node) FROM t LEFT JOIN n USING (instance, pos)),
e AS (SELECT k, instance, pos, node, x, y, COALESCE(LEAD(x) OVER w, FIRST_VALUE(x) OVER w) AS x2, COALESCE(LEAD(y) OVER w, FIRST_VALUE(y) OVER w) AS y2 FROM v JOIN nodes USING (instance, node) WINDOW w AS (PARTITION BY k, instance ORDER BY pos)),
l AS (SELECT k, instance, SUM(SQRT((x - x2) * (x - x2) + (y - y2) * (y - y2))) AS length, SUM(pos * node)::BIGINT AS mark FROM e GROUP BY ALL)
SELECT a.instance, ROUND(a.length, 6) AS before, ROUND(b.length, 6) AS after, b.length < a.length AS taken, CASE WHEN b.length < a.length THEN b.mark ELSE a.mark END AS mark FROM l a JOIN l b ON a.instance = b.instance AND a.k = 0 AND b.k = 1""",
    "pheromone_step": f"""WITH {NODES}, t AS (SELECT instance, 0 AS tour, node AS pos, node, x, y FROM nodes UNION ALL SELECT instance, 1, ROW_NUMBER() OVER (PARTITION BY instance ORDER BY x, node), node, x, y FROM nodes),
e AS (SELECT instance, tour, node AS u, COALESCE(LEAD(node) OVER w, FIRST_VALUE(node) OVER w) AS v, x, y, COALESCE(LEAD(x) OVER w, FIRST_VALUE(x) OVER w) AS x2, COALESCE(LEAD(y) OVER w, FIRST_VALUE(y) OVER w) AS y2 FROM t WINDOW w AS (PARTITION BY instance, tour ORDER BY pos)),
c AS (SELECT instance, tour, ROUND(SUM(SQRT((x - x2) * (x - x2) + (y - y2) * (y - y2))), 6) AS cost FROM e GROUP BY ALL),
b AS (SELECT instance, tour, u, v FROM e UNION ALL SELECT instance, tour, v, u FROM e), a AS (SELECT instance, u, v, SUM(1 / cost) AS added FROM b JOIN c USING (instance, tour) GROUP BY ALL),
s AS (SELECT instance, node AS u, node + 1 AS v, 1 + (node % 3) / 4.0::DOUBLE AS value FROM nodes)
SELECT instance, u, v, ROUND(COALESCE(value, 1) * 0.9::DOUBLE + COALESCE(added, 0), 6) AS value FROM s FULL JOIN a USING (instance, u, v)""",
    "route_augmentations": f"""WITH {DEPOT}, r AS (SELECT *, SUM(from_depot) OVER (PARTITION BY instance ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS route FROM flags),
e AS (SELECT instance, route, MIN(pos) AS first, MAX(pos) AS last FROM r GROUP BY ALL), g AS (SELECT *, MAX(last) OVER (PARTITION BY instance) AS n, COUNT(*) OVER (PARTITION BY instance) AS routes FROM e),
s AS (SELECT * FROM r JOIN g USING (instance, route)),
i AS (SELECT instance, node, first, CASE WHEN {uniform("(instance || ':' || route)", 1)} <= 0.5 THEN first + last - pos ELSE pos END AS pos FROM s),
h AS (SELECT instance, node, n, CASE WHEN w THEN n + 1 - pos ELSE pos END AS pos, CASE WHEN w THEN n + 1 - last ELSE first END AS first, CASE WHEN w THEN routes + 1 - route ELSE route END AS route,
  FLOOR({uniform("instance", 2)} * routes) + 1 AS head FROM (SELECT *, {uniform("instance", 1)} >= 0.5 AS w FROM s)),
z AS (SELECT instance, MIN(first) AS start FROM h WHERE route = head GROUP BY 1)
SELECT 'inverted' AS form, instance, pos::BIGINT AS pos, node, (pos = first)::INT AS from_depot FROM i
UNION ALL SELECT 'shifted', instance, ((pos - start + n) % n + 1)::BIGINT, node, (pos = first)::INT FROM h JOIN z USING (instance)""",
}

_LINES = """li AS (SELECT l_orderkey AS instance, l_partkey + 1 AS node, l_linestatus, ROW_NUMBER() OVER (PARTITION BY l_orderkey{} ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem),
s AS (SELECT instance, node, p_size::BIGINT AS demand FROM (SELECT DISTINCT instance, node FROM li) JOIN part ON node = p_partkey + 1)"""
ORACLE |= {
    "rollout_replay": f"""WITH {_LINES.format("")}, n AS (SELECT instance, COUNT(*) AS n FROM s GROUP BY 1),
t AS (SELECT instance, nth * 2 AS pos, node FROM li UNION ALL SELECT instance, nth * 2 - 1, 0 FROM li WHERE nth % 4 = 1 UNION ALL SELECT instance, MAX(nth) * 2 + 1, 0 FROM li GROUP BY 1),
d AS (SELECT instance, pos, node, n, node = 0 AS home, demand IS NOT NULL AS known, COALESCE(demand, 0) AS need, ROW_NUMBER() OVER (PARTITION BY instance, node ORDER BY pos) = 1 AS fresh
  FROM t LEFT JOIN s USING (instance, node) JOIN n USING (instance)),
e AS (SELECT *, (SUM(need) OVER w)::BIGINT AS used, (SUM((known AND fresh)::INT) OVER w)::BIGINT AS seen FROM d WINDOW w AS (PARTITION BY instance ORDER BY pos)),
f AS (SELECT *, 100 - used + COALESCE(MAX(CASE WHEN home THEN used END) OVER w, 0) AS load, MAX((home AND seen = n)::INT) OVER w = 1 AS finished FROM e WINDOW w AS (PARTITION BY instance ORDER BY pos)),
g AS (SELECT *, LAG(pos) OVER w AS p, LAG(finished) OVER w AS done, LAG(load) OVER w AS rest, LAG(home) OVER w AS stood FROM f WINDOW w AS (PARTITION BY instance ORDER BY pos))
SELECT instance, pos, node, load, seen, finished, CASE WHEN p IS NULL THEN known OR home WHEN done THEN home WHEN rest + 1e-5 < need THEN FALSE WHEN home THEN NOT stood ELSE known AND fresh END AS allowed FROM g""",
    "rollout_choices": f"""WITH {_LINES.format(", l_linestatus")}, c AS (SELECT * FROM li WHERE l_linestatus = 'F'),
l AS (SELECT instance, 100 - SUM(COALESCE(demand, 0)) AS load FROM c LEFT JOIN s USING (instance, node) WHERE instance IN (SELECT instance FROM s) GROUP BY 1)
SELECT instance, node, load + 1e-5 >= demand AND NOT EXISTS (FROM c WHERE c.instance = s.instance AND c.node = s.node) AS allowed FROM s JOIN l USING (instance)
UNION ALL SELECT instance, 0, load + 1e-5 >= 0 FROM l""",
}

_BY_RANK = ", ".join(f"NULLIF(CASE r{i} {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {n}' for n in _RULE_NAMES)} END, -1)" for i in (1, 2, 3))
ORACLE |= {
    "best_rules_hybrid": f"""WITH {fitness_cte(_RULE_NAMES)}, k AS (SELECT rule, ROW_NUMBER() OVER (ORDER BY ROUND(raw_score * penalty, 9) DESC, fn_corr + fp_corr DESC, easy_overrides, nth) AS rank FROM sc),
t AS (SELECT MAX(rule) FILTER (rank = 1) AS r1, MAX(rule) FILTER (rank = 2) AS r2, MAX(rule) FILTER (rank = 3) AS r3 FROM k) SELECT row_id, pred, COALESCE({_BY_RANK}, pred) AS hybrid FROM ruled, t""",
    "false_alarm_accuracy": f"""WITH {RULED}, h AS (SELECT * FROM hyb WHERE error_type = 'FP'),
m AS (SELECT COUNT(*) FILTER (pred = 0)::DOUBLE AS t1, COUNT(*) FILTER (pred = 1)::DOUBLE AS f1, COUNT(*) FILTER (hybrid = 0)::DOUBLE AS t2, COUNT(*) FILTER (hybrid = 1)::DOUBLE AS f2 FROM h),
l AS (SELECT 'tn' AS metric, t1 AS before, t2 AS after FROM m UNION ALL SELECT 'fp', f1, f2 FROM m UNION ALL SELECT 'accuracy', COALESCE(t1 / NULLIF(t1 + f1, 0), 0), COALESCE(t2 / NULLIF(t1 + f1, 0), 0) FROM m)
SELECT metric, ROUND(before, 9) AS before, ROUND(after, 9) AS after, ROUND(after - before, 9) AS delta, CASE WHEN after > before THEN 'up' WHEN after < before THEN 'down' ELSE 'same' END AS direction FROM l""",
}

_CODE_WRAP = " ".join(f"WHEN {i} THEN {_quoted(a)} || t || {_quoted(b)}" for i, (a, b) in enumerate(CODE_SHAPES))
_STRIPPED = "REGEXP_REPLACE({}, '^\\s+|\\s+$', '', 'g')".format
ORACLE |= {
    "items_from_csv": f"WITH {ITEMS} SELECT dispatch_id, COUNT(*) AS n, SUM(v)::BIGINT AS volume FROM boxes GROUP BY 1",
    "rules_from_json": """SELECT p_partkey::VARCHAR AS id, p_name AS code, CASE WHEN p_partkey % 3 <> 0 THEN p_size ELSE 0 END::BIGINT AS fn_corr, 0::BIGINT AS fn_miss,
  CASE WHEN p_partkey % 5 <> 0 THEN ROUND(p_retailprice, 1) ELSE 0 END AS score, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 4 ELSE 0 END AS island_id FROM part""",
    "model_from_json": f"WITH {SCORED} SELECT row_id, prob, pred FROM scored",
    "runs_from_files": f"""WITH {SCORED}, m AS (SELECT o_orderpriority AS p, o_orderpriority[1]::INT AS nth, ROUND(AVG((pred = gt)::INT), 6) AS a FROM scored GROUP BY 1)
SELECT CASE WHEN nth = 3 THEN p ELSE 'm' || nth END AS model, 'exp_' || nth AS run, '\u2014' AS timestamp, CASE WHEN nth = 2 THEN 'yes (from ?)' ELSE 'no' END AS resumed, PRINTF('%.4f', a) AS svm_accuracy, '0.5000' AS hybrid_accuracy,
  PRINTF('%+.4f', 0.5 - a) AS delta, '0.250000' AS best_rule_score, CASE WHEN nth IN (2, 3) THEN nth END::BIGINT AS n_rules FROM m WHERE nth < 5""",
    "last_iteration": "SELECT MAX(n_nationkey)::INT AS iteration FROM nation",
    "selected_features": f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT {i} AS place, '{f}' AS feature, ROUND(SUM({f})::DOUBLE, 4) AS total FROM ord" for i, f in enumerate(("total_volume", "max_discount", "row_id", "sku_counts", "total_quantity"))),
    "given_label_cases": f"""WITH {SCORED}, p AS (SELECT gt, CASE WHEN row_id % 3 > 0 THEN row_id % 3 - 1 ELSE pred END::INT AS pred FROM scored)
SELECT CASE WHEN gt = 1 AND pred = 0 THEN 'FN' WHEN gt = 0 AND pred = 1 THEN 'FP' WHEN gt = 0 THEN 'TN' ELSE 'TP' END AS error_type, pred, COUNT(*) AS n FROM p GROUP BY ALL""",
    "parsed_numbers": """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size::DOUBLE WHEN 4 THEN p_retailprice END AS x FROM part), s AS (SELECT *, GREATEST(LEAST(x / 60, 0.95::DOUBLE), 0.05::DOUBLE) AS raw FROM t),
c AS (SELECT p_partkey, x, CASE WHEN x IS NOT NULL THEN raw END AS share FROM s) SELECT p_partkey, x, ROUND(share, 9) AS share, ROUND(LN(share / (1 - share)), 9) AS logit, ROUND(LN(1 + x), 9) AS log FROM c""",
    "generated_codes": f"""WITH r AS (SELECT conv_id, turn, COALESCE(text, '') AS t FROM conversations), w AS (SELECT conv_id, turn, CASE (conv_id + turn) % 4 {_CODE_WRAP} END AS t FROM r),
l AS (SELECT *, STRING_SPLIT(t, chr(10)) AS lines, REGEXP_MATCHES(t, '(?s)```python(.*?)```') AS fenced FROM w),
e AS (SELECT *, LIST_POSITION(LIST_TRANSFORM(lines, lambda x: CONTAINS(x, 'return')), true) AS stop FROM l),
s AS (SELECT *, LIST_MAX(LIST_FILTER(RANGE(1, stop + 1), lambda i: STARTS_WITH(lines[i], 'def'))) AS start FROM e),
c AS (SELECT *, CASE WHEN fenced THEN {_STRIPPED("REGEXP_EXTRACT(t, '(?s)```python(.*?)```', 1)")} WHEN stop > 0 AND start IS NOT NULL THEN ARRAY_TO_STRING(lines[start:stop], chr(10)) END AS c0 FROM s),
n AS (SELECT *, CASE WHEN CONTAINS(c0, 'np') THEN 'import numpy as np' || chr(10) || c0 ELSE c0 END AS c1 FROM c), k AS (SELECT *, CASE WHEN CONTAINS(c1, 'torch') THEN 'import torch' || chr(10) || c1 ELSE c1 END AS code FROM n),
b AS (SELECT *, STRING_SPLIT(code, chr(10)) AS cl FROM k), f AS (SELECT *, LIST_POSITION(LIST_TRANSFORM(cl, lambda x: STARTS_WITH(x, 'return')), true) AS cs, {_STRIPPED("t")} AS st FROM b)
SELECT conv_id, turn, code, ARRAY_TO_STRING(LIST_FILTER(CASE WHEN cs > 0 THEN cl[1:cs] ELSE cl END, lambda x: NOT REGEXP_MATCHES(x, '^(def|import|from)')), chr(10)) AS body,
  CASE WHEN REGEXP_MATCHES(t, '(?s)<start>(.*?)```python') THEN {_STRIPPED("REGEXP_EXTRACT(t, '(?s)<start>(.*?)```python', 1)")} WHEN REGEXP_MATCHES(t, '(?s)<start>(.*?)<end>') THEN {_STRIPPED("REGEXP_EXTRACT(t, '(?s)<start>(.*?)<end>', 1)")} END AS description,
  CASE WHEN LENGTH(st) <= 40 THEN st ELSE SUBSTR(st, 1, 40) || '{text.TRUNCATED}' END AS short FROM f""",
    "case_lines": f"""WITH {EXACT} SELECT row_id, 'dispatch=' || row_id || PRINTF(' prob=%.4f', prob) || ' gt=' || gt || ', items=' || CASE WHEN row_id % 4 > 0 THEN sku_counts::VARCHAR ELSE 'N/A' END || ', quantity=' || total_quantity::INT AS line FROM scored""",
    "elite_part": f"WITH {PEOPLE} SELECT p_partkey, size, score FROM people WHERE size > 1 ORDER BY size, p_partkey LIMIT 1",
    "best_trial": "SELECT trial, auc, tpr1, accuracy FROM (" + ORACLE["trial_metrics"] + ") WHERE best",
}
