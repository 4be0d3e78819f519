"""The same queries in SQL, written from the definitions: rows are joined to every prediction day they precede."""

from __future__ import annotations

from tidemark.config import Settings
from tidemark.operators.feature_tables import TABLES, any_null, out_of_range

S = Settings()
DAYS = ", ".join(f"(DATE '{d}')" for d in S.prediction_days)
LOOK = S.lookback_days

RAW = """raw AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(k // 5 AS VARCHAR) AS item_id, CAST(k // 25 AS VARCHAR) AS item_category,
         CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS behavior_type,
         date_trunc('hour', ts) AS time
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type <> 'error')"""
BASE = f"""{RAW}, days(d) AS (VALUES {DAYS}),
hist AS (SELECT raw.*, d, strftime(d, '%Y-%m-%d') AS cutoff_date, hour(time) AS hod FROM raw JOIN days ON time < d),
cand AS (SELECT DISTINCT user_id, item_id, cutoff_date FROM hist WHERE time >= d - INTERVAL {LOOK} DAY),
bought AS (SELECT DISTINCT user_id, item_id, strftime(d, '%Y-%m-%d') AS cutoff_date FROM raw JOIN days ON time >= d AND time < d + INTERVAL 1 DAY WHERE behavior_type = 4),
sample AS (SELECT c.*, CAST(CASE WHEN b.user_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS label FROM cand c LEFT JOIN bought b USING (user_id, item_id, cutoff_date))"""


def _n(code: int, name: str, more: str = "") -> str:
    return f"CAST(count(*) FILTER (WHERE behavior_type = {code}{more}) AS BIGINT) AS {name}"


def _peak(key: str, source: str, prefix: str) -> str:
    """One row per key and day with the three peak hours, by ranked histograms."""
    parts = []
    for name, cond in ((f"{prefix}_peak_hour", "TRUE"), (f"{prefix}_browse_peak_hour", "behavior_type = 1"), (f"{prefix}_buy_peak_hour", "behavior_type = 4")):
        parts.append((name, f"SELECT {key}, cutoff_date, hod AS {name} FROM (SELECT {key}, cutoff_date, hod, row_number() OVER (PARTITION BY {key}, cutoff_date ORDER BY count(*) DESC, hod) AS r FROM {source} WHERE {cond} GROUP BY 1, 2, 3) WHERE r = 1"))
    first, *rest = parts
    sql = f"SELECT k.{key}, k.cutoff_date, CAST({first[0]} AS BIGINT) AS {first[0]}, " + ", ".join(f"CAST(coalesce({n}, -1) AS BIGINT) AS {n}" for n, _ in rest)
    return f"{sql} FROM ({first[1]}) k " + " ".join(f"LEFT JOIN ({q}) {n} USING ({key}, cutoff_date)" for n, q in rest)


def _ratio(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN round(CAST({num} AS DOUBLE) / {den}, 9) ELSE 0.0 END"


W1, W7 = " AND time >= d - INTERVAL 1 DAY", " AND time >= d - INTERVAL 7 DAY"
HOURS = ", ".join(f"CAST(count(*) FILTER (WHERE hod = {h}) AS BIGINT) AS user_action_{h}" for h in range(24))
RECENCY = "CAST(round_even(date_diff('second', max(time), any_value(CAST(d AS TIMESTAMP))) / 3600.0, 0) AS BIGINT)"
ITEM_HIST = "ihist AS (SELECT * FROM hist WHERE (item_id, cutoff_date) IN (SELECT item_id, cutoff_date FROM cand))"
PAIR_HIST = "phist AS (SELECT * FROM hist WHERE (user_id, item_id, cutoff_date) IN (SELECT user_id, item_id, cutoff_date FROM cand))"

FEAT_USER = f"""fu0 AS (
  SELECT user_id, cutoff_date, {_n(1, 'user_browse_1d', W1)}, {_n(1, 'user_browse_7d', W7)}, {_n(1, 'user_browse_all')},
         {_n(2, 'user_favorite_all')}, {_n(3, 'user_cart_all')}, {_n(4, 'user_buy_all')}, {RECENCY} AS user_since_last_hour,
         round(count(*) FILTER (WHERE hod BETWEEN 6 AND 11) / CAST(count(*) AS DOUBLE), 9) AS user_morning_fraction,
         round(count(*) FILTER (WHERE hod BETWEEN 12 AND 17) / CAST(count(*) AS DOUBLE), 9) AS user_afternoon_fraction,
         round(count(*) FILTER (WHERE hod < 6 OR hod > 17) / CAST(count(*) AS DOUBLE), 9) AS user_night_fraction, {HOURS}
  FROM hist GROUP BY 1, 2),
fue AS (SELECT user_id, cutoff_date, round(abs(sum(p * log2(p))), 9) AS user_hour_entropy FROM (
  SELECT user_id, cutoff_date, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id, cutoff_date) AS DOUBLE) AS p FROM hist GROUP BY user_id, cutoff_date, hod) GROUP BY 1, 2),
fup AS ({_peak('user_id', 'hist', 'user')}),
feat_user AS (SELECT *, {_ratio('user_buy_all', 'user_browse_all')} AS user_conversion_browse_buy, {_ratio('user_buy_all', 'user_cart_all')} AS user_conversion_cart_buy
  FROM fu0 JOIN fue USING (user_id, cutoff_date) JOIN fup USING (user_id, cutoff_date))"""
FEAT_ITEM = f"""{ITEM_HIST},
fi0 AS (SELECT item_id, cutoff_date, min(item_category) AS item_category, {_n(1, 'item_browse_all')}, {_n(2, 'item_favorite_all')}, {_n(3, 'item_cart_all')}, {_n(4, 'item_buy_all')},
        CAST(count(DISTINCT user_id) AS BIGINT) AS item_distinct_user FROM ihist GROUP BY 1, 2),
fip AS ({_peak('item_id', 'ihist', 'item')}),
feat_item AS (SELECT *, {_ratio('item_buy_all', 'item_browse_all')} AS item_conversion_browse_buy, CAST(item_buy_all = 0 AS BIGINT) AS item_is_cold FROM fi0 JOIN fip USING (item_id, cutoff_date))"""
FEAT_CATEGORY = f"""fc0 AS (SELECT item_category, cutoff_date, {_n(1, 'category_browse_all')}, {_n(4, 'category_buy_all')}, CAST(count(DISTINCT item_id) AS BIGINT) AS category_distinct_item FROM hist GROUP BY 1, 2),
feat_category AS (SELECT *, {_ratio('category_buy_all', 'category_browse_all')} AS category_conversion_browse_buy FROM fc0)"""
FEAT_USER_CATEGORY = f"""feat_user_category AS (SELECT user_id, item_category, cutoff_date, {_n(1, 'user_category_browse_all')}, {_n(4, 'user_category_buy_all')} FROM hist
  WHERE (user_id, item_category, cutoff_date) IN (SELECT user_id, item_category, cutoff_date FROM hist WHERE time >= d - INTERVAL {LOOK} DAY) GROUP BY 1, 2, 3)"""
FEAT_USER_ITEM = f"""{PAIR_HIST},
fui0 AS (SELECT user_id, item_id, cutoff_date, {_n(1, 'user_item_browse_1d', W1)}, {_n(1, 'user_item_browse_7d', W7)}, {_n(1, 'user_item_browse_all')},
         CAST(count(DISTINCT CASE WHEN behavior_type = 1 THEN time END) AS BIGINT) AS user_item_browse_distinct_hour, {_n(3, 'user_item_cart_all')}, {_n(4, 'user_item_buy_all')},
         CAST(count(*) FILTER (WHERE behavior_type = 2) > 0 AS BIGINT) AS user_item_is_favorited, {RECENCY} AS user_item_since_last_hour FROM phist GROUP BY 1, 2, 3),
fuil AS (SELECT user_id, item_id, cutoff_date, CAST(behavior_type AS BIGINT) AS user_item_last_behavior FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id, cutoff_date ORDER BY time DESC, behavior_type DESC) AS r FROM phist) WHERE r = 1),
fuip AS (SELECT p.user_id, p.item_id, p.cutoff_date, CAST(max(CASE WHEN p.hod = u.user_peak_hour THEN 1 ELSE 0 END) AS BIGINT) AS user_item_is_user_peak_hour,
         CAST(max(CASE WHEN p.hod = i.item_peak_hour THEN 1 ELSE 0 END) AS BIGINT) AS user_item_is_item_peak_hour
  FROM phist p LEFT JOIN fup u ON p.user_id = u.user_id AND p.cutoff_date = u.cutoff_date LEFT JOIN fip i ON p.item_id = i.item_id AND p.cutoff_date = i.cutoff_date GROUP BY 1, 2, 3),
feat_user_item AS (SELECT *, CAST(user_item_cart_all > 0 AND user_item_buy_all = 0 AS BIGINT) AS user_item_cart_not_buy FROM fui0 JOIN fuil USING (user_id, item_id, cutoff_date) JOIN fuip USING (user_id, item_id, cutoff_date))"""
CONTEXT = f"""CAST(isodow(CAST(cutoff_date AS DATE)) >= 6 AS BIGINT) AS time_is_weekend, CAST(cutoff_date < '{S.sale_day}' AS BIGINT) AS time_is_before_sale_event,
  CAST(cutoff_date = '{S.sale_day}' AS BIGINT) AS time_is_on_sale_event, CAST(cutoff_date > '{S.sale_day}' AS BIGINT) AS time_is_after_sale_event"""
ALL_TABLES = ", ".join([BASE, FEAT_USER, FEAT_ITEM, FEAT_CATEGORY, FEAT_USER_CATEGORY, FEAT_USER_ITEM])
MATRIX = f"""{ALL_TABLES}, matrix AS (
  SELECT *, {CONTEXT} FROM sample LEFT JOIN feat_item USING (item_id, cutoff_date) LEFT JOIN feat_user USING (user_id, cutoff_date)
  LEFT JOIN feat_user_item USING (user_id, item_id, cutoff_date) LEFT JOIN feat_category USING (item_category, cutoff_date)
  LEFT JOIN feat_user_category USING (user_id, item_category, cutoff_date))"""

TRAINVAL = S.trainval_days
VALS = [d for i, d in enumerate(TRAINVAL) if i and d >= S.first_validation_day]
FOLDS = ", ".join(f"({i}, '{x}', '{role}')" for i, v in enumerate(VALS, 1) for role, xs in (("train", [d for d in TRAINVAL if d < v]), ("val", [v])) for x in xs)
DAY_TYPE = f"CASE WHEN %s < '{S.sale_day}' THEN 'before_sale' WHEN %s = '{S.sale_day}' THEN 'on_sale' ELSE 'after_sale' END"
FOLDED = f"folds(fold, cutoff_date, role) AS (VALUES {FOLDS}), folded AS (SELECT * FROM sample JOIN folds USING (cutoff_date))"
SCORED = f"""{MATRIX}, folds(fold, cutoff_date, role) AS (VALUES {FOLDS}),
v AS (SELECT * FROM matrix JOIN folds USING (cutoff_date) WHERE role = 'val'),
scored AS (
  SELECT fold, cutoff_date, user_id, item_id, label, 'rule_cart' AS model, CAST(user_item_cart_all AS DOUBLE) AS score FROM v
  UNION ALL SELECT fold, cutoff_date, user_id, item_id, label, 'rule_browse', user_item_browse_all FROM v
  UNION ALL SELECT fold, cutoff_date, user_id, item_id, label, 'rule_cart_not_buy', user_item_cart_not_buy FROM v
  UNION ALL SELECT fold, cutoff_date, user_id, item_id, label, 'rule_recency', -user_item_since_last_hour FROM v)"""
PR = """SELECT fold, model, round(sum(label * tp / n) / sum(label), 9) AS pr_auc FROM (
  SELECT fold, model, label, CAST(sum(label) OVER w AS DOUBLE) AS tp, count(*) OVER w AS n FROM scored
  WINDOW w AS (PARTITION BY fold, model ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) GROUP BY 1, 2"""
ROC = """SELECT fold, model, round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 9) AS roc_auc FROM (
  SELECT fold, model, label, rank() OVER (PARTITION BY fold, model ORDER BY score) + (count(*) OVER (PARTITION BY fold, model, score) - 1) / 2.0 AS r FROM scored) GROUP BY 1, 2"""
ALL_FEATS = {"feat_user": FEAT_USER, "feat_item": FEAT_ITEM, "feat_category": FEAT_CATEGORY, "feat_user_category": FEAT_USER_CATEGORY, "feat_user_item": f"{FEAT_USER}, {FEAT_ITEM}, {FEAT_USER_ITEM}"}


def _q(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def _some(table: str, *columns: str, tables: str | None = None) -> str:
    return _q(f"{BASE}, {tables or ALL_FEATS[table]}", f"SELECT {', '.join(columns)} FROM {table}")


def _structure(name: str, source: str) -> str:
    """Every count of the structural checks, from the rows of ``source``."""
    key, holds = ", ".join(TABLES[name]["key"]), TABLES[name]["holds"]
    count = lambda e, as_: f"CAST(count(*) FILTER (WHERE {e}) AS BIGINT) AS {as_}"
    counts = [count(any_null([*TABLES[name]["key"], *TABLES[name]["columns"]]), "null_rows"), count(out_of_range(name), "out_of_range_rows"), *[count(f"NOT ({e})", f"broken_{n}") for n, e in holds.items()]]
    return f"""SELECT '{name}' AS table_name, count(*) AS n_rows, {', '.join(counts)}, CAST({len(S.prediction_days)} - count(DISTINCT cutoff_date) AS BIGINT) AS absent_days,
      (SELECT count(*) FROM (SELECT {key} FROM {source} GROUP BY {key} HAVING count(*) > 1)) AS repeated_keys,
      CAST(0 AS BIGINT) AS missing_columns, CAST(0 AS BIGINT) AS unexpected_columns FROM {source}"""  # SQL names its columns, so none can be missing


#: The sample's violations, counted on ``bad``.
SAMPLE_CHECKS = """, per AS (SELECT user_id, item_id, cutoff_date, count(*) AS n, max(label) AS y, count(*) FILTER (WHERE user_id IS NULL OR item_id IS NULL OR cutoff_date IS NULL OR label IS NULL) AS nul, count(*) FILTER (WHERE label NOT IN (0, 1)) AS odd FROM bad GROUP BY 1, 2, 3),
f AS (SELECT cutoff_date, CAST(sum(nul) AS BIGINT) AS null_rows, CAST(sum(odd) AS BIGINT) AS bad_labels, count(*) FILTER (WHERE n > 1) AS repeated_pairs, count(*) AS pairs, count(*) FILTER (WHERE y = 1) AS pos FROM per GROUP BY 1)
SELECT cutoff_date, null_rows, bad_labels, repeated_pairs,
  abs(pairs - (SELECT count(*) FROM cand c WHERE c.cutoff_date = f.cutoff_date)) AS candidate_diff,
  abs(pos - (SELECT count(*) FROM cand c JOIN bought b USING (user_id, item_id, cutoff_date) WHERE c.cutoff_date = f.cutoff_date)) AS positive_diff FROM f"""
PLANTED_ITEMS = """, spoilt AS (SELECT * REPLACE (CASE WHEN item_id = '0' THEN NULL ELSE item_buy_all END AS item_buy_all, CASE WHEN item_id = '2' THEN 24 ELSE item_peak_hour END AS item_peak_hour,
  CASE WHEN item_id = '3' THEN 1 - item_is_cold ELSE item_is_cold END AS item_is_cold) FROM feat_item WHERE cutoff_date > '%s'),
planted AS (SELECT * FROM spoilt UNION ALL SELECT * FROM spoilt WHERE item_id = '1') """ % min(S.prediction_days)
PLANTED_SAMPLE = """, spoilt AS (SELECT CASE WHEN item_id = '2' THEN NULL ELSE user_id END AS user_id, item_id, cutoff_date, CASE WHEN item_id = '0' THEN 2 ELSE label END AS label FROM sample WHERE item_id <> '3'),
bad AS (SELECT * FROM spoilt UNION ALL SELECT * FROM spoilt WHERE item_id = '1')"""


def oracle() -> dict[str, str]:
    one = lambda select: _q(RAW, select)
    day = lambda select: _q(BASE, select)
    out = {
        "row_count": one("SELECT count(*) AS n_rows FROM raw"),
        "missing_values": one("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL{more}) AS {c}_missing" for c, more in (("user_id", " OR user_id = ''"), ("item_id", " OR item_id = ''"), ("behavior_type", ""), ("item_category", " OR item_category = ''"), ("time", ""))) + " FROM raw"),
        "behavior_domain": one("SELECT behavior_type, count(*) AS cnt FROM raw GROUP BY 1"),
        "time_range": one("SELECT strftime(min(time), '%Y-%m-%d %H:%M:%S') AS min_time, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS max_time, min(hour(time)) AS min_hour, max(hour(time)) AS max_hour, count(*) FILTER (WHERE time IS NULL) AS null_times FROM raw"),
        "duplicate_rows": one("SELECT (SELECT count(*) FROM raw) AS total_rows, count(*) AS distinct_rows, (SELECT count(*) FROM raw) - count(*) AS duplicate_rows FROM (SELECT DISTINCT * FROM raw)"),
        "item_category_consistency": one("SELECT count(*) AS n_items FROM (SELECT item_id FROM raw GROUP BY 1 HAVING count(DISTINCT item_category) > 1)"),
        "scale": one("SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(DISTINCT item_category) AS n_categories FROM raw"),
        "daily_breakdown": one(f"SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS total, {_n(1, 'browse')}, {_n(2, 'favorite')}, {_n(3, 'cart')}, {_n(4, 'buy')} FROM raw GROUP BY 1"),
        "peak_day": one("SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS total FROM raw GROUP BY 1 ORDER BY total DESC, day LIMIT 1"),
        "target_prevalence": one("SELECT count(*) AS buy_events, (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM raw WHERE behavior_type = 4)) AS buy_pairs FROM raw WHERE behavior_type = 4"),
        "user_activity": one("SELECT user_id, count(*) AS n_actions FROM raw GROUP BY 1"),
        "activity_percentiles": one("SELECT round(quantile_cont(n, 0.5), 9) AS p50, round(quantile_cont(n, 0.9), 9) AS p90, round(quantile_cont(n, 0.99), 9) AS p99, max(n) AS max_actions FROM (SELECT count(*) AS n FROM raw GROUP BY user_id)"),
        "user_activity_histogram": one("SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least((n - lo) * 50 // greatest(hi - lo, 1), 49) END AS BIGINT) AS bin, count(*) AS n_users FROM (SELECT n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM (SELECT count(*) AS n FROM raw GROUP BY user_id)) GROUP BY 1"),
        "buyers_and_cold_items": one("SELECT count(DISTINCT user_id) FILTER (WHERE behavior_type = 4) AS n_buyers, count(DISTINCT item_id) FILTER (WHERE behavior_type = 4) AS n_items_bought, count(DISTINCT item_id) - count(DISTINCT item_id) FILTER (WHERE behavior_type = 4) AS n_items_never_bought FROM raw"),
        "sparsity": one("SELECT round((SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM raw)) / CAST(count(DISTINCT user_id) AS DOUBLE), 9) AS items_per_user FROM raw"),
        "behavior_share": one("SELECT behavior_type, count(*) AS cnt, round(count(*) * 100.0 / sum(count(*)) OVER (), 9) AS pct FROM raw GROUP BY 1"),
        "positive_rate": one("SELECT b AS buy_pairs, a AS all_pairs, round(b * 100.0 / a, 9) AS pct FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM raw WHERE behavior_type = 4)) AS b, (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM raw)) AS a)"),
        "orders_daily": "SELECT strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(l_orderkey % 30 * 24 + floor(l_quantity) % 24 AS INTEGER)), '%Y-%m-%d') AS day, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE l_linenumber % 4 + 1 = {c}) AS {n}" for c, n in ((1, "browse"), (2, "favorite"), (3, "cart"), (4, "buy"))) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1",
        "orders_scale": "SELECT count(DISTINCT o_custkey) AS n_users, count(DISTINCT l_partkey) AS n_items, count(DISTINCT p_type) AS n_categories FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
        "sample_labels": day("SELECT * FROM sample"),
        "sample_summary": day("SELECT cutoff_date, count(*) AS n_candidates, CAST(sum(label) AS BIGINT) AS n_positives, round(sum(label) * 100.0 / count(*), 9) AS positive_rate_pct FROM sample GROUP BY 1"),
        "candidate_recall": day("SELECT b.cutoff_date, count(*) AS n_bought, count(c.user_id) AS n_hit, round(count(c.user_id) / CAST(count(*) AS DOUBLE), 9) AS recall FROM bought b LEFT JOIN cand c USING (user_id, item_id, cutoff_date) GROUP BY 1"),
        "positive_recount": day("SELECT cutoff_date, count(*) AS n_positives FROM cand JOIN bought USING (user_id, item_id, cutoff_date) GROUP BY 1"),
        "sample_checks": f"WITH {BASE}, bad AS (SELECT * FROM sample){SAMPLE_CHECKS}", "sample_checks_planted": f"WITH {BASE}{PLANTED_SAMPLE}{SAMPLE_CHECKS}",
        "structural_checks_planted": f"WITH {BASE}, {FEAT_ITEM}{PLANTED_ITEMS}{_structure('feat_item', 'planted')}",
        "reconcile_planted": _q(f"{BASE}, {FEAT_CATEGORY}, c(column_name) AS (VALUES {', '.join(f'({c!r})' for c in TABLES['feat_category']['columns'])})", "SELECT column_name, (SELECT count(*) + 1 FROM feat_category) AS n_keys, 1 + CASE WHEN column_name = 'category_buy_all' THEN (SELECT count(*) FROM feat_category WHERE item_category = '0') ELSE 0 END AS n_mismatches FROM c"),
        "candidate_item_semi_join": day("SELECT item_id, cutoff_date, count(*) AS n_rows FROM hist WHERE (item_id, cutoff_date) IN (SELECT item_id, cutoff_date FROM cand) GROUP BY 1, 2"),
        "spot_check_history": day(f"""SELECT cutoff_date, label, user_id, item_id, rank, strftime(time, '%Y-%m-%d %H') AS hour, behavior_type FROM (
          SELECT r.*, c.cutoff_date, c.label, row_number() OVER (PARTITION BY c.cutoff_date, c.user_id, c.item_id ORDER BY time, behavior_type) AS rank
          FROM (SELECT *, row_number() OVER (PARTITION BY cutoff_date, label ORDER BY user_id, item_id) AS p FROM sample) c JOIN raw r USING (user_id, item_id)
          WHERE p <= 2 AND time >= CAST(c.cutoff_date AS DATE) - INTERVAL {LOOK} DAY AND time < CAST(c.cutoff_date AS DATE) + INTERVAL 1 DAY) WHERE rank <= 20"""),
        "user_hour_histogram": day(f"SELECT user_id, cutoff_date, hod, count(*) AS total_cnt, {_n(1, 'browse_cnt')}, {_n(4, 'buy_cnt')} FROM hist GROUP BY 1, 2, 3"),
        "item_hour_histogram": _q(f"{BASE}, {ITEM_HIST}", f"SELECT item_id, cutoff_date, hod, count(*) AS total_cnt, {_n(1, 'browse_cnt')}, {_n(4, 'buy_cnt')} FROM ihist GROUP BY 1, 2, 3"),
        "pair_hour_presence": _q(f"{BASE}, {PAIR_HIST}", "SELECT DISTINCT user_id, item_id, cutoff_date, hod FROM phist"),
        "peak_hour_recipe": _q(f"{BASE}, fup AS ({_peak('user_id', 'hist', 'user')})", "SELECT * FROM fup"),
        "context_features": f"WITH d(cutoff_date) AS (VALUES {', '.join(f'({x!r})' for x in S.prediction_days)}) SELECT cutoff_date, {CONTEXT} FROM d",
        "day_type": f"WITH d(cutoff_date) AS (VALUES {', '.join(f'({x!r})' for x in S.prediction_days)}) SELECT cutoff_date, {DAY_TYPE % ('cutoff_date', 'cutoff_date')} AS day_type FROM d",
        "combined_feat_category": _q(f"{BASE}, {FEAT_CATEGORY}", "SELECT * FROM feat_category"),
        "assemble": _q(MATRIX, "SELECT * FROM matrix"),
        "assembled_null_report": _q(MATRIX, "SELECT count(*) AS n_rows, CAST(sum(" + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in ["label", *[c for t in TABLES.values() for c in t["columns"]]]) + ") AS BIGINT) AS n_nulls FROM matrix"),
        "split_counts": day(f"SELECT CASE WHEN cutoff_date IN ({', '.join(map(repr, S.test_days))}) THEN 'test' ELSE 'trainval' END AS part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_positives FROM sample GROUP BY 1"),
        "build_folds": f"WITH folds(fold, cutoff_date, role) AS (VALUES {FOLDS}) SELECT *, {DAY_TYPE % (('(SELECT max(cutoff_date) FROM folds v WHERE v.fold = folds.fold)',) * 2)} AS day_type FROM folds",
        "fold_spec": _q(f"{BASE}, {FOLDED}", f"""SELECT fold, val_date, {DAY_TYPE % ('val_date', 'val_date')} AS day_type, n AS train_rows_natural, p AS train_positives, p + least(n - p, {S.negative_ratio} * p) AS train_rows_downsampled, val_rows, val_positives
          FROM (SELECT fold, max(cutoff_date) FILTER (WHERE role = 'val') AS val_date, count(*) FILTER (WHERE role = 'train') AS n, count(*) FILTER (WHERE role = 'train' AND label = 1) AS p, count(*) FILTER (WHERE role = 'val') AS val_rows, count(*) FILTER (WHERE role = 'val' AND label = 1) AS val_positives FROM folded GROUP BY 1)"""),
        "downsampled_train": _q(f"{BASE}, {FOLDED}", f"""SELECT fold, user_id, item_id, cutoff_date, label FROM (
          SELECT *, sum(label) OVER (PARTITION BY fold) AS p, row_number() OVER (PARTITION BY fold, label ORDER BY md5(concat_ws('|', user_id, item_id, cutoff_date, CAST(fold AS VARCHAR), '{S.seed}')), user_id, item_id) AS r FROM folded WHERE role = 'train')
          WHERE label = 1 OR p = 0 OR r <= {S.negative_ratio} * p"""),
        "rule_pr_auc": _q(SCORED, PR),
        "rule_roc_auc": _q(SCORED, ROC),
        "rule_precision_at_k": _q(SCORED, "SELECT fold, model, " + ", ".join(f"round(sum(label) FILTER (WHERE r <= {k}) / CAST(least(count(*), {k}) AS DOUBLE), 9) AS p_at_{k}, round(coalesce(sum(label) FILTER (WHERE r <= {k}) / CAST(nullif(sum(label), 0) AS DOUBLE), 0), 9) AS r_at_{k}" for k in (100, 500, 1000)) + " FROM (SELECT *, row_number() OVER (PARTITION BY fold, model ORDER BY score DESC, user_id, item_id) AS r FROM scored) GROUP BY 1, 2"),
        "metrics_by_day_type": _q(f"{SCORED}, pr AS ({PR}), m AS (SELECT pr.*, {DAY_TYPE % ('cutoff_date', 'cutoff_date')} AS day_type FROM pr JOIN folds USING (fold) WHERE role = 'val')", "SELECT model, " + ", ".join(f"round(avg(pr_auc) FILTER (WHERE day_type = '{k}'), 6) AS {k}" for k in ("before_sale", "on_sale", "after_sale")) + ", round(avg(pr_auc), 6) AS overall FROM m GROUP BY 1"),
    }
    out |= {name: _q(f"{BASE}, {tables}", f"SELECT * FROM {name}") for name, tables in ALL_FEATS.items()}
    cols = {
        "user_counts": ("feat_user", "user_id", "cutoff_date", "user_browse_1d", "user_browse_7d", "user_browse_all", "user_favorite_all", "user_cart_all", "user_buy_all"),
        "user_hour_pivot": ("feat_user", "user_id", "cutoff_date", *[f"user_action_{h}" for h in range(24)]),
        "user_peak_hours": ("feat_user", "user_id", "cutoff_date", "user_peak_hour", "user_browse_peak_hour", "user_buy_peak_hour"),
        "user_daypart_fractions": ("feat_user", "user_id", "cutoff_date", "user_morning_fraction", "user_afternoon_fraction", "user_night_fraction"),
        "user_hour_entropy": ("feat_user", "user_id", "cutoff_date", "user_hour_entropy"),
        "user_recency": ("feat_user", "user_id", "cutoff_date", "user_since_last_hour"),
        "item_counts": ("feat_item", "item_id", "cutoff_date", "item_category", "item_browse_all", "item_favorite_all", "item_cart_all", "item_buy_all", "item_distinct_user"),
        "item_peak_hours": ("feat_item", "item_id", "cutoff_date", "item_peak_hour", "item_browse_peak_hour", "item_buy_peak_hour"),
        "category_counts": ("feat_category", "item_category", "cutoff_date", "category_browse_all", "category_buy_all", "category_distinct_item"),
        "user_category_counts": ("feat_user_category", "user_id", "item_category", "cutoff_date", "user_category_browse_all", "user_category_buy_all"),
        "user_item_counts": ("feat_user_item", "user_id", "item_id", "cutoff_date", "user_item_browse_1d", "user_item_browse_7d", "user_item_browse_all", "user_item_browse_distinct_hour", "user_item_cart_all", "user_item_buy_all"),
        "user_item_last_behavior": ("feat_user_item", "user_id", "item_id", "cutoff_date", "user_item_last_behavior"),
        "user_item_recency": ("feat_user_item", "user_id", "item_id", "cutoff_date", "user_item_since_last_hour"),
        "user_item_peak_flags": ("feat_user_item", "user_id", "item_id", "cutoff_date", "user_item_is_user_peak_hour", "user_item_is_item_peak_hour"),
    }
    out |= {name: _some(*spec) for name, spec in cols.items()}
    out["conversion_ratios"] = _some("feat_user", "user_id", "cutoff_date", "user_conversion_browse_buy", "user_conversion_cart_buy")
    for table, facts in TABLES.items():
        out[f"structural_checks_{table}"] = _q(f"{BASE}, {ALL_FEATS[table]}", _structure(table, table))
        names = ", ".join(f"('{c}')" for c in facts["columns"])
        out[f"reconcile_{table}"] = _q(f"{BASE}, {ALL_FEATS[table]}, c(column_name) AS (VALUES {names})", f"SELECT column_name, (SELECT count(*) FROM {table}) AS n_keys, CAST(0 AS BIGINT) AS n_mismatches FROM c")
        key = ", ".join(facts["key"])
        out[f"key_sample_{table}"] = _q(f"{BASE}, {ALL_FEATS[table]}", f"SELECT {key} FROM (SELECT {key}, md5(concat_ws('|', {key}, '{S.seed}')) AS m, row_number() OVER (PARTITION BY cutoff_date ORDER BY md5(concat_ws('|', {key}, '{S.seed}'))) AS r FROM {table}) ORDER BY r > 1, m LIMIT 16")
    return out
