"""The feature tables as plain data, shared by the checks and their SQL twins.

``key``; ``columns``: each feature's definition as an aggregate over the log's rows before the prediction
day ``cutoff``, with its least and greatest value (None: unbounded); ``holds``: conditions on every row.
"""

from __future__ import annotations

from tidemark.functions.columns import AFTERNOON, MORNING, NIGHT
from tidemark.sources.behavior import BROWSE, BUY, CART, FAVORITE

RATIO = "coalesce(try_divide(count_if(behavior_type = {}), count_if(behavior_type = {})), 0.0D)"
RECENT = "count_if(behavior_type = 1 AND time >= CAST(date_sub(cutoff, {}) AS timestamp_ntz))"
HOURS_SINCE = "CAST(bround((unix_seconds(CAST(first(cutoff) AS timestamp)) - unix_seconds(CAST(max(time) AS timestamp))) / 3600.0D) AS bigint)"
IN_HOURS = "avg(CAST(hour(time) IN ({}) AS double))"
PEAK = "CAST(coalesce(mode(IF({}, hour(time), NULL), true), -1) AS bigint)"


def _number(code: int) -> tuple:
    return f"count_if(behavior_type = {code})", 0, None


def _peaks(of: str) -> dict[str, tuple]:
    return {f"{of}_peak_hour": (PEAK.format("true"), 0, 23), f"{of}_browse_peak_hour": (PEAK.format(f"behavior_type = {BROWSE}"), -1, 23), f"{of}_buy_peak_hour": (PEAK.format(f"behavior_type = {BUY}"), -1, 23)}


def _share(hours) -> tuple:
    return IN_HOURS.format(", ".join(map(str, hours))), 0, 1


#: log2 n - (sum of c log2 c) / n
ENTROPY = "abs(log2(count(*)) - ({}) / count(*))".format(" + ".join(f"coalesce(count_if(hour(time) = {h}) * log2(nullif(count_if(hour(time) = {h}), 0)), 0.0D)" for h in range(24)))
FLAG = "CAST({} AS bigint)"

TABLES: dict[str, dict] = {
    "feat_user": {
        "key": ["user_id", "cutoff_date"],
        "columns": {
            "user_browse_1d": (RECENT.format(1), 0, None), "user_browse_7d": (RECENT.format(7), 0, None), "user_browse_all": _number(BROWSE),
            "user_favorite_all": _number(FAVORITE), "user_cart_all": _number(CART), "user_buy_all": _number(BUY),
            "user_conversion_browse_buy": (RATIO.format(BUY, BROWSE), 0, None), "user_conversion_cart_buy": (RATIO.format(BUY, CART), 0, None),
            "user_since_last_hour": (HOURS_SINCE, 0, None), **_peaks("user"),
            "user_morning_fraction": _share(MORNING), "user_afternoon_fraction": _share(AFTERNOON), "user_night_fraction": _share(NIGHT),
            "user_hour_entropy": (ENTROPY, 0, 4.584962500721157), **{f"user_action_{h}": (f"count_if(hour(time) = {h})", 0, None) for h in range(24)},
        },
        "holds": {
            "browse_nested": "user_browse_1d <= user_browse_7d AND user_browse_7d <= user_browse_all",
            "fractions_sum_to_1": "abs(user_morning_fraction + user_afternoon_fraction + user_night_fraction - 1) <= 1e-8",
            "no_buy_no_peak": "(user_buy_all = 0) = (user_buy_peak_hour = -1)",
        },
    },
    "feat_item": {
        "key": ["item_id", "cutoff_date"],
        "columns": {
            "item_category": ("min(item_category)", None, None), "item_browse_all": _number(BROWSE), "item_favorite_all": _number(FAVORITE), "item_cart_all": _number(CART), "item_buy_all": _number(BUY),
            "item_distinct_user": ("count(DISTINCT user_id)", 0, None), "item_conversion_browse_buy": (RATIO.format(BUY, BROWSE), 0, None),
            "item_is_cold": (FLAG.format(f"count_if(behavior_type = {BUY}) = 0"), 0, 1), **_peaks("item"),
        },
        "holds": {"cold_without_buys": "(item_buy_all = 0) = (item_is_cold = 1)", "cold_without_peak": "(item_is_cold = 1) = (item_buy_peak_hour = -1)"},
    },
    "feat_category": {
        "key": ["item_category", "cutoff_date"],
        "columns": {
            "category_browse_all": _number(BROWSE), "category_buy_all": _number(BUY), "category_distinct_item": ("count(DISTINCT item_id)", 0, None),
            "category_conversion_browse_buy": (RATIO.format(BUY, BROWSE), 0, None),
        },
        "holds": {"conversion_not_negative": "category_conversion_browse_buy >= 0"},
    },
    "feat_user_item": {
        "key": ["user_id", "item_id", "cutoff_date"],
        "columns": {
            "user_item_browse_1d": (RECENT.format(1), 0, None), "user_item_browse_7d": (RECENT.format(7), 0, None), "user_item_browse_all": _number(BROWSE),
            "user_item_browse_distinct_hour": (f"count(DISTINCT IF(behavior_type = {BROWSE}, time, NULL))", 0, None), "user_item_cart_all": _number(CART),
            "user_item_cart_not_buy": (FLAG.format(f"count_if(behavior_type = {CART}) > 0 AND count_if(behavior_type = {BUY}) = 0"), 0, 1), "user_item_buy_all": _number(BUY),
            "user_item_is_favorited": (FLAG.format(f"count_if(behavior_type = {FAVORITE}) > 0"), 0, 1),
            "user_item_last_behavior": ("CAST(max_by(behavior_type, struct(time, behavior_type)) AS bigint)", 1, 4), "user_item_since_last_hour": (HOURS_SINCE, 0, None),
            "user_item_is_user_peak_hour": ("max(CAST(hour(time) = user_peak_hour AS bigint))", 0, 1), "user_item_is_item_peak_hour": ("max(CAST(hour(time) = item_peak_hour AS bigint))", 0, 1),
        },
        "holds": {
            "browse_nested": "user_item_browse_1d <= user_item_browse_7d AND user_item_browse_7d <= user_item_browse_all",
            "cart_not_buy": "(user_item_cart_not_buy = 1) = (user_item_cart_all > 0 AND user_item_buy_all = 0)",
            "hours_within_browse": "user_item_browse_distinct_hour <= user_item_browse_all",
        },
    },
    "feat_user_category": {
        "key": ["user_id", "item_category", "cutoff_date"],
        "columns": {"user_category_browse_all": _number(BROWSE), "user_category_buy_all": _number(BUY)},
        "holds": {},
    },
}


def any_null(columns) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


def out_of_range(name: str) -> str:
    """Whether a row has a value below its column's least or above its greatest, in SQL."""
    parts = [f"{c} {op} {x}" for c, (_, low, high) in TABLES[name]["columns"].items() for op, x in (("<", low), (">", high)) if x is not None]
    return " OR ".join(parts) or "1 = 0"
