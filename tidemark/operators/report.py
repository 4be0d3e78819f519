"""The exploration report: Markdown text, and charts where a plotting library is installed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.operators import explore as E


def collect_profile(log: DataFrame) -> dict[str, list[dict]]:
    """Every profile query's few rows; nothing here grows with the log but the days."""
    parts = {
        "rows": E.row_count, "missing values": E.missing_values, "behaviours": E.behavior_share, "time": E.time_range, "duplicates": E.duplicate_rows,
        "items in several categories": E.item_category_consistency, "scale": E.scale, "days": E.daily_breakdown, "busiest day": E.peak_day, "buys": E.target_prevalence,
        "positive rate": E.positive_rate, "actions per user": E.activity_percentiles, "activity histogram": E.activity_histogram, "buyers and cold items": E.buyers_and_cold_items, "sparsity": E.sparsity,
    }
    return {name: [r.asDict() for r in f(log).collect()] for name, f in parts.items()}


def _cell(v) -> str:
    return f"{v:,.4f}".rstrip("0").rstrip(".") if isinstance(v, float) else f"{v:,}" if isinstance(v, int) else str(v)


def markdown(profile: dict[str, list[dict]], csv_rows: int | None = None, charts: dict[str, str] | None = None) -> str:
    lines = ["# Log profile", ""]
    if csv_rows is not None:
        loaded = profile["rows"][0]["n_rows"]
        lines += [f"CSV rows: {csv_rows:,}; loaded: {loaded:,}; {'equal' if csv_rows == loaded else 'DIFFERENT'}.", ""]
    for name, rows in profile.items():
        lines += [f"## {name.capitalize()}", ""]
        if rows:
            head = list(rows[0])
            lines += [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *(f"| {' | '.join(_cell(r[h]) for h in head)} |" for r in rows), ""]
        if charts and name in charts:
            lines += [f"![{name}]({charts[name]})", ""]
    return "\n".join(lines)


def draw_charts(profile: dict[str, list[dict]], folder: Path) -> dict[str, str]:
    """Daily volume, behaviours, buys by day and the activity histogram; none without matplotlib."""
    try:
        import matplotlib
    except ImportError:
        return {}
    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    folder.mkdir(parents=True, exist_ok=True)
    days = [r["day"] for r in profile["days"]]
    made = {}
    for name, kind, x, y in (
        ("days", "plot", days, [r["total"] for r in profile["days"]]), ("behaviours", "bar", [str(r["behavior_type"]) for r in profile["behaviours"]], [r["cnt"] for r in profile["behaviours"]]),
        ("buys", "bar", days, [r["buy"] for r in profile["days"]]), ("activity histogram", "bar", [r["bin"] for r in profile["activity histogram"]], [r["n_users"] for r in profile["activity histogram"]]),
    ):
        fig, ax = plt.subplots()
        getattr(ax, kind)(x, y)
        ax.set_title(name)
        if name == "activity histogram":
            ax.set_yscale("log")
        ax.tick_params(axis="x", rotation=90)
        fig.tight_layout()
        fig.savefig(folder / f"{name.replace(' ', '_')}.png", dpi=120)
        plt.close(fig)
        made[name] = f"{name.replace(' ', '_')}.png"
    return made


def write_report(log: DataFrame, out: Path, csv_rows: int | None = None) -> Path:
    profile = collect_profile(log)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_text(markdown(profile, csv_rows, draw_charts(profile, out.parent)))
    return out
