"""The publish-time report, as frames and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from briefspark.operators import profile
from briefspark.plans.briefing import POLICIES, SECURITY

GROUPS = [SECURITY.group, *(p.group for p in POLICIES)]


def report(log: DataFrame, groups: list[str] = GROUPS) -> dict[str, DataFrame]:
    """From log rows (profile.log_rows): span, hours, blocks, weekdays and lags. Unknown groups count in ALL alone, empty ones are shown."""
    return {
        "span": profile.date_span(log, "published_utc"),
        "hours": profile.hour_histogram(log, "published_et_hour"),
        "blocks": profile.listed(profile.block_share(log, "group", "published_et_hour"), "group", groups, "n"),
        "weekdays": profile.listed(profile.weekday_split(log, "group", "published_weekday"), "group", groups, "weekday", "weekend"),
        "lags": profile.listed(profile.lag_report(log, "group", "published_utc", "first_seen_utc"), "group", groups, "n"),
    }


def append(items: DataFrame, log: DataFrame | None, path: str, first_seen) -> int:
    """Add unseen items to the log at ``path``; how many."""
    rows = profile.log_rows(items, first_seen)
    known = rows.limit(0) if log is None else log
    new = profile.unseen(rows, known, ["url"], [F.col("published_utc"), F.col("feed")]).cache()
    try:
        n = new.count()
        new.write.mode("append").parquet(path)
        return n
    finally:
        new.unpersist()


def text(frames: dict[str, DataFrame]) -> str:
    """All frames below each other. They have a few dozen rows whatever the log's size."""
    out = []
    for name, frame in frames.items():
        rows = [frame.columns, *([("-" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)) for v in r] for r in frame.collect())]
        widths = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
        out += ["", name.upper(), *("  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in rows)]
    return "\n".join(out)
