"""Text reports of a backtest, out of a few rows of metrics each; only those rows come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from filingloom.operators import metrics
from filingloom.operators.scores import SIGNALS

WIDTH = 70
_ORDER = [name for _, name in SIGNALS] + ["STRONG_SELL"]


def _head(title: str) -> list[str]:
    return ["", "-" * WIDTH, f"  {title}", "-" * WIDTH]


def _ratio(x: float | None) -> str:
    return "N/A" if x is None else f"{x:.3f}"


def backtest_report(rows: DataFrame, key: str, title: str, settings: dict[str, str], misses: int = 5) -> str:
    """A backtest in words: settings, summary, precision and returns by signal, confusion, worst misses.

    ``rows`` have signal, score, ret and direction; parts without rows are left out.
    """
    lines = ["=" * WIDTH, f"  {title}", "=" * WIDTH, "", *[f"  {k + ':':<18}{v}" for k, v in settings.items()]]
    m = metrics.summary(rows).first()
    lines += _head("PERFORMANCE SUMMARY")
    lines += [f"  {k + ':':<24}{v}" for k, v in (("Total signals", m.total), ("Scorable", m.scorable), ("Hit rate", f"{m.hit_rate:.1%}"), ("Directional accuracy", f"{m.directional_accuracy:.1%}"), ("Sharpe ratio", _ratio(m.sharpe)))]
    precision = {r.signal: r for r in metrics.precision_by_signal(rows).collect()}
    if precision:
        lines += _head("PRECISION BY SIGNAL") + [f"  {'Signal':<15} {'Correct':>8} {'Total':>8} {'Precision':>10}"]
        lines += [f"  {s:<15} {precision[s].correct:>8} {precision[s].total:>8} {precision[s].precision:>10.1%}" for s in _ORDER if s in precision]
    returned = {r.signal: r for r in metrics.return_by_signal(rows).collect()}
    if returned:
        lines += _head("AVERAGE RETURN BY SIGNAL") + [f"  {'Signal':<15} {'Average':>10} {'Min':>8} {'Max':>8} {'Count':>7}"]
        lines += [f"  {s:<15} {r.avg_ret * 100:>+9.1f}% {r.min_ret * 100:>+7.1f}% {r.max_ret * 100:>+7.1f}% {r.n:>7}" for s in _ORDER if (r := returned.get(s))]
    cells = {(r.predicted, r.actual): r.n for r in metrics.confusion(rows).collect()}
    lines += _head("CONFUSION (PREDICTED AGAINST ACTUAL)") + [f"  {'':>12} {'Up':>8} {'Flat':>8} {'Down':>8}"]
    lines += [f"  {p:>12} {cells[p, 'bullish']:>8} {cells[p, 'neutral']:>8} {cells[p, 'bearish']:>8}" for p in ("bullish", "neutral", "bearish")]
    wrong = metrics.worst_misses(rows, key, misses).collect()
    if wrong:
        lines += _head("WORST MISSES") + [f"  {r[key]}: signal {r.signal}, actual {r.ret * 100:+.1f}% ({r.direction})" for r in wrong]
    return "\n".join([*lines, "", "=" * WIDTH])


def comparison_report(rows: DataFrame, by: str, title: str) -> str:
    """The models of a comparison side by side, and the one with the higher directional accuracy if there are two."""
    lines = ["=" * WIDTH, f"  {title}", "=" * WIDTH]
    found = sorted(metrics.summary(rows, [by]).collect(), key=lambda r: r[by])
    for r in found:
        lines += ["", f"  [{r[by]}]"] + [f"    {k + ':':<22}{v}" for k, v in (("Signals", r.total), ("Hit rate", f"{r.hit_rate:.1%}"), ("Directional accuracy", f"{r.directional_accuracy:.1%}"), ("Sharpe ratio", _ratio(r.sharpe)))]
    if len(found) == 2:
        a, b = found
        gap = a.directional_accuracy - b.directional_accuracy
        lines += ["", f"  Winner: {a[by] if gap > 0 else b[by] if gap < 0 else 'Tie'} (+{abs(gap):.1%} directional accuracy)"]
    return "\n".join([*lines, "", "=" * WIDTH])
