"""Line plots of training logs as SVG text: convergence by rounds, bits or seconds, one line for each run."""

from html import escape

import numpy as np
from pyspark.sql import DataFrame

#: Colours and dashes of the lines, in turn. Fixed values.
COLOURS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#ff7f0e", "#17becf")
DASHES = ("", "6,3", "2,2", "8,3,2,3")
WIDTH, HEIGHT, LEFT, BELOW, ABOVE = 640, 420, 80, 50, 30


def _ticks(low: float, high: float, log: bool) -> list[float]:
    if log:
        step = max(1, int(np.ceil((high - low) / 8)))
        return [float(e) for e in range(int(np.ceil(low)), int(np.floor(high)) + 1, step)] or [low, high]
    return np.linspace(low, high, 6).tolist()


def svg(series: dict[str, tuple[list[float], list[float]]], x: str, y: str, title: str = "", log_x: bool = False, log_y: bool = True) -> str:
    """A plot of named (xs, ys); points that a logarithmic axis cannot show are left out of the line."""
    told = {}
    for name, (xs, ys) in series.items():
        a, b = np.array(xs, float), np.array(ys, float)
        fine = np.isfinite(a) & np.isfinite(b) & ((a > 0) | (not log_x)) & ((b > 0) | (not log_y))
        told[name] = np.log10(a[fine]) if log_x else a[fine], np.log10(b[fine]) if log_y else b[fine]
    all_x, all_y = (np.concatenate([v[k] for v in told.values()] or [np.zeros(0)]) for k in (0, 1))
    box = [(float(v.min(initial=0.0 if not len(v) else np.inf)), float(v.max(initial=1.0 if not len(v) else -np.inf))) for v in (all_x, all_y)]
    (x0, x1), (y0, y1) = [(a, b if b > a else a + 1) for a, b in box]
    at_x = lambda v: LEFT + (v - x0) / (x1 - x0) * (WIDTH - LEFT - 20)
    at_y = lambda v: HEIGHT - BELOW - (v - y0) / (y1 - y0) * (HEIGHT - BELOW - ABOVE)
    shown = lambda v, log: f"1e{v:g}" if log else f"{v:.3g}"
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12"><rect width="100%" height="100%" fill="white"/>']
    for t in _ticks(x0, x1, log_x):
        out.append(f'<path d="M{at_x(t):.1f} {ABOVE}V{HEIGHT - BELOW}" stroke="#ddd"/><text x="{at_x(t):.1f}" y="{HEIGHT - BELOW + 16}" text-anchor="middle">{shown(t, log_x)}</text>')
    for t in _ticks(y0, y1, log_y):
        out.append(f'<path d="M{LEFT} {at_y(t):.1f}H{WIDTH - 20}" stroke="#ddd"/><text x="{LEFT - 6}" y="{at_y(t) + 4:.1f}" text-anchor="end">{shown(t, log_y)}</text>')
    out.append(f'<text x="{WIDTH / 2}" y="18" text-anchor="middle">{escape(title)}</text><text x="{WIDTH / 2}" y="{HEIGHT - 12}" text-anchor="middle">{escape(x)}</text><text x="16" y="{HEIGHT / 2}" transform="rotate(-90 16 {HEIGHT / 2})" text-anchor="middle">{escape(y)}</text>')
    for k, (name, (a, b)) in enumerate(told.items()):
        colour, dash = COLOURS[k % len(COLOURS)], DASHES[k // len(COLOURS) % len(DASHES)]
        points = " ".join(f"{at_x(p):.1f},{at_y(q):.1f}" for p, q in zip(a, b))
        out.append(f'<polyline fill="none" stroke="{colour}" stroke-width="1.5" stroke-dasharray="{dash}" points="{points}"/><text x="{WIDTH - 30}" y="{ABOVE + 16 * (k + 1)}" fill="{colour}" text-anchor="end">{escape(name)}</text>')
    return "\n".join(out) + "\n</svg>\n"


def plot(rounds: DataFrame, x: str, y: str, by: str, title: str = "", log_x: bool = False, log_y: bool = True) -> str:
    """SVG of column y over column x, a line for each value of `by`; a run's rounds go through the driver."""
    lines: dict[str, tuple[list[float], list[float]]] = {}
    for r in rounds.select(by, x, y).orderBy(by, x).collect():
        xs, ys = lines.setdefault(str(r[0]), ([], []))
        xs.append(r[1])
        ys.append(r[2])
    return svg(lines, x, y, title, log_x, log_y)
