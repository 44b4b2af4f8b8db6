"""Which chart suits a column, a pair or a finding, and charts as SVG."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from plumbline.functions.formats import stat
from plumbline.operators import limits as L
from plumbline.operators.stats import iqr_bounds

SKEWED = {"F-SKEW", "F-MISSING-IMPUTE", "F-TARGET-SKEW"}
OUTLYING = {"F-OUTLIER-RATE", "F-OUTLIER-ACTION"}


def for_column(c: dict) -> list[dict]:
    s, axis = c.get("stats") or {}, {"x": c["name"], "y": "count"}
    out = []
    if c["type"] in ("numeric", "datetime") and s.get("histogram"):
        out.append({"kind": "histogram", "data": s["histogram"], "axis": axis | ({"time": True} if c["type"] == "datetime" else {})})
    if c["type"] == "numeric" and "median" in s:
        out.append({"kind": "boxplot", "data": {k: s[k] for k in ("min", "q1", "median", "q3", "max")}, "axis": {"x": c["name"]}})
    if c["type"] in ("categorical", "boolean") and s.get("topValues"):
        out.append({"kind": "bar", "data": {"items": s["topValues"]}, "axis": axis})
    return out


def for_pairs(pairs: Sequence[dict]) -> list[dict]:
    ranked = sorted((p for p in pairs if p["pearson"] is not None and p.get("points")), key=lambda p: -abs(p["pearson"]))
    return [{"kind": "scatter", "data": {k: p[k] for k in ("points", "pearson", "spearman")}, "axis": {"x": p["left"], "y": p["right"]}} for p in ranked[: L.SCATTER_PAIRS]]


def heatmap(pairs: Sequence[dict], columns: Sequence[dict], method: str = "pearson") -> dict | None:
    """Cells of the pairs' matrix in column order; of many columns those of the largest variance."""
    involved = {n for p in pairs for n in (p["left"], p["right"])}
    names = [c["name"] for c in columns if c["name"] in involved]
    if len(names) < 2:
        return None
    reduced = len(names) > L.HEATMAP_COLUMNS
    if reduced:
        spread = {c["name"]: (c.get("stats") or {}).get("std") or 0.0 for c in columns}
        kept = set(sorted(names, key=lambda n: -spread[n])[: L.HEATMAP_COLUMNS])
        names = [n for n in names if n in kept]
    at = {n: k for k, n in enumerate(names)}
    cells = [{"row": at[p["left"]], "col": at[p["right"]], "value": p[method]} for p in pairs if p["left"] in at and p["right"] in at and p[method] is not None]
    return {"kind": "heatmap", "data": {"names": names, "cells": cells, "reduced": reduced}, "axis": {"method": method}}


def for_finding(f: dict, columns: Sequence[dict]) -> list[dict]:
    c = next((c for c in columns if f["scope"] == "column" and c["name"] == f["targets"][0]), None)
    if c is None:
        return []
    base, s = for_column(c), c.get("stats") or {}
    if f["type"] in SKEWED:
        return [b | {"axis": b["axis"] | {"highlight": {"skewness": s.get("skewness")}}} for b in base if b["kind"] == "histogram"]
    if f["type"] in OUTLYING:
        lower, upper = iqr_bounds(s["q1"], s["q3"])
        return [b | {"data": b["data"] | {"bounds": {"lower": lower, "upper": upper}}} for b in base if b["kind"] == "boxplot"]
    return base


WIDTH, HEIGHT, PAD = 420, 260, 40


def linear(domain: tuple[float, float], to: tuple[float, float]):
    """A map from one interval to another; a domain without extent maps to the middle."""
    (a, b), (x, y) = domain, to
    return lambda v: (x + y) / 2 if a == b else x + (v - a) / (b - a) * (y - x)


def _text(x: float, y: float, s: str, anchor: str = "middle") -> str:
    return f'<text x="{x:.1f}" y="{y:.1f}" text-anchor="{anchor}" font-size="11">{escape(str(s), quote=True)}</text>'


def axis(domain: tuple[float, float], title: str, ticks: int = 5) -> str:
    """The horizontal axis with its ticks and title."""
    place = linear(domain, (PAD, WIDTH - PAD / 2))
    base = HEIGHT - PAD
    out = [f'<line x1="{PAD}" x2="{WIDTH - PAD / 2}" y1="{base}" y2="{base}" stroke="#888"/>']
    for k in range(ticks):
        v = domain[0] + (domain[1] - domain[0]) * k / (ticks - 1)
        out.append(_text(place(v), base + 14, stat(v)))
    return "".join([*out, _text(WIDTH / 2, HEIGHT - 6, title)])


def _bars(edges: Sequence[float], counts: Sequence[int]) -> str:
    x, y = linear((edges[0], edges[-1]), (PAD, WIDTH - PAD / 2)), linear((0, max(counts, default=1) or 1), (HEIGHT - PAD, PAD / 2))
    out = []
    for a, b, n in zip(edges, edges[1:], counts, strict=False):
        left, right = (x(a), x(b)) if edges[0] < edges[-1] else (PAD, WIDTH - PAD / 2)
        out.append(f'<rect x="{left:.1f}" y="{y(n):.1f}" width="{max(0.5, right - left - 1):.1f}" height="{HEIGHT - PAD - y(n):.1f}" fill="#4a7fb5"/>')
    return "".join(out)


def _histogram(d: dict, a: dict) -> str:
    edges = d["binEdges"]
    out = _bars(edges, d["counts"])
    if d.get("density"):
        x, y = linear((edges[0], edges[-1]), (PAD, WIDTH - PAD / 2)), linear((0, max(d["counts"]) or 1), (HEIGHT - PAD, PAD / 2))
        out += f'<polyline fill="none" stroke="#b5524a" points="{" ".join(f"{x(p):.1f},{y(q):.1f}" for p, q in d["density"])}"/>'
    return out + axis((edges[0], edges[-1]), a["x"])


def _boxplot(d: dict, a: dict) -> str:
    x, mid = linear((d["min"], d["max"]), (PAD, WIDTH - PAD / 2)), HEIGHT / 2
    out = f'<line x1="{x(d["min"]):.1f}" x2="{x(d["max"]):.1f}" y1="{mid}" y2="{mid}" stroke="#555"/>'
    out += f'<rect x="{x(d["q1"]):.1f}" y="{mid - 30}" width="{max(1, x(d["q3"]) - x(d["q1"])):.1f}" height="60" fill="#cfe0f0" stroke="#4a7fb5"/>'
    for v, colour in [(d["median"], "#4a7fb5"), *((v, "#b5524a") for v in d.get("bounds", {}).values() if d["min"] <= v <= d["max"])]:
        out += f'<line x1="{x(v):.1f}" x2="{x(v):.1f}" y1="{mid - 30}" y2="{mid + 30}" stroke="{colour}"/>'
    return out + axis((d["min"], d["max"]), a["x"])


def _bar(d: dict, a: dict) -> str:
    items, out = d["items"], []
    x, step = linear((0, max(i["count"] for i in items)), (0, WIDTH - 190)), (HEIGHT - PAD) / len(items)
    for k, i in enumerate(items):
        label = i["value"] if len(i["value"]) <= 18 else i["value"][:17] + "…"
        out.append(_text(140, 10 + step * (k + 0.7), label, "end") + f'<rect x="146" y="{10 + step * k + 2:.1f}" width="{x(i["count"]):.1f}" height="{max(1, step - 4):.1f}" fill="#4a7fb5"/>' + _text(150 + x(i["count"]), 10 + step * (k + 0.7), i["count"], "start"))
    return "".join(out) + _text(WIDTH / 2, HEIGHT - 6, a["x"])


def _scatter(d: dict, a: dict) -> str:
    xs, ys = zip(*d["points"], strict=True)
    x, y = linear((min(xs), max(xs)), (PAD, WIDTH - PAD / 2)), linear((min(ys), max(ys)), (HEIGHT - PAD, PAD / 2))
    dots = "".join(f'<circle cx="{x(p):.1f}" cy="{y(q):.1f}" r="2" fill="#4a7fb5" fill-opacity="0.6"/>' for p, q in d["points"])
    return dots + axis((min(xs), max(xs)), a["x"]) + _text(PAD, 12, a["y"], "start")


def _heatmap(d: dict, a: dict) -> str:
    n = len(d["names"])
    size = (HEIGHT - PAD) / n
    out = []
    for c in d["cells"]:
        strength = min(1.0, abs(c["value"]))
        fade = [round(255 + (t - 255) * strength) for t in ((74, 127, 181) if c["value"] >= 0 else (181, 82, 74))]
        for r, k in ((c["row"], c["col"]), (c["col"], c["row"])):
            out.append(f'<rect x="{PAD * 2 + k * size:.1f}" y="{r * size:.1f}" width="{size:.1f}" height="{size:.1f}" fill="rgb({fade[0]},{fade[1]},{fade[2]})"><title>{escape(d["names"][r])} {escape(d["names"][k])} {stat(c["value"])}</title></rect>')
    return "".join(out) + "".join(_text(PAD * 2 - 4, (k + 0.6) * size, name[:12], "end") for k, name in enumerate(d["names"]))


_DRAW = {"histogram": _histogram, "boxplot": _boxplot, "bar": _bar, "scatter": _scatter, "heatmap": _heatmap}


def render(spec: dict) -> str:
    """A chart as SVG text."""
    title = escape(f"{spec['kind']} {spec['axis'].get('x', '')}".strip(), quote=True)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-label="{title}">{_DRAW[spec["kind"]](spec["data"], spec["axis"])}</svg>'
