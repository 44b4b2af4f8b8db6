"""The quality score: 100 less a penalty for each of six parts, over column summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from plumbline.functions.formats import count, percent
from plumbline.operators import limits as L


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _penalty(key: str, measure: float) -> int:
    return _half_up(min(L.PENALTY_CAP[key], measure * L.PENALTY_FACTOR[key]))


def _verdict(key: str, ratio: float) -> str:
    ok, warn = L.VERDICT[key]
    return "ok" if ratio == 0 or ratio < ok else "warn" if ratio < warn else "bad"


def _mean(values: Sequence[float]) -> float:
    return sum(values) / len(values) if values else 0.0


def _worst(columns: Sequence[dict], rate) -> str:
    found = sorted((c for c in columns if rate(c) > 0), key=lambda c: -rate(c))[: L.WORST_COLUMNS]
    return ", ".join(f"{c['name']} {percent(rate(c))}" for c in found)


def health(columns: Sequence[dict], dataset: dict) -> dict:
    """total, grade and six items (key, verdict, penalty, evidence). Ids and free texts count for missing values only."""
    rows = dataset["rowCount"]
    judged = [c for c in columns if c["type"] not in ("id", "text")]
    numeric = [c for c in judged if c["type"] == "numeric"]
    classes = [c for c in judged if c["type"] == "categorical"]
    outlier = lambda c: (c.get("stats") or {}).get("outlierRate") or 0.0
    items = []

    def by_ratio(key: str, ratio: float, evidence: str) -> None:
        items.append({"key": key, "verdict": _verdict(key, ratio), "penalty": _penalty(key, ratio), "evidence": evidence})

    def by_number(key: str, found: Sequence[dict], of: int) -> None:
        bad = of > 0 and len(found) / of >= L.BAD_SHARE[key]
        items.append({"key": key, "verdict": "ok" if not found else "bad" if bad else "warn", "penalty": _penalty(key, len(found)), "evidence": ", ".join(c["name"] for c in found[: L.WORST_COLUMNS])})

    by_ratio("missing", _mean([c["missingRate"] for c in columns]), _worst(columns, lambda c: c["missingRate"]))
    repeated = dataset["duplicateRowCount"]
    by_ratio("duplicate", repeated / rows if rows else 0.0, f"{count(repeated)} of {count(rows)} rows")
    by_number("constant", [c for c in judged if c["modeRate"] >= L.CONSTANT_MODE], len(columns))
    many = [c for c in classes if c["uniqueCount"] >= L.HIGH_CARD_UNIQUE and rows and c["uniqueCount"] / rows >= L.HIGH_CARD_RATIO]
    by_number("cardinality", many, len(classes))
    by_ratio("outlier", _mean([outlier(c) for c in numeric]), _worst(numeric, outlier))
    by_ratio("invalid", _mean([c["invalidRate"] for c in judged]), _worst(judged, lambda c: c["invalidRate"]))
    total = max(0, 100 - sum(i["penalty"] for i in items))
    return {"total": total, "grade": next(g for g, least in L.GRADES if total >= least), "items": items}
