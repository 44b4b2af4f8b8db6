"""From findings to suggested cleaning steps."""

from __future__ import annotations

from collections.abc import Sequence

#: The order in which steps are applied, and so listed. Fixed values.
STEP_ORDER = ("drop-duplicates", "drop-column", "impute", "outlier", "log1p", "encode", "scale")
#: Findings that no step answers, and why.
NO_STEP = {
    "F-KURTOSIS": "heavy tails are a property to know, not an error",
    "F-BIN-SENSITIVE": "it concerns how a chart is read",
    "F-CORR-METHOD": "it concerns which measure to read",
    "F-CORR-CAUSAL": "it concerns how a correlation is read",
    "F-CLASS-IMBALANCE": "weights and resampling belong to the training",
    "F-MIXED-RELATION": "it is a note about mixed types",
}
COST = {
    "drop-duplicates": "Separate events that look alike are merged.",
    "drop-column": "What the column says is lost.",
    "impute": "Filled values are guesses, and the spread shrinks.",
    "clip": "Extreme values lose their true size.",
    "drop-rows": "Whole rows are lost.",
    "log1p": "Values are no longer in their own unit.",
    "encode": "Levels with equal counts become one.",
    "scale": "Values are no longer in their own unit.",
}


def _step(op: str, column: str | None = None, method: str | None = None, action: str | None = None) -> dict:
    label = " ".join(x for x in (op, column, method or action) if x)
    return {"op": op, "column": column, "method": method, "action": action, "label": label, "cost": COST[action if action in COST else op]}


def _impute(name: str, kinds: dict[str, str]) -> dict:
    return _step("impute", name, "median" if kinds.get(name) == "numeric" else "mode")


def _steps(f: dict, kinds: dict[str, str]) -> list[dict]:
    kind, targets = f["type"], f["targets"]
    if kind == "F-DUP-ROW":
        return [_step("drop-duplicates")]
    if kind == "F-SCALE-DIFF":
        return [_step("scale", name, "standard") for name, k in kinds.items() if k == "numeric"]
    if kind == "F-LEAKAGE":
        return [_step("drop-column", t) for t in targets[:1]]
    out = []
    for t in targets:
        if kind in ("F-CONST-COL", "F-ID-COL", "F-MULTICOLLINEAR"):
            out.append(_step("drop-column", t))
        elif kind == "F-HIGH-CARD":
            out += [_step("encode", t, "frequency"), _step("drop-column", t)]
        elif kind == "F-MISSING-HIGH":
            out += [_impute(t, kinds), _step("drop-column", t)]
        elif kind == "F-MISSING-IMPUTE":
            out.append(_impute(t, kinds))
        elif kind in ("F-OUTLIER-RATE", "F-OUTLIER-ACTION"):
            out += [_step("outlier", t, action="clip"), _step("outlier", t, action="drop-rows")]
        elif kind in ("F-SKEW", "F-TARGET-SKEW"):
            out.append(_step("log1p", t))
    return out


def suggest(found: Sequence[dict], columns: Sequence[dict]) -> list[dict]:
    """Steps for all findings, folded ones too, each once; id is op:column:method or action."""
    kinds = {c["name"]: c["type"] for c in columns}
    out: dict[str, dict] = {}
    for f in found:
        for s in _steps(f, kinds):
            key = f"{s['op']}:{s['column'] or ''}:{s['method'] or s['action'] or ''}"
            out.setdefault(key, {"id": key, **s, "findingType": f["type"]})
    return list(out.values())


def normalize(steps: Sequence[dict]) -> list[dict]:
    """The first step of each kind a column, in the order of application; unknown kinds last."""
    seen, kept = set(), []
    for s in steps:
        key = (s["op"], s.get("column"))
        if key not in seen:
            seen.add(key)
            kept.append(s)
    return sorted(kept, key=lambda s: STEP_ORDER.index(s["op"]) if s["op"] in STEP_ORDER else len(STEP_ORDER))
