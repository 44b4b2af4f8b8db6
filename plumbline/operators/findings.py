"""Findings: rules over column summaries, ranked and folded by type."""

from __future__ import annotations

from collections.abc import Sequence

from plumbline.functions.formats import count, percent, stat
from plumbline.operators import limits as L

RANK = {"high": 3, "medium": 2, "low": 1}


class _Found:
    def __init__(self):
        self.rows: list[dict] = []
        self.numbers: dict[str, int] = {}

    def add(self, kind: str, severity: str, scope: str, targets: list[str], metrics: dict, ml: bool, what: str, why: str, how: str) -> None:
        self.numbers[kind] = n = self.numbers.get(kind, 0) + 1
        self.rows.append({"id": f"{kind}#{n}", "type": kind, "severity": severity, "scope": scope, "targets": targets, "metrics": metrics, "what": what, "why": why, "how": how, "mlRelevant": ml, "seq": n})


def _stats(c: dict) -> dict:
    return c.get("stats") or {}


def _skew(c: dict) -> float:
    return abs(_stats(c).get("skewness") or 0.0)


def _column_rules(out: _Found, c: dict, rows: int) -> None:
    name, missing = c["name"], c["missingRate"]
    share = c["uniqueCount"] / rows if rows else 0.0
    if missing >= L.MISSING_HIGH:
        out.add("F-MISSING-HIGH", "high", "column", [name], {"missingRate": missing}, False, f"{percent(missing)} of {name} is missing.", "What is left may not stand for the whole.", "Find out why values are missing before you fill or drop the column.")
    elif missing >= L.MISSING_IMPUTE and _skew(c) >= L.MISSING_IMPUTE_SKEW:
        out.add("F-MISSING-IMPUTE", "medium", "column", [name], {"missingRate": missing, "skewness": _stats(c)["skewness"]}, True, f"{name} lacks {percent(missing)} of its values and is skewed ({stat(_stats(c)['skewness'])}).", "The mean of a skewed column is pulled to its tail.", "Fill with the median rather than the mean.")
    if c["modeRate"] >= L.CONSTANT_MODE:
        out.add("F-CONST-COL", "high", "column", [name], {"modeRate": c["modeRate"]}, True, f"One value makes up {percent(c['modeRate'])} of {name}.", "A column that hardly varies tells rows apart hardly at all.", "Consider dropping it.")
    if c["type"] == "categorical" and c["uniqueCount"] >= L.HIGH_CARD_UNIQUE and share >= L.HIGH_CARD_RATIO:
        out.add("F-HIGH-CARD", "medium", "column", [name], {"uniqueCount": c["uniqueCount"], "uniqueRatio": share}, True, f"{name} has {count(c['uniqueCount'])} levels in {count(rows)} rows.", "One column a level would be sparse.", "Encode it by frequency, group rare levels, or drop it.")
    if c["type"] == "id" and share >= L.ID_RATIO:
        out.add("F-ID-COL", "low", "column", [name], {"uniqueRatio": share}, True, f"{name} looks like an identifier.", "An identifier says nothing about new rows.", "Leave it out of a model.")


def _distribution_rules(out: _Found, c: dict) -> None:
    s, name = _stats(c), c["name"]
    skew, kurtosis, rate = s.get("skewness") or 0.0, s.get("kurtosis") or 0.0, s.get("outlierRate") or 0.0
    if abs(skew) >= L.SKEW:
        out.add("F-SKEW", "medium", "column", [name], {"skewness": skew}, True, f"{name} is strongly skewed ({stat(skew)}).", "Its mean is not a typical value.", "Look at the median, or take logarithms.")
    if kurtosis >= L.KURTOSIS:
        out.add("F-KURTOSIS", "low", "column", [name], {"kurtosis": kurtosis}, False, f"{name} has heavy tails (excess kurtosis {stat(kurtosis)}).", "Extreme values are commoner than under a normal distribution.", "Check the largest and smallest values.")
    if rate >= L.OUTLIER_RATE:
        out.add("F-OUTLIER-RATE", "medium", "column", [name], {"outlierRate": rate}, False, f"{percent(rate)} of {name} lies outside the usual range.", "So many outliers may be a group of their own.", "Look at them before you remove them.")
    if rate >= L.OUTLIER_ACTION_RATE and abs(skew) >= L.OUTLIER_ACTION_SKEW:
        out.add("F-OUTLIER-ACTION", "low", "column", [name], {"outlierRate": rate, "skewness": skew}, True, f"{name} has outliers ({percent(rate)}) on a skewed distribution.", "They weigh heavily in sums of squares.", "Clip them or use robust measures.")
    if c["uniqueCount"] <= L.BIN_SENSITIVE_UNIQUE:
        out.add("F-BIN-SENSITIVE", "low", "column", [name], {"uniqueCount": c["uniqueCount"]}, False, f"{name} has only {count(c['uniqueCount'])} distinct values.", "The shape of its histogram depends on the bins.", "Treat it as categories, or choose bins by hand.")


def _target_rules(out: _Found, target: str, columns: Sequence[dict], pairs: Sequence[dict]) -> None:
    for p in pairs:
        r = p["pearson"]
        if r is not None and abs(r) >= L.LEAKAGE_PEARSON and target in (p["left"], p["right"]):
            other = p["right"] if p["left"] == target else p["left"]
            out.add("F-LEAKAGE", "high", "pair", [other, target], {"pearson": r}, True, f"{other} almost equals the target {target} (r = {stat(r)}).", "It may hold what is to be predicted.", "Make sure that it is known at the time of prediction.")
    c = next((c for c in columns if c["name"] == target), None)
    if c:
        classes = c.get("classDistribution") or {}
        total = sum(classes.values())
        if len(classes) >= 2:
            least = min(classes.values())
            if least / total <= L.CLASS_SHARE:
                rare = min(k for k, v in classes.items() if v == least)
                out.add("F-CLASS-IMBALANCE", "high", "column", [target], {"minClass": rare, "minClassRatio": least / total}, True, f"The class {rare} makes up {percent(least / total)} of {target}.", "A model that never predicts it would look accurate.", "Weigh or resample the classes, and measure by class.")
        if c["type"] == "numeric" and _skew(c) >= L.TARGET_SKEW:
            out.add("F-TARGET-SKEW", "medium", "column", [target], {"skewness": _stats(c)["skewness"]}, True, f"The target {target} is skewed ({stat(_stats(c)['skewness'])}).", "Large values decide a squared error.", "Try the logarithm of the target.")
    spread = [s for s in (_stats(c).get("std") or 0.0 for c in columns if c["type"] == "numeric") if s > 0]
    if spread and max(spread) / min(spread) >= L.SCALE_RATIO:
        ratio = max(spread) / min(spread)
        out.add("F-SCALE-DIFF", "medium", "dataset", [], {"stdRatio": ratio}, True, f"Standard deviations differ by a factor of {stat(ratio)}.", "Distances and penalties follow the widest column.", "Scale the columns.")


def build(dataset: dict, columns: Sequence[dict], pairs: Sequence[dict], target: str | None = None, fold: bool = True) -> list[dict]:
    """All findings, the most severe first; of a type, those beyond the first few as one row."""
    out, rows = _Found(), dataset["rowCount"]
    for c in columns:
        _column_rules(out, c, rows)
    if dataset["duplicateRowCount"] >= L.DUPLICATE_ROWS:
        out.add("F-DUP-ROW", "medium", "dataset", [], {"duplicateRowCount": dataset["duplicateRowCount"]}, False, f"{count(dataset['duplicateRowCount'])} rows repeat an earlier one.", "Repeated rows count twice.", "Drop them unless they are separate events.")
    numeric = [c for c in columns if c["type"] == "numeric"]
    for c in numeric:
        _distribution_rules(out, c)
    skewed = [c["name"] for c in numeric if _skew(c) >= L.SKEW]
    if skewed:
        out.add("F-CORR-METHOD", "low", "dataset", skewed, {"skewedColumns": len(skewed)}, False, f"{count(len(skewed))} columns are strongly skewed.", "Pearson's correlation follows their extreme values.", "Compare it with Spearman's.")
    for p in pairs:
        r, v = p["pearson"], p["vif"]
        if r is not None and abs(r) >= L.COLLINEAR_PEARSON or v is not None and v >= L.COLLINEAR_VIF:
            out.add("F-MULTICOLLINEAR", "high", "pair", [p["left"], p["right"]], {"pearson": r, "vif": v}, True, f"{p['left']} and {p['right']} go together (r = {stat(r)}, VIF {stat(v)}).", "Their coefficients cannot be told apart.", "Keep one of them.")
    strong = [p for p in pairs if p["pearson"] is not None and abs(p["pearson"]) >= L.CAUSAL_PEARSON]
    if strong:
        out.add("F-CORR-CAUSAL", "low", "dataset", [], {"pairs": len(strong)}, False, f"{count(len(strong))} pairs are strongly correlated.", "Correlation is no proof of a cause.", "Look for common causes and for time order.")
    if target:
        _target_rules(out, target, columns, pairs)
    ranked = sort(out.rows)
    return collapse(ranked) if fold else ranked


def sort(found: Sequence[dict]) -> list[dict]:
    return sorted(found, key=lambda f: (-RANK[f["severity"]], -len(f["targets"]), f["type"], f["seq"]))


def collapse(found: Sequence[dict], most: int = L.FINDINGS_PER_TYPE) -> list[dict]:
    """Of each type the first few; the others in one row, where the first of them stood."""
    kept: list[dict] = []
    rest: dict[str, tuple[int, list[dict]]] = {}
    seen: dict[str, int] = {}
    for f in found:
        seen[f["type"]] = seen.get(f["type"], 0) + 1
        if seen[f["type"]] <= most:
            kept.append(f)
        else:
            rest.setdefault(f["type"], (len(kept), []))[1].append(f)
    for kind, (at, more) in sorted(rest.items(), key=lambda x: -x[1][0]):
        f = more[0]
        kept.insert(at, {
            "id": f"{kind}#more", "type": kind, "severity": f["severity"], "scope": f["scope"], "targets": [t for m in more for t in m["targets"]], "metrics": {"collapsedCount": len(more)},
            "what": f"The same holds for {count(len(more))} more.", "why": "They met the same condition as those above.", "how": "Open the list to see each.", "mlRelevant": f["mlRelevant"], "collapsed": True, "seq": most + 1,
        })
    return kept
