"""Text reports over result documents."""

from __future__ import annotations

from plumbline.functions.formats import byte_size, count, percent, stat
from plumbline.operators import limits as L


def overview(r: dict) -> list[str]:
    d = r["dataset"]
    kinds: dict[str, int] = {}
    for c in r["columns"]:
        kinds[c["type"]] = kinds.get(c["type"], 0) + 1
    return [
        f"{count(d['rowCount'])} rows, {count(d['columnCount'])} columns, {count(d['duplicateRowCount'])} repeated rows, {byte_size(d['memoryBytes'])}",
        "Types: " + ", ".join(f"{n} {k}" for k, n in sorted(kinds.items())),
    ]


def quality(r: dict) -> list[str]:
    h = r["health"]
    return [f"Quality {h['total']} of 100 ({h['grade']})", *(f"  {i['key']}: {i['verdict']}, -{i['penalty']}" + (f" ({i['evidence']})" if i["evidence"] else "") for i in h["items"])]


def findings(r: dict, most: int = L.SHOWN_FINDINGS) -> list[str]:
    shown = [f"[{f['severity']}] {f['what']} {f['why']} {f['how']}" for f in r["findings"][:most]]
    return shown + ([f"and {len(r['findings']) - most} more"] if len(r["findings"]) > most else [])


def columns(r: dict) -> list[str]:
    out = []
    for c in r["columns"]:
        s = c["stats"]
        line = f"{c['name']} ({c['type']}): missing {percent(c['missingRate'])}, invalid {percent(c['invalidRate'])}, {count(c['uniqueCount'])} distinct"
        if "mean" in s:
            line += f", mean {stat(s['mean'])}, median {stat(s['median'])}, std {stat(s['std'])}, skewness {stat(s['skewness'])}, outliers {percent(s['outlierRate'])}"
        out.append(line)
    return out


def relations(r: dict) -> list[str]:
    ranked = sorted((p for p in r["correlations"] if p["pearson"] is not None), key=lambda p: -abs(p["pearson"]))
    return [f"{p['left']} ~ {p['right']}: r {stat(p['pearson'])}, rho {stat(p['spearman']) if p['spearman'] is not None else '—'}, VIF {stat(p['vif']) if p['vif'] is not None else '—'}" for p in ranked]


def render(r: dict) -> str:
    parts = (("Overview", overview), ("Quality", quality), ("Findings", findings), ("Columns", columns), ("Relations", relations))
    return "\n\n".join("\n".join([title, *part(r)]) for title, part in parts)


def changes(diff: dict) -> str:
    """A comparison before and after a recipe."""
    lines = [f"{k}: {v[0]} -> {v[1]}" for k, v in diff.items() if k != "columns"]
    for c in diff["columns"]:
        moved = [f"{k} {stat(c[k][0]) if c[k][0] is not None else '—'} -> {stat(c[k][1]) if c[k][1] is not None else '—'}" for k in ("missingRate", "skewness", "outlierRate") if c[k][0] != c[k][1]]
        if moved:
            lines.append(f"{c['name']}: " + ", ".join(moved))
    return "\n".join(lines)
