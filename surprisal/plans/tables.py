"""Comparison and sensitivity tables as text."""

from __future__ import annotations

import csv
import io
import json
from typing import Any

#: Headings and number formats (fixed values).
COMPARISON = [("Model", None), ("Order", None), ("H (bpc)", "{:.4f}"), ("log₂M", "{:.4f}"), ("Redundancy", "{:.2%}"), ("Comp. Ratio", "{:.3f}")]
COMPARISON_KEYS = ["model", "order", "bits_per_char", "log2_alphabet_size", "redundancy", "compression_ratio"]
SENSITIVITY = ["Variant", "M", "log2M", "H (bpc)", "Redundancy (%)", "ΔH (bpc)", "ΔR (pp)", "Rel. change (%)"]
SENSITIVITY_KEYS = ["variant", "M", "log2M", "H_bpc", "redundancy", "delta_H", "delta_R", "relative_change"]


def display_name(model: str, order: int) -> str:
    if model.startswith("ngram"):
        return f"N-gram (order={order})"
    return {"unigram": "Unigram", "huffman": "Huffman", "ppm": f"PPM (depth={order})"}.get(model, model)


def grid(head: list[str], rows: list[list[str]]) -> str:
    """Columns padded to their widest cell, under a ruled heading."""
    columns = list(zip(head, *rows, strict=True))
    width = [max(map(len, c)) for c in columns]
    lines = [" | ".join(cell.ljust(w) for cell, w in zip(row, width, strict=True)) for row in [head, *rows]]
    return "\n".join([lines[0], "-+-".join("-" * w for w in width), *lines[1:]])


def markdown(head: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(row) + " |" for row in [head, ["---"] * len(head), *rows])


def as_csv(head: list[str], rows: list[list[str]]) -> str:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([head, *rows])
    return out.getvalue().rstrip("\n")


def comparison(results: list[dict[str, Any]], style: str = "table") -> str:
    """Results (normalised, sorted) as table, markdown, csv or json."""
    if style == "json":
        return json.dumps(results, indent=2, ensure_ascii=False)
    if style == "csv":
        return as_csv(COMPARISON_KEYS, [[str(r["model"]), str(r["order"]), *(f"{r[k]:.6f}" for k in COMPARISON_KEYS[2:])] for r in results])
    rows = [[display_name(r["model"], r["order"]), str(r["order"]), *(f.format(r[k]) for k, (_, f) in zip(COMPARISON_KEYS[2:], COMPARISON[2:], strict=True))] for r in results]
    head = [h for h, _ in COMPARISON]
    if style not in ("table", "markdown"):
        raise ValueError(f"no style is named {style}")
    return grid(head, rows) if style == "table" else markdown(head, rows)


def comparison_json(results: list[dict[str, Any]], gains: dict[str, float], lang: str, corpus: str, snapshot: str) -> str:
    """The comparison of one corpus with what each family gains."""
    return json.dumps({"lang": lang, "corpus": corpus, "snapshot": snapshot, "results": results, "gains": gains}, indent=2, ensure_ascii=False)


def sensitivity(results: dict[str, Any], style: str = "table") -> str | dict[str, Any]:
    if style == "json":
        return {"baseline": results.get("baseline", {}), "variants": results.get("variants", [])}
    base = results.get("baseline", {}).get("bits_per_char", 0.0)
    rows = []
    for v in results.get("variants", []):
        change = 100 * (v["bits_per_char"] - base) / base if base > 0 else 0.0
        rows.append([v["name"], str(v["alphabet_size"]), f"{v['log2_alphabet_size']:.3f}", f"{v['bits_per_char']:.4f}", f"{100 * v['redundancy']:.2f}", f"{v['delta_bpc']:+.4f}", f"{100 * v['delta_redundancy']:+.2f}", f"{change:+.2f}"])
    if style == "csv":
        return as_csv(SENSITIVITY_KEYS, rows)
    return markdown(SENSITIVITY, rows) if style == "markdown" else grid(SENSITIVITY, rows)
