"""Reports: a context of figures from results, rendered as LaTeX or Markdown, with optional figures and tools."""

from __future__ import annotations

import os
import shutil
import subprocess
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from surprisal.alphabet import BY_LANGUAGE
from surprisal.config import get_config
from surprisal.functions.text import redundancy_of
from surprisal.operators import metrics
from surprisal.plans import tables
from surprisal.sources.results import load_card, load_results, save_text

LANGUAGE_NAMES = {"en": "English", "ro": "Romanian"}
CORPUS = {"en": "text8", "ro": "opus"}
#: The works that a report cites, by key: kind and fields.
WORKS = {
    "shannon1951": ("article", {"author": "C. E. Shannon", "title": "Prediction and Entropy of Printed English", "journal": "Bell System Technical Journal", "volume": "30", "number": "1", "pages": "50--64", "year": "1951"}),
    "huffman1952": ("article", {"author": "D. A. Huffman", "title": "A Method for the Construction of Minimum-Redundancy Codes", "journal": "Proceedings of the IRE", "volume": "40", "number": "9", "pages": "1098--1101", "year": "1952"}),
    "cleary1984": ("article", {"author": "J. G. Cleary and I. H. Witten", "title": "Data Compression Using Adaptive Coding and Partial String Matching", "journal": "IEEE Transactions on Communications", "volume": "32", "number": "4", "pages": "396--402", "year": "1984"}),
    "kneser1995": ("inproceedings", {"author": "R. Kneser and H. Ney", "title": "Improved Backing-off for M-gram Language Modeling", "booktitle": "International Conference on Acoustics, Speech, and Signal Processing", "volume": "1", "pages": "181--184", "year": "1995"}),
    "efron1979": ("article", {"author": "B. Efron", "title": "Bootstrap Methods: Another Look at the Jackknife", "journal": "The Annals of Statistics", "volume": "7", "number": "1", "pages": "1--26", "year": "1979"}),
}
#: Style by name: the document class and what the preamble adds.
STYLES = {
    "article": (r"\documentclass{article}", [r"\usepackage{graphicx}"]),
    "acm": (r"\documentclass[sigconf,nonacm]{acmart}", []),
    "arxiv": (r"\documentclass[11pt]{article}", [r"\usepackage[margin=1in]{geometry}", r"\usepackage{graphicx}"]),
}
#: Characters that LaTeX reads as commands (fixed values).
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_latex(text: Any) -> str:
    """Each special character once, in one pass."""
    return "".join(LATEX.get(c, c) for c in str(text))


def report_context(spark: SparkSession, lang: str, corpus: str, snapshot: str, results_dir: str | None = None, corpora_dir: str | None = None) -> dict[str, Any]:
    """Figures of one language's results; a family without results has None."""
    config, alphabet = get_config(), BY_LANGUAGE[lang]
    folder = Path(results_dir or config.results) / "entropy" / lang / corpus / snapshot
    if not folder.is_dir():
        raise FileNotFoundError(f"no results in {folder}")
    raw = load_results(spark, str(folder)).persist()
    if raw.isEmpty():
        raise ValueError(f"no results in {folder}")
    normal = metrics.normalized_results(raw)
    best = {r["model"]: r.asDict() for r in metrics.best_per_family(normal).collect()}
    ngram = min((r for m, r in best.items() if m.startswith("ngram")), key=lambda r: (r["bits_per_char"], -r["order"]), default=None)
    ppm, huffman = best.get("ppm"), best.get("huffman")
    gains = metrics.redundancy_gains(normal).first().asDict()
    boot = raw.where("model_choice = 'ppm' AND bootstrap IS NOT NULL").orderBy("bits_per_char").select("bootstrap").first()
    sens = raw.where("sensitivity IS NOT NULL").select("sensitivity").first()
    card = Path(corpora_dir or config.corpora) / lang / snapshot / "processed" / f"{corpus}_datacard.json"
    red = lambda r: redundancy_of(r["bits_per_char"], alphabet.log2_size) if r else None
    get = lambda r, k: r[k] if r else None
    out = {
        "language_name": LANGUAGE_NAMES[lang], "lang": lang, "corpus_name": corpus, "snapshot": snapshot, "generation_date": datetime.now(UTC).strftime("%Y-%m-%d"),
        "alphabet_size": alphabet.size, "log2_alphabet_size": alphabet.log2_size, "alphabet_name": alphabet.name, "corpus_size": load_card(card).get("char_count") if card.exists() else None,
        "comparison_table_data": [r.asDict() for r in metrics.by_entropy(normal).collect()],
        "ppm_bpc": get(ppm, "bits_per_char"), "ppm_order": get(ppm, "order"), "ppm_redundancy": red(ppm), "huffman_bpc": get(huffman, "bits_per_char"), "huffman_redundancy": red(huffman),
        "ngram_best_bpc": get(ngram, "bits_per_char"), "ngram_best_order": get(ngram, "order"), "ppm_to_huffman_gain": 100 * gains["huffman_to_ppm_gain"],
        "has_bootstrap": boot is not None, "ppm_ci_width": 0.0, "redundancy_ci_width": 0.0,
        "has_sensitivity": sens is not None, "sensitivity_table_data": [], "ablations_list": "", "diacritics_delta": 0.0, "space_delta": 0.0,
    }
    if boot:
        b = boot["bootstrap"]
        out["ppm_ci_width"] = (b["ci_upper_bpc"] - b["ci_lower_bpc"]) / 2
        out["redundancy_ci_width"] = abs(redundancy_of(b["ci_lower_bpc"], alphabet.log2_size) - redundancy_of(b["ci_upper_bpc"], alphabet.log2_size)) / 2
    if sens:
        base = sens["sensitivity"]["baseline"]["bits_per_char"]
        for v in sens["sensitivity"]["variants"]:
            r = redundancy_of(v["bits_per_char"], v["log2_alphabet_size"])
            # delta_r compares within the variant's alphabet; delta_r_own with the baseline's redundancy in its own.
            row = {"variant": v["name"], "alphabet_size": v["alphabet_size"], "log2_alphabet_size": v["log2_alphabet_size"], "bits_per_char": v["bits_per_char"], "redundancy": r, "delta_h": v["bits_per_char"] - base, "delta_r": r - redundancy_of(base, v["log2_alphabet_size"]), "delta_r_own": r - sens["sensitivity"]["baseline"]["redundancy"]}
            out["sensitivity_table_data"].append(row)
            if key := {"no_diacritics": "diacritics_delta", "no_space": "space_delta"}.get(v["name"]):
                out[key] = row["delta_h"]
        out["ablations_list"] = ", ".join(r["variant"] for r in out["sensitivity_table_data"])
    raw.unpersist()
    return out


def _said(value: float | None, form: str = "{:.4f}") -> str:
    return "not measured" if value is None else form.format(value)


def markdown_report(c: dict[str, Any]) -> str:
    parts = [
        f"# How predictable is {c['language_name']}?",
        f"Corpus {c['corpus_name']}, snapshot {c['snapshot']}, {c['alphabet_name']} (M = {c['alphabet_size']}, log₂M = {c['log2_alphabet_size']:.4f}). {c['generation_date']}.",
        "## Results",
        f"PPM at depth {c['ppm_order']} needs {_said(c['ppm_bpc'])} bits a character, a redundancy of {_said(c['ppm_redundancy'], '{:.2%}')}. Huffman needs {_said(c['huffman_bpc'])}, the best n-gram (order {c['ngram_best_order']}) {_said(c['ngram_best_bpc'])}. Context gains {c['ppm_to_huffman_gain']:.2f} points.",
        tables.comparison(c["comparison_table_data"], "markdown"),
    ]
    if c["has_bootstrap"]:
        parts.append(f"Bootstrap half-widths: ±{c['ppm_ci_width']:.4f} bits, ±{c['redundancy_ci_width']:.4f} redundancy.")
    if c["has_sensitivity"]:
        parts += ["## Ablations", tables.markdown(["Variant", "M", "H (bpc)", "ΔH", "ΔR"], [[r["variant"], str(r["alphabet_size"]), f"{r['bits_per_char']:.4f}", f"{r['delta_h']:+.4f}", f"{r['delta_r']:+.4f}"] for r in c["sensitivity_table_data"]])]
    return "\n\n".join(parts) + "\n"


def bibliography() -> str:
    """WORKS as a BibTeX file."""
    entries = ("\n".join([f"@{kind}{{{key},", *(f"  {k} = {{{v}}}," for k, v in fields.items()), "}"]) for key, (kind, fields) in WORKS.items())
    return "\n\n".join(entries) + "\n"


def _rows(data: list[list[str]]) -> list[str]:
    return [" & ".join(map(escape_latex, row)) + r" \\" for row in data]


def latex_report(c: dict[str, Any], style: str = "article", pictures: list[str] | None = None) -> str:
    """An unknown style is an article. pictures: paths of figures, as the document finds them."""
    e = escape_latex
    head, packages = STYLES.get(style, STYLES["article"])
    compared = [[tables.display_name(r["model"], r["order"]), f"{r['bits_per_char']:.4f}", f"{r['redundancy']:.2%}", f"{r['compression_ratio']:.3f}"] for r in c["comparison_table_data"]]
    title = rf"\title{{How predictable is {e(c['language_name'])}?}}"
    corpus = rf"Corpus {e(c['corpus_name'])}, snapshot {e(c['snapshot'])}, alphabet {e(c['alphabet_name'])} with $M = {c['alphabet_size']}$ and $\log_2 M = {c['log2_alphabet_size']:.4f}$. What is not needed of those bits is redundancy \cite{{shannon1951}}."
    found = [
        rf"Prediction by partial matching \cite{{cleary1984}} needs {e(_said(c['ppm_bpc']))} bits a character, a redundancy of {e(_said(c['ppm_redundancy'], '{:.2%}'))}.",
        rf"Huffman's code \cite{{huffman1952}} needs {e(_said(c['huffman_bpc']))}, the best n-gram \cite{{kneser1995}} {e(_said(c['ngram_best_bpc']))}.",
    ]
    if c["has_bootstrap"]:
        found.append(rf"Half-widths of the bootstrap \cite{{efron1979}}: $\pm {c['ppm_ci_width']:.4f}$ bits, $\pm {c['redundancy_ci_width']:.4f}$ redundancy.")
    body = [r"\section{Corpus}", corpus, r"\section{Results}", *found, "", r"\begin{tabular}{lrrr}", r"Model & $H$ & Redundancy & Ratio \\ \hline", *_rows(compared), r"\end{tabular}"]
    if c["has_sensitivity"]:
        ablated = [[r["variant"], str(r["alphabet_size"]), f"{r['bits_per_char']:.4f}", f"{r['delta_h']:+.4f}", f"{r['delta_r']:+.4f}"] for r in c["sensitivity_table_data"]]
        body += [r"\section{Ablations}", r"\begin{tabular}{lrrrr}", r"Variant & $M$ & $H$ & $\Delta H$ & $\Delta R$ \\ \hline", *_rows(ablated), r"\end{tabular}"]
    body += [rf"\begin{{figure}}[h]\centering\includegraphics[width=0.8\linewidth]{{{p}}}\end{{figure}}" for p in pictures or []]
    preamble = [head, r"\usepackage[utf8]{inputenc}", *packages, title, rf"\date{{{e(c['generation_date'])}}}"]
    return "\n".join([*preamble, r"\begin{document}", r"\maketitle", *body, r"\bibliographystyle{plain}", r"\bibliography{references}", r"\end{document}", ""])


def figures(c: dict[str, Any], folder: str | Path) -> list[Path]:
    """Entropy by order and redundancy by model as PDF and PNG, where matplotlib is there."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return []
    folder, made = Path(folder), []
    folder.mkdir(parents=True, exist_ok=True)
    data = c["comparison_table_data"]
    lines, bars = Figure(), Figure()
    ax = lines.subplots()
    for model in sorted({r["model"] for r in data}):
        points = sorted((r["order"], r["bits_per_char"]) for r in data if r["model"] == model)
        ax.plot(*zip(*points, strict=True), marker="o", label=model)
    ax.axhline(c["log2_alphabet_size"], linestyle="--", label="log2 M")
    ax.set(xlabel="order", ylabel="bits per character")
    ax.legend()
    ax = bars.subplots()
    ax.bar([tables.display_name(r["model"], r["order"]) for r in data], [r["redundancy"] for r in data])
    ax.tick_params(axis="x", rotation=30)
    ax.set(ylabel="redundancy")
    for name, fig in (("entropy_vs_order", lines), ("redundancy", bars)):
        for kind in ("pdf", "png"):
            fig.savefig(made_at := folder / f"{name}_{c['lang']}.{kind}", bbox_inches="tight")
            made.append(made_at)
    return made


def _ran(command: list[str], folder: Path) -> bool:
    return subprocess.run(command, cwd=folder, capture_output=True, check=False).returncode == 0


def compile_pdf(tex: Path) -> Path | None:
    """The PDF with its references, or None where no LaTeX is installed or it fails."""
    if shutil.which("latexmk"):
        done = _ran(["latexmk", "-pdf", "-interaction=nonstopmode", tex.name], tex.parent)
    elif shutil.which("pdflatex"):
        once = lambda: _ran(["pdflatex", "-interaction=nonstopmode", tex.name], tex.parent)
        done = once()
        if done and shutil.which("bibtex") and _ran(["bibtex", tex.stem], tex.parent):
            done = once() and once()  # citations first, then what they moved
    else:
        done = False
    return tex.with_suffix(".pdf") if done else None


def build_site(page: Path, folder: Path, tool: str = "quarto") -> Path | None:
    """HTML of a Markdown report by quarto or jupyter-book, or None where the tool is missing or fails."""
    commands = {
        "quarto": (["quarto", "render", page.name, "--to", "html", "--output-dir", str(folder.resolve())], folder / f"{page.stem}.html"),
        "jupyter-book": (["jupyter-book", "build", page.name, "--path-output", str(folder.resolve())], folder / "_build" / "_page" / page.stem / "html" / f"{page.stem}.html"),
    }
    if tool not in commands:
        raise ValueError(f"no tool is named {tool}; there are {', '.join(commands)}")
    command, made = commands[tool]
    if not shutil.which(tool):
        return None
    folder.mkdir(parents=True, exist_ok=True)
    return made if _ran(command, page.parent) and made.exists() else None


def generate_report(spark: SparkSession, lang: str = "both", corpus: str | None = None, snapshot: str | None = None, form: str = "both", out: str = "paper", style: str = "article", results_dir: str | None = None, figures_dir: str | None = None, site_tool: str = "quarto") -> dict[str, Path]:
    """Files by kind and language. Of both languages, one without results is passed over, as long as the other has some."""
    made: dict[str, Path] = {}
    langs = ("en", "ro") if lang == "both" else (lang,)
    missing: list[Exception] = []
    for one in langs:
        try:
            c = report_context(spark, one, corpus or CORPUS[one], snapshot or get_config().snapshot, results_dir)
        except (FileNotFoundError, ValueError) as e:
            missing.append(e)
            if len(missing) == len(langs):
                raise
            continue
        drawn = figures(c, figures_dir or Path(out) / "figs")
        made |= {f"figure{i}_{one}": f for i, f in enumerate(drawn)}
        if form in ("pdf", "both"):
            pictures = [os.path.relpath(f, out) for f in drawn if f.suffix == ".pdf"]
            made[f"tex_{one}"] = save_text(latex_report(c, style, pictures), Path(out) / f"report_{one}.tex")
            made[f"bib_{one}"] = save_text(bibliography(), Path(out) / "references.bib")
            if pdf := compile_pdf(made[f"tex_{one}"]):
                made[f"pdf_{one}"] = pdf
        if form in ("html", "both"):
            made[f"markdown_{one}"] = save_text(markdown_report(c), Path(out) / f"report_{one}.md")
            if page := build_site(made[f"markdown_{one}"], Path(out) / "site", site_tool):
                made[f"html_{one}"] = page
    return made
