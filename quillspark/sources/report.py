"""Small result tables as text: reports, LaTeX, HTML diffs. Rows come to the driver, so pass bounded tables."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

from ..functions.clean import word_diff

LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def escape_latex(text: str) -> str:
    """Each special sign escaped once."""
    return "".join(LATEX.get(c, c) for c in text)


def _cell(x) -> str:
    return "" if x is None else f"{x:.3f}" if isinstance(x, float) else escape_latex(str(x))


def latex_table(df: DataFrame, caption: str, label: str, rows: int = 200, long: bool = False) -> str:
    head = " & ".join(escape_latex(c) for c in df.columns) + r" \\"
    body = [" & ".join(map(_cell, r)) + r" \\" for r in df.limit(rows).collect()]
    spec = "l" * len(df.columns)
    if long:
        lines = [rf"\begin{{longtable}}{{{spec}}}", rf"\caption{{{escape_latex(caption)}}}\label{{{label}}}\\", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{longtable}"]
    else:
        lines = [r"\begin{table}", rf"\caption{{{escape_latex(caption)}}}", rf"\label{{{label}}}", rf"\begin{{tabular}}{{{spec}}}", r"\toprule", head, r"\midrule", *body, r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    return "\n".join(lines)


def top_texts(df: DataFrame, text: str, value: str, title: str, rows: int = 20) -> str:
    lines = [title, "=" * len(title)]
    for n, r in enumerate(df.select(text, value).limit(rows).collect(), 1):
        lines += [f"{n}. [{r[1]:.4f}]", f"   {r[0]}"]
    return "\n".join(lines)


def html_diff(before: str, after: str) -> str:
    """Removed words struck, added words marked."""
    tags = {" ": "{}", "-": "<del>{}</del>", "+": "<ins>{}</ins>"}
    return " ".join(tags[m].format(html.escape(w)) for m, w in word_diff(before, after))
