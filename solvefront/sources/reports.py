"""Finished tables as text and LaTeX: for reports of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_ROWS = 10_000
# Characters that LaTeX reads as commands.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def _cells(df: DataFrame, digits: int) -> list[list[str]]:
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a report of more than {MAX_ROWS} rows: aggregate first")
    show = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v)
    return [list(df.columns), *[[show(v) for v in r] for r in rows]]


def text_table(df: DataFrame, digits: int = 4) -> str:
    """Columns padded to their widest cell, a rule below the header; nulls are blank."""
    cells = _cells(df, digits)
    widths = [max(map(len, c)) for c in zip(*cells, strict=True)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]]) + "\n"


def latex_table(df: DataFrame, digits: int = 4) -> str:
    """A tabular with numbers to the right and everything escaped."""
    numbers = ("byte", "short", "int", "long", "float", "double", "decimal", "bigint", "smallint", "tinyint")
    align = "".join("r" if kind.startswith(numbers) else "l" for _, kind in df.dtypes)
    head, *body = [" & ".join("".join(LATEX.get(ch, ch) for ch in c) for c in row) + r" \\" for row in _cells(df, digits)]
    return "\n".join([rf"\begin{{tabular}}{{{align}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"]) + "\n"


def record_json(df: DataFrame, name: str = "record") -> DataFrame:
    """Each row as one JSON object, nulls kept and map keys as text."""
    from pyspark.sql import functions as F

    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(name))
