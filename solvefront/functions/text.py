"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the formats read.
FENCE = r"(?is)```(?:python|py|python3)?\s*\n(.*?)(?:\n```|\z)"
JSON_FENCE = r"(?s)```json\s*(\{.*?\})\s*```"
BARE_TOOL_CALL = r'(?s)(\{\s*"name"\s*:\s*"(?:editor|bash)".*?\})'
COMMENT = r"(?<!['\"])#.*$"


def extract_code(text: Column) -> Column:
    """Fenced blocks, each without its outer line feeds, joined by a blank line; without a fence the trimmed text."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    joined = F.array_join(F.transform(blocks, lambda b: F.trim(b, F.lit("\n"))), "\n\n")
    return _strip(F.when(F.size(blocks) > 0, joined).otherwise(text))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def canonical_text(code: Column) -> Column:
    """Lines without comments, trailing space and blank lines."""
    lines = F.transform(F.split(code, r"\r\n|\r|\n"), lambda x: F.regexp_replace(F.regexp_replace(x, COMMENT, ""), r"\s+$", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def unescape(text: Column) -> Column:
    """Literal escapes to characters, longest first."""
    out = F.replace(F.replace(text, F.lit("\\\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n"))
    return F.replace(F.replace(out, F.lit('\\"'), F.lit('"')), F.lit("\\'"), F.lit("'"))


def tool_call_candidates(text: Column) -> Column:
    """Fenced JSON objects, then bare tool objects, in order."""
    return F.concat(F.regexp_extract_all(text, F.lit(JSON_FENCE), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE_TOOL_CALL), F.lit(1)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(4))).cast("long")


def tail(text: Column, n: int = 800) -> Column:
    return F.right(text, F.lit(n))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_")


def first_half_lines(tests: Column) -> Column:
    """The first half of the lines that are not blank, rounded up, at least one."""
    lines = F.filter(F.split(tests, "\n"), lambda x: F.trim(x) != "")
    return F.concat(F.array_join(F.slice(lines, F.lit(1), F.greatest(F.lit(1), F.floor((F.size(lines) + 1) / F.lit(2)).cast("int"))), "\n"), F.lit("\n"))


def assemble_program(setup: Column, code: Column, tests: Column, marker: str) -> Column:
    """Setup, candidate, tests and the line that prints the success marker."""
    return F.concat_ws("\n\n", F.when(F.trim(setup) != "", setup), code, tests, F.lit(f"print({marker!r})"))


def verdict(code: Column, timed_out: Column, stdout: Column, exit_code: Column, marker: str) -> Column:
    """Reason of a verification from a replayed execution log."""
    found = F.contains(stdout, F.lit(marker))
    return (
        F.when(_strip(F.coalesce(code, F.lit(""))) == "", "empty_candidate").when(timed_out, "timeout")
        .when(found & (exit_code == 0), "ok").when(found, "marker_but_nonzero_exit").when(exit_code != 0, "test_failed").otherwise("no_success_marker")
    )
