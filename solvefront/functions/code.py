"""Functions on Python source and exact hashes, which have no SQL form: Arrow-batched UDFs.

Canonical keys depend on ``ast.unparse``: keep driver and executors on one
Python version and store it with the keys.
"""

from __future__ import annotations

import ast
import builtins
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from solvefront.functions.arrow import rows_of

#: Fixed value: where a line's comment starts, of a text that does not parse.
_COMMENT = re.compile(r"(?<!['\"])#.*$")


class _AlphaRename(ast.NodeTransformer):
    """Variables become v0, v1, ... by first visit; docstrings, annotations and return types go."""

    def __init__(self, fixed: set[str]):
        self.fixed, self.seen = fixed, {}

    def name(self, old: str) -> str:
        return old if old in self.fixed or old[:2] == "__" else self.seen.setdefault(old, f"v{len(self.seen)}")

    def visit_Name(self, node):
        node.id = self.name(node.id)
        return node

    def visit_arg(self, node):
        node.arg, node.annotation = self.name(node.arg), None
        return node

    def generic_visit(self, node):
        if isinstance(node, ast.Module | ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            head = node.body[0] if node.body else None
            if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
                node.body = node.body[1:] or [ast.Pass()]
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            node.returns = None
            # Decorators are named before the body, so they take the first numbers.
            node.decorator_list = [self.visit(d) for d in node.decorator_list]
        return super().generic_visit(node)


def protected_names(tree: ast.AST) -> set[str]:
    """Builtins and what imports bind: renaming these would merge different programs."""
    names = set(dir(builtins))
    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            names |= {a.asname or (a.name.split(".")[0] if isinstance(node, ast.Import) else a.name) for a in node.names}
        if isinstance(node, ast.ImportFrom) and node.module:
            names.add(node.module.partition(".")[0])
    return names


#: What parsing or walking a text that is no program of a workable depth raises.
_UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError)


def parsed(code: str) -> ast.Module | None:
    """The syntax tree, or None where there is none: bad syntax, null bytes, nesting beyond the parser's stack."""
    try:
        return ast.parse(code)
    except _UNPARSABLE:
        return None


def unparsed(tree: ast.AST) -> str | None:
    """The tree's source, or None where it is nested too deeply to be walked."""
    try:
        return ast.unparse(ast.fix_missing_locations(tree))
    except (*_UNPARSABLE, AttributeError):
        return None


def renamed(tree: ast.Module) -> ast.Module | None:
    try:
        return _AlphaRename(protected_names(tree)).visit(tree)
    except (*_UNPARSABLE, AttributeError):
        return None


def canonical_form(code: str) -> tuple[str, str, str]:
    """(text, method, key): the renamed program, or where it does not parse its stripped text; key is the SHA-256."""
    tree = parsed(code)
    tree = None if tree is None else renamed(tree)
    text, method = None if tree is None else unparsed(tree), "ast"
    if text is None:
        lines = (_COMMENT.sub("", line).rstrip() for line in code.splitlines())
        text, method = "\n".join(filter(str.strip, lines)), "text"
    return text, method, hashlib.sha256(text.encode()).hexdigest()


def compiles(code: str) -> bool:
    try:
        compile(code, "<candidate>", "exec")
    except (SyntaxError, ValueError, RecursionError, OverflowError, MemoryError):
        return False
    return True


def entry_point(test: str) -> str:
    """Name of the first call of a plain name, breadth first; empty if there is none."""
    tree = parsed(test)
    calls = (n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)) if tree else iter(())
    return next(calls, "")


def public_asserts(tests: str) -> str:
    """The first half of a test module's top-level asserts, rounded up, with everything that is no assert kept."""
    tree = parsed(tests)
    if tree is None:
        return ""
    total = sum(isinstance(n, ast.Assert) for n in tree.body)
    left, body = max(1, -(-total // 2)), []
    for node in tree.body:
        if isinstance(node, ast.Assert):
            left -= 1
            if left < 0:
                continue
        body.append(node)
    text = unparsed(ast.Module(body, [])) if total else None
    return f"{text}\n" if text is not None else ""


def public_table(tests: str, entry: str) -> str:
    """A ``check`` function whose ``inputs`` and ``results`` lists keep their first half; empty where it has no such lists of one length."""
    tree = parsed(tests)
    if tree is None:
        return ""
    at = next((i for i, n in enumerate(tree.body) if isinstance(n, ast.FunctionDef) and n.name == "check"), None)
    if at is None:
        return ""
    lists: dict[str, list[ast.List]] = {"inputs": [], "results": []}
    for n in tree.body[at].body:
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name) and n.targets[0].id in lists and isinstance(n.value, ast.List):
            lists[n.targets[0].id].append(n.value)
    size = len(lists["inputs"][0].elts) if lists["inputs"] and lists["results"] else 0
    if not size or len(lists["results"][0].elts) != size:
        return ""
    for found in lists.values():
        for value in found:
            value.elts = value.elts[: max(1, -(-size // 2))]
    tree.body[at].decorator_list, tree.body[at].returns = [], None
    text = unparsed(ast.Module(tree.body[: at + 1], []))
    return f"{text}\n\ncheck({entry})\n" if text is not None else ""


def blake2_unit(text: str, salt: str) -> float:
    """A number in [0, 1) from the 8-byte BLAKE2b of salt, a zero byte and the text, little-endian."""
    return int.from_bytes(hashlib.blake2b(f"{salt}\0{text}".encode(), digest_size=8).digest(), "little") / 2**64


def content_hash(task: dict) -> str:
    """SHA-256 of the load-bearing fields as JSON with sorted keys and default separators."""
    fields = ("task_id", "family", "prompt", "tests", "public_tests", "entry_point", "setup")
    return hashlib.sha256(json.dumps({f: task[f] for f in fields}, sort_keys=True).encode()).hexdigest()


def short_hash(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=6).hexdigest()


def _canonical(code: str) -> dict[str, str]:
    return dict(zip(("text", "method", "key"), canonical_form(code), strict=True))


def _public_table(tests: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series([public_table(t, e) for t, e in zip(tests, entry, strict=True)])


def _content_hash(task: pd.DataFrame) -> pd.Series:
    return pd.Series([content_hash(r) for r in task.to_dict("records")])


def _column(f, kind: str):
    """A function of columns; the UDF is made when called, for a type needs a session and executors import this module without one."""
    return lambda *columns: F.pandas_udf(f, kind)(*columns)


#: Bytes of texts worked on and yielded at once.
SLICE_BYTES = 1 << 20


def by_slices(f: Callable[[str], Any], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """``f`` of each text, null for null: slice by slice, equal texts of a slice once."""
    made = []
    for part in rows_of(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", SLICE_BYTES):
        told = part.column(0).dictionary_encode()
        made.append(pa.array([f(x) for x in told.dictionary.to_pylist()], kind).take(told.indices))
    return pa.concat_arrays(made) if made else pa.array([], kind)


def _of_text(f: Callable[[str], Any], kind: str):
    """The same of one column of texts, in slices."""
    def made(column: Column | str) -> Column:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(T.DataType.fromDDL(kind))

        @F.arrow_udf(kind)
        def work(texts: pa.Array) -> pa.Array:
            return by_slices(f, texts, arrow)

        return work(column)

    return made


canonical_udf = _of_text(_canonical, "struct<text string, method string, key string>")
compiles_udf = _of_text(compiles, "boolean")
entry_point_udf = _of_text(entry_point, "string")
public_asserts_udf = _of_text(public_asserts, "string")
public_table_udf = _column(_public_table, "string")
short_hash_udf = _of_text(short_hash, "string")
content_hash_udf = _column(_content_hash, "string")


def blake2_unit_column(text: Column, salt: str) -> Column:
    @F.pandas_udf("double")
    def unit(t: pd.Series) -> pd.Series:
        return t.map(lambda x: blake2_unit(x, salt), na_action="ignore")

    return unit(text)


def with_canonical_form(df: DataFrame, code: str = "code") -> DataFrame:
    """Add canon (text, method, key); each distinct program is parsed once and joined back."""
    distinct = df.select(F.col(code).alias("_code")).where("_code is not null").distinct()
    found = distinct.withColumn("canon", canonical_udf("_code"))
    return df.join(found, F.col(code) == F.col("_code"), "left").drop("_code")
