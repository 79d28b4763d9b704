"""Text functions as Column expressions, and the few that need Python."""

from __future__ import annotations

import difflib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_ASIDE = re.compile(_QUOTED + r"|`(?:[^`\\]|\\.)*`|/\*.*?(?:\*/|\Z)|//[^\n]*", re.S)
_PY_ASIDE = re.compile(r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|' + _QUOTED + r"|\#[^\n]*", re.S)


def name_tokens(text: Column) -> Column:
    """Lower-case words of two letters or more, camel case and separators split; null gives null."""
    spaced = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(F.translate(spaced, "_-/\\.", "     "), F.lit("([a-zA-Z]{2,})"), F.lit(1)), F.lower)


def lines(text: Column) -> Column:
    """Lines of a text, whatever their ends."""
    return F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")


def identifier(text: Column) -> Column:
    """A text as a name for a node: other characters than letters, digits and _ become _, a leading digit gets an n before it; 50 characters at most."""
    plain = F.regexp_replace(text, r"[^A-Za-z0-9_]", "_")
    return F.left(F.when(plain.rlike("^[0-9]"), F.concat(F.lit("n"), plain)).otherwise(plain), F.lit(50))


def subsequence_pattern(query: str) -> str:
    """A pattern that finds the query's characters in order."""
    special = set("\\^$.|?*+()[]{}")
    return ".*".join("\\" + c if c in special else c for c in query)


def glob_pattern(glob: Column) -> Column:
    """A glob as an anchored pattern: * is any text, ? one character, the rest stands for itself."""
    plain = F.regexp_replace(F.translate(glob, "\\", "/"), r"([.+^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\?", "."), r"\*", ".*"), F.lit("$"))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("long")


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def _ends(text: str, python: bool, starts: list[int]) -> list[int]:
    """The last line of the body that each of ``starts`` (1-based lines) declares: by indentation in Python, else by brackets."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    code = (_PY_ASIDE if python else _ASIDE).sub(lambda m: "\n" * m[0].count("\n") or "x", text).split("\n")
    n = len(code)
    out = []
    if python:
        indent = np.array([len(x) - len(x.lstrip()) if x.strip() and x.lstrip()[0] not in ")]}" else 1 << 30 for x in code])
        filled = np.array([bool(x.strip()) for x in text.split("\n")])
        for s in starts:
            after = np.flatnonzero(indent[s:] <= indent[s - 1])
            inside = np.flatnonzero(filled[s - 1 : s + int(after[0]) if len(after) else n])
            out.append(s + int(inside[-1]) if len(inside) else s)
        return out
    opened = np.array([x.count("{") for x in code])
    depth = np.cumsum([sum(map(x.count, "([{")) - sum(map(x.count, ")]}")) for x in code])
    ends = np.array([x.rstrip().endswith(";") for x in code])
    for s in starts:
        base = int(depth[s - 2]) if s > 1 else 0
        closed = np.flatnonzero((depth[s - 1 :] <= base) & ((np.cumsum(opened[s - 1 :]) > 0) | ends[s - 1 :]))
        out.append(s + int(closed[0]) if len(closed) else n)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def body_ends(text: pd.Series, path: pd.Series, starts: pd.Series) -> pd.Series:
    """For each text the last lines of the bodies declared on its lines ``starts``, in their order; lines outside the text give null."""
    rows = []
    for t, p, s in zip(text, path, starts, strict=True):
        n = len(re.findall("\r\n?|\n", t)) + 1
        known = [int(x) for x in s if 1 <= x <= n]
        found = dict(zip(known, _ends(t, p.lower().endswith(".py"), known), strict=True))
        rows.append([found.get(int(x)) for x in s])
    return pd.Series(rows)
