"""Generated, minified or vendored source files (problem 1).

Method: winnowed fingerprints of normalized token streams. A file is a vendored copy if its fingerprints recur in several
repositories. The same stream with names and literals made equal (its shape) tells the rest: a file that a tool wrote
repeats a few of its own shingles over and over, a minified one has hardly two characters to a token, a data file is
runs of literals. What a file says of itself in comments only decides between these limits and half of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side, spread

#: Words of a shingle, fingerprints per winnowing window, share of a file's fingerprints that must recur, in how many repositories.
WORDS, WINDOW, SIMILARITY, REPOSITORIES = 5, 4, 0.8, 3
#: Fewer fingerprints than this (a few lines of imports) recur by chance and are no evidence of a copy.
LEAST_PRINTS = 3
#: Tokens of a shingle of the shape; share of its windows that the SHAPE most frequent repeated shingles must hold, share of distinct ones at most.
#: Fewer distinct ones than FEW are enough by themselves. Below BRIEF tokens windows are too few to tell; the shapes of lines do:
#: of LINES or more the LINE_SHAPES most frequent ones must be ALIKE of all.
SHAPE, REPEATED, DISTINCT, FEW = 12, 0.53, 0.62, 0.35
BRIEF, LINES, LINE_SHAPES, ALIKE = 100, 8, 3, 0.95
#: Literals that make a run; share of a file's tokens in runs. Characters to a token and letters to a name of minified code, its least tokens.
RUN, IN_RUNS, TOKEN_CHARS, NAME_CHARS, LEAST_TOKENS = 8, 0.85, 2.2, 3.0, 60
#: Between these and the limits above (for copies: two repositories) the file's own words decide; so they do below SHORT_SHAPE tokens.
REPEATED_STATED, IN_RUNS_STATED, SHORT_SHAPE = 0.27, 0.6, 80
BROADCAST_ROWS = 2_000_000

# ---- fixed values: phrases by which files tell their origin ----
_MADE = re.compile(
    r"code generated by|@generated\b|<auto-?generated>|(?:automatically|auto-?) ?generated (?:from|by|with|using)\b|automatically created (?:from|by)\b"
    r"|\bautogenerated by|\bgenerated (?:with|by|from|using) \S+ (?:on the basis|from|out of|using)\b|\bmachine[- ](?:written|generated|made) by|written by \S+ from \S+"
    r"|\bdo not (?:edit|change|modify)\b|\bedits? (?:will not survive|are overwritten|will be (?:lost|overwritten))|changes will be (?:lost|overwritten)"
    r"|\bregenerate with\b|\boutput of \S+, input\b|\berzeugt von \S+|\bgenerado por \S+|g[eé]n[eé]r[eé] par \S+|source of truth is \S+",
    re.I,
)
_DENIED = re.compile(r"\bnot (?:itself )?(?:auto-?)?generated\b|\bthe generated\b|\bgenerated (?:stubs?|files?|code) (?:is|are|live)|\bthat the build generates", re.I)
_COPIED = re.compile(
    r"\bupstream: ?\S+|\bvendored (?:from|copy)\b|\b(?:un)?modified copy of\b|@license \S+ v?\d|^\W*\S+ v\d+\.\d+(?:\.\d+)?\b|\bcopied (?:verbatim )?from \S+ v?\d|\btaken from \S+ v?\d|\bimported from \S+ v?\d|\bfork of \S+",
    re.I,
)
_STRING = r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
_SLASH = re.compile(rf"(?P<s>{_STRING})|(?P<c>/\*.*?(?:\*/|\Z)|//[^\n]*)", re.S)
_HASH = re.compile(rf"(?P<s>{_STRING})|(?P<c>\#[^\n]*)", re.S)
_HASH_EXT = frozenset((".py", ".rb", ".sh", ".pl", ".r", ".yml", ".yaml", ".toml"))
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_NAMES, _NUMBERS, _BRINGS = re.compile(r"[^\W\d]\w*"), re.compile(r"\d[\w.]*"), re.compile(r"\s*(?:import|from|use|package|using|require|#include|export \* from)\b")
_QUOTED = re.compile(r'"[^"\n]*"?|`[^`\n]*`?')
_ROW = re.compile(r'\s*(?:(?:[-+]?(?:0[xXbB][0-9a-fA-F_]+|\d[\d._eE+-]*)|"[^"\n]*"|\'[^\'\n]*\'|\{[^{}\n]*\}|\([^()\n]*\)|\[[^\[\]\n]*\]|null|nil|None|true|false|True|False)\s*[,+;]?\s*)+[,;]?\s*')
# ---- fixed values: words that keep their place in a shape, and those that are literals ----
_KEYWORDS = frozenset(
    "if for while switch return else do try new throw this self with await yield def func fn fun function class struct enum interface type const let var static "
    "public private import from package use export in of is not and or int string void".split()
)
_LITERALS = frozenset("null nil None true false True False".split())


def parted(text: str, ext: str) -> tuple[str, str, list[tuple[int, str]]]:
    """A source text with plain line ends, its code with literals blanked, and its comments with the line where each starts."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")
    code, comments, last, line, seen = [], [], 0, 0, 0
    for m in (_HASH if ext in _HASH_EXT else _SLASH).finditer(text):
        code.append(text[last : m.start()])
        last = m.end()
        if m["c"] is None:
            code.append('""')
        else:
            line += text.count("\n", seen, m.start())
            seen = m.start()
            comments.append((line, m["c"]))
            code.append("\n" * m["c"].count("\n"))
    code.append(text[last:])
    return text, "".join(code), comments


class Tokens(dict):
    """Numbers for tokens, given as they come, with what the operator needs of each token in arrays."""

    def __init__(self) -> None:
        super().__init__()
        self._rows: list[tuple[int, int, int, bool, bool]] = []

    def __missing__(self, raw: str) -> int:
        number, name = raw[0].isdigit() or raw in _LITERALS, raw[0].isalpha() or raw[0] == "_"
        shape = "0" if number else raw if raw in _KEYWORDS or not name else "n"
        word = xxhash.xxh64_intdigest("0" if raw[0].isdigit() else raw, 1) if name or number else 0
        self._rows.append((word, xxhash.xxh64_intdigest(shape, 2), len(raw), name and not number, number or raw == '"'))
        self[raw] = len(self._rows) - 1
        return len(self._rows) - 1

    def of(self, codes: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
        """For each code text, of each of its tokens: the hash of the word (0 for signs) and of the shape, its length, whether it is a name, a literal."""
        each = [np.fromiter(map(self.__getitem__, _TOKEN.findall(c)), dtype=np.int64) for c in codes]
        columns = zip(*self._rows, strict=True) if self._rows else ((),) * 5
        arrays = [np.array(c, dtype=kind) for c, kind in zip(columns, (np.uint64, np.uint64, np.int64, bool, bool), strict=True)]
        for at in each:
            yield tuple(x[at] for x in arrays)


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - width + 1), dtype=np.uint64)
    for k in range(width if len(h) else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(h)]
    return h ^ (h >> np.uint64(32))


def fingerprints(words: np.ndarray) -> np.ndarray:
    """Winnowed hashes of five-word shingles of a stream of word hashes, distinct and sorted."""
    h = _shingles(words, WORDS)
    if len(h) > WINDOW:
        h = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)
    return np.unique(h).view(np.int64)


def self_similarity(shape: np.ndarray, name: np.ndarray, literal: np.ndarray) -> tuple[float, float, float]:
    """Of a token stream: its share in runs of literals; then, runs made one token, the share of windows that the most frequent
    repeated shingles hold, and the share of distinct shingles."""
    if not len(shape):
        return 0.0, 0.0, 1.0
    # stretches without a name; those with enough literals are runs
    block = np.cumsum(name)
    run = ~name & (np.bincount(block, weights=literal & ~name)[block] >= RUN)
    first = run & np.concatenate([[True], ~run[:-1]])
    h = _shingles(np.where(run, np.uint64(7), shape)[~run | first], SHAPE)
    if not len(h):
        return float(run.mean()), 0.0, 1.0
    counts = np.sort(np.unique(h, return_counts=True)[1])[::-1]
    most = counts[:SHAPE]
    return float(run.mean()), float(most[most > 1].sum() / len(h)), len(counts) / len(h)


def lines_alike(code: str) -> bool:
    """Whether nearly all lines of a code text, imports aside, have one of a few shapes."""
    told = "\n".join(x for x in code.split("\n") if not _BRINGS.match(x))
    shapes = Counter(x for x in map(str.strip, _NUMBERS.sub("0", _NAMES.sub("n", told)).split("\n")) if len(x) > 2)
    common = [n for _, n in shapes.most_common(LINE_SHAPES)]
    return shapes.total() >= LINES and common[0] > LINE_SHAPES and sum(common) >= ALIKE * shapes.total()


def says_made(comments: list[tuple[int, str]]) -> bool:
    return any(_MADE.search(c) and not _DENIED.search(c) for c in (_QUOTED.sub("", c) for _, c in comments))


def own_sign(text: str, code: str, comments: list[tuple[int, str]], stream: tuple[np.ndarray, ...]) -> str:
    """What the shape of a file's token stream tells: generated, minified, data or an empty string."""
    _, shape, size, name, literal = stream
    runs, repeated, distinct = self_similarity(shape, name, literal)
    if len(shape) >= LEAST_TOKENS and len(code.strip()) < TOKEN_CHARS * len(shape) and name.any() and size[name].mean() < NAME_CHARS:
        return "minified"
    if runs >= IN_RUNS:
        return "data"
    if runs >= IN_RUNS_STATED:  # a table inside code, or short rows: the characters of whole rows decide
        rows = sum(len(x) + 1 for x in text.split("\n") if _ROW.fullmatch(x))
        return "data" if rows >= 0.6 * len(text) else ""
    brief = len(shape) < BRIEF
    if distinct <= FEW or (not brief and distinct <= DISTINCT and repeated >= REPEATED) or (len(shape) < 2 * BRIEF and lines_alike(code)):
        return "generated"
    if (repeated >= REPEATED_STATED or len(shape) < SHORT_SHAPE) and says_made(comments):
        return "generated"
    return ""


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokens()
    for batch in batches:
        ext = [p[p.rfind(".") :].lower() if p and "." in p else "" for p in batch["path"]]
        parts = [parted(content, e) for content, e in zip(batch["content"], ext, strict=True)]
        rows = []
        for repo, path, file, (text, code, comments), stream in zip(batch["repo_id"], batch["path"], batch["content_id"].tolist(), parts, tokens.of([code for _, code, _ in parts]), strict=True):
            words = stream[0]
            rows.append((repo, path, file, own_sign(text, code, comments, stream), any(_COPIED.search(c) for line, c in comments if line < 3), fingerprints(words[words > 0])))
        yield pd.DataFrame(rows, columns=["repo_id", "path", "content_id", "sign", "says_copied", "prints"])


def _marked(files: DataFrame, similarity: float, repositories: int) -> DataFrame:
    """repo_id, path, kind of the files with a finding."""
    ext = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"(\.[^.]*)$", 1))
    seen = files.select("repo_id", "path", F.xxhash64("content", ext).alias("content_id"), "content").where("content <> ''")
    told = cut_lineage(spread(seen, "repo_id", "path").mapInPandas(_features, "repo_id string, path string, content_id long, sign string, says_copied boolean, prints array<long>"))
    prints = told.select("content_id", F.xxhash64("repo_id").alias("repo"), F.explode("prints").alias("print"))
    recurring = prints.groupBy("print").agg(F.count_distinct("repo").alias("n")).where("n >= 2")
    recurring = small_side(cut_lineage(recurring), BROADCAST_ROWS)
    # every file with a content adds all its prints, so the shares are those of the content
    known = prints.select("content_id", "print").join(recurring, "print", "left").groupBy("content_id").agg((F.count_if(F.col("n") >= repositories) / F.count("*")).alias("wide"), (F.count("n") / F.count("*")).alias("twice"))
    known = known.where(F.col("twice") >= similarity)
    copied = (F.size("prints") >= LEAST_PRINTS) & ((F.col("wide") >= similarity) | (F.col("says_copied") & (F.col("twice") >= similarity)))
    # a copy that says so and has no other copy in these tables comes last
    kind = F.when(copied, "vendored").when(F.col("sign") != "", F.col("sign")).when(F.col("says_copied"), "stated")
    marked = told.join(known, "content_id", "left").select("repo_id", "path", kind.alias("kind")).where("kind is not null")
    return marked.groupBy("repo_id", "path").agg(F.max("kind").alias("kind"))


def judge_files(files: DataFrame, similarity: float = SIMILARITY, repositories: int = REPOSITORIES) -> DataFrame:
    """Every file with its finding: repo_id, path, kind.

    kind is ``vendored`` (at least ``similarity`` of its fingerprints occur in ``repositories`` or more repositories, or in
    two and the file says where it comes from), ``generated``, ``minified``, ``data``, ``stated`` (it says that it is a copy, of
    which there is no other) or null for hand-written files.
    Repeated deliveries of (repo_id, path) are one file. Files with null or empty content, or null keys, are hand-written
    until known better, and so are those with fewer than ``LEAST_PRINTS`` fingerprints unless their shape tells more; an
    empty table gives an empty result. Names of folders and files are no evidence.
    """
    marked, every = _marked(files, similarity, repositories), files.select("repo_id", "path").distinct()
    return every.join(marked, every["repo_id"].eqNullSafe(marked["repo_id"]) & every["path"].eqNullSafe(marked["path"]), "left").select(every["repo_id"], every["path"], "kind")


def not_handwritten(files: DataFrame, similarity: float = SIMILARITY, repositories: int = REPOSITORIES) -> DataFrame:
    """Files not written by hand: repo_id, path; see judge_files()."""
    return _marked(files, similarity, repositories).select("repo_id", "path")
