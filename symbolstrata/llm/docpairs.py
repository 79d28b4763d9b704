"""Functions paired with their documentation (problem 3).

Method: signatures are found by regular expressions, bodies are delimited by the indentation or by a stack of brackets or
of end keywords, and the comment that ends directly above a declaration (by line distance, over decorators and the like)
or opens its body is attached. Files are parsed where they lie; the pairs meet their symbols by repository, path, name
and line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# ---- fixed values: words and phrases that make a description say nothing ----
_FILLER = frozenset(
    "a an the this that these those it its of for to in on by with from and or is are be as at function functions method methods func procedure routine constructor "
    "todo fixme xxx tbd tba hack none null na n nil undocumented doc docs docstring javadoc document documented documentation comment comments describe description descriptions summary "
    "add write up here goes go no not yet provided available missing placeholder insert fill me your text later stub stubs auto autogenerated automatically generated created editor ide template "
    "param params parameter parameters arg args argument arguments return returns type rtype raises throws foo bar lorem ipsum needed needs default".split()
)
_POINTER = re.compile(r"^\W*(?:see\b|@see\b|cf\b|refer to\b|same as\b|as above\b|as described\b|ditto\b|like above\b|documented (?:in|at|elsewhere)|described (?:in|at|elsewhere)|inherited\b|inherits? doc|\{?@inherit ?doc\}?|@link\b|@copydoc\b|copied from\b)", re.I)
_TOOL = re.compile(
    r"^\W*(?:noqa\b|pylint\b|eslint\b|eslint-|tslint\b|jshint\b|jscs\b|nolint\b|noinspection\b|type: ?ignore|@ts-|prettier-|clippy\b|istanbul\b|pragma\b|@formatter\b|checkstyle\b|nosonar\b|nosec\b|coverage\b|swiftlint\b"
    r"|rubocop\b|fmt: ?(?:on|off|skip)|isort\b|mypy\b|pyright\b|ruff\b|flake8\b|black\b:|go:\w+|\+build\b|@suppress\w*|c8 ignore|v8 ignore|stylelint|biome-ignore|deno-|region\b|endregion\b|#region|spell-?checker|cspell|language=|lint\b|skipcq|rustfmt\b|sonar\b|codeql\b|-\*-|vim?:|allow\(|deny\()",
    re.I,
)
_CODE = re.compile(
    r"^\s*(?:(?:(?:var|let|const|final|auto|int|long|double|float|bool|boolean|string|String|char|val|mut|let mut)\s+)?[\w.\[\]\"'$>-]+\s*(?::=|=|\+=|-=|\*=|/=|\|=|\^=)(?!=)\s*\S.*|(?:await\s+|return\s+|new\s+|yield\s+)?[\w.]+(?:!|::\w+)?\(.*\)\s*;?|[\w.]+\(.*[;{]\s*|(?:if|while|for|switch|catch|elif|else if)\b.*[:{]\s*|(?:return|throw|raise|import|from|assert|break|continue|del|yield|else|try)\b[^.]*[;:{)\]\d]\s*|return \w+|[\[\]{}();,]+|(?:public|private|protected|static|def|func|fn|class)\b.*[({:]\s*)$"
)
_PART = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_TAG = re.compile(r"(?:^|\s)(?:[@\\](?:param|arg|argument|tparam)\s*(?:\{[^}]*\})?|:(?:param|type|arg)\b)\s*\[?(?P<name>[\w.$]*)\]?:?|(?:^|\s)(?:@returns?|@throws|@exception|:returns?:|:rtype:|:raises?[^:]*:|@\w+\b)")
_SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _PART.findall(_CAMEL.sub(" ", text))]


def _stems(word: str) -> set[str]:
    out = {word}
    for end in ("s", "es", "d", "ed", "ing", "r", "er"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            out |= {word[: -len(end)], word[: -len(end)] + "e"}
    if word.endswith("ies"):
        out.add(word[:-3] + "y")
    return out


def says_something(description: str | None, name: str | None, params: list[str] | None = None) -> bool:
    """Whether a description tells more than the declaration itself.

    False for null and blank ones, separators, placeholders, pointers to elsewhere, instructions to tools, commented-out
    code, and for those whose words are only those of the name, of the parameters and fillers.
    """
    if not description or not description.strip():
        return False
    known = set(_FILLER)
    for n in (name or "", *(p for p in params or () if p)):
        parts = _words(n)
        known.update(*map(_stems, parts), {"".join(parts), n.lower()})
    lines = [x for x in description.strip().split("\n") if x.strip()]
    tagged = [x for x in lines if not _TOOL.match(x)]
    if tagged and all(_CODE.match(x.strip()) for x in tagged):
        return False
    for m in _TAG.finditer(description):
        if m["name"]:
            known.update(_words(m["name"]))
    text = _TAG.sub(" \n ", "\n".join(x for x in tagged if not _CODE.match(x.strip()) or len(tagged) == 1))
    for sentence in _SENTENCE.split(text):
        if _POINTER.match(sentence) or _TOOL.match(sentence):
            continue
        left = [w for w in _words(sentence) if not (_stems(w) & known)]
        if left and not _is_code(sentence):
            return True
    return False


def _is_code(sentence: str) -> bool:
    return bool(_CODE.match(sentence.strip()))


_DECORATION = re.compile(r"^\s*(?:@[\w.]+(?:\(.*\))?\s*$|@[\w.]+\(|#!?\[.*\]\s*$|\[[A-Z]\w*.*\]\s*$)")
_LINE_COMMENT = {"#": re.compile(r"^\s*#(?!\[|!\[)(.*)$"), "/": re.compile(r"^\s*//[/!]?(.*)$")}
_HASH_EXT = frozenset((".py", ".rb", ".sh", ".pl", ".r"))
_OPENING = re.compile(r'^\s*[rRuUbBfF]{0,2}("""|\'\'\'|"|\')')
# ---- fixed values: declarations of functions and methods by language ----
_WORDY = re.compile(r"^\s*(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|async|export|default|override|open|suspend|inline|unsafe|const|extern|virtual|sealed|synchronized|native|readonly|get|set|partial)\s+)*(?:def|func|fn|fun|function\*?)\s*(?:\([^)]*\)\s*)?(?P<name>[\w$]+[?!]?)\s*(?:<[^>(]*>)?\s*\(")
_ARROW = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)")
_TYPED = re.compile(r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|async|override|virtual|sealed|synchronized|native|default|readonly|get|set|\*)\s+)*(?:<[^>]*>\s*)?(?:[\w$.]+(?:<[^()]*>)?(?:\[\])*\s+)?(?P<name>[\w$#]+)\s*(?:<[^>(]*>)?\s*\([^;]*$")
_NO_NAME = frozenset("if for while switch catch return else do try new throw super this with await yield function typeof delete in of when match elif except lambda print".split())
_PARAMS = re.compile(r"\(([^()]*(?:\([^()]*\)[^()]*)*)")


def _plain(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿").split("\n")


def signature(line: str) -> str | None:
    """The name that a line declares as a function or method, if it does."""
    m = _WORDY.match(line) or _ARROW.match(line)
    if m is None and "(" in line:
        m = _TYPED.match(line)
        if m and (m["name"] in _NO_NAME or line.lstrip().split("(")[0].split()[0] in _NO_NAME or ("{" not in line[m.end("name") :] and not line.rstrip().endswith(("(", ",", ")")))):
            m = None
    return m["name"] if m else None


def comment_above(lines: list[str], at: int, ext: str) -> str:
    """The text of the comment block that ends on the line above line ``at`` (0-based), past decorators; or nothing."""
    i = at - 1
    while i >= 0 and _DECORATION.match(lines[i]):
        i -= 1
    if i < 0:
        return ""
    single = _LINE_COMMENT["#" if ext in _HASH_EXT else "/"]
    found: list[str] = []
    if single.match(lines[i]):
        while i >= 0 and (m := single.match(lines[i])):
            found.append(m[1].strip())
            i -= 1
        return "\n".join(reversed(found))
    if ext not in _HASH_EXT and lines[i].rstrip().endswith("*/"):
        while i >= 0:
            x = lines[i].strip()
            found.append(re.sub(r"^/\*+!?|\*+/$|^\*+(?!/)", "", x).strip().removesuffix("*/").strip())
            if x.startswith("/*"):
                break
            if found and i < at - 1 and not x.startswith("*") and "/*" not in x and x.endswith(("{", "}", ";")):
                return ""
            i -= 1
        return "\n".join(reversed(found)).strip()
    return ""


# ---- fixed values: strings and comments by family of languages; openers and closers of a stack ----
_STRING = r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`(?:[^`\\]|\\.)*`'
_ASIDE = {"#": re.compile(rf"{_STRING}|\#[^\n]*", re.S), "/": re.compile(rf"{_STRING}|/\*.*?(?:\*/|\Z)|//[^\n]*", re.S)}
_END_EXT = frozenset((".rb", ".lua", ".ex", ".exs", ".jl"))
_OPENS = re.compile(r"^\s*(?:(?:local|private|public|protected)\s+)?(?:def|defp|defmodule|class|module|function|if|unless|case|while|until|for|begin)\b|=\s*(?:if|unless|case|begin|function)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|\bfunction\s*\([^)]*\)\s*$")
_ENDS = re.compile(r"(?<![\w.:])end\b(?![?!:])")


class Source:
    """A source text by lines, with what stands in strings and comments blanked where its structure is read."""

    def __init__(self, text: str, ext: str):
        self.lines, self.ext = _plain(text), ext

    @cached_property
    def code(self) -> list[str]:
        """The lines without strings and comments; as many as there are lines."""
        aside = _ASIDE["#" if self.ext in _HASH_EXT or self.ext in _END_EXT else "/"]
        return aside.sub(lambda m: "\n" * m[0].count("\n") or " ", "\n".join(self.lines)).split("\n")

    @cached_property
    def depth(self) -> list[int]:
        """How many brackets, or blocks that an end keyword closes, are open after each line."""
        out, depth = [], 0
        for x in self.code:
            if self.ext in _END_EXT:
                depth += len(_OPENS.findall(x)) - len(_ENDS.findall(x))
            else:
                depth += sum(map(x.count, "([{")) - sum(map(x.count, ")]}"))
            out.append(depth)
        return out

    def header_end(self, at: int) -> int:
        """The last line of the header of the Python definition on line ``at``."""
        before = self.depth[at - 1] if at else 0
        return next((i for i in range(at, len(self.code)) if self.depth[i] <= before and self.code[i].rstrip().endswith(":")), at)

    def body_end(self, at: int) -> int:
        """The line after the body of the declaration on line ``at``: by indentation in Python, else where its stack is empty again."""
        code = self.code
        if self.ext == ".py":
            indent = len(self.lines[at]) - len(self.lines[at].lstrip())
            end = at + 1
            while end < len(code):
                x = code[end]
                if x.strip() and len(x) - len(x.lstrip()) <= indent and not x.lstrip().startswith((")", "]", "}")):
                    break
                end += 1
            while end > at + 1 and not self.lines[end - 1].strip():
                end -= 1
            return end
        before, opened = self.depth[at - 1] if at else 0, False
        for i in range(at, len(code)):
            opened |= self.ext in _END_EXT or "{" in code[i]
            if self.depth[i] <= before and (opened or code[i].rstrip().endswith(";")):
                return i + 1
        return len(code)

    def docstring(self, at: int) -> str:
        """The string that opens the body of the Python definition on line ``at``, or nothing."""
        lines = self.lines
        i = self.header_end(at) + 1
        while i < len(lines) and not lines[i].strip():
            i += 1
        m = _OPENING.match(lines[i]) if i < len(lines) else None
        if not m:
            return ""
        quote = m[1]
        rest = lines[i][m.end() :]
        if len(quote) == 1:
            return rest.split(quote)[0] if rest.rstrip().endswith(quote) else ""
        out = []
        while quote not in rest and i + 1 < len(lines):
            out.append(rest)
            i += 1
            rest = lines[i]
        out.append(rest.split(quote)[0])
        return "\n".join(x.strip() for x in out).strip()

    def described(self, at: int) -> str:
        inside = self.docstring(at) if self.ext == ".py" else ""
        above = comment_above(self.lines, at, self.ext)
        return "\n".join(x for x in (inside, above) if x)

    def declared(self) -> Iterator[tuple[int, str]]:
        """Line (0-based) and name of each function or method."""
        for i, line in enumerate(self.lines):
            if ("(" in line or "=>" in line or self.ext in _END_EXT) and (name := signature(line)) is not None:
                yield i, name


def _parameters(line: str) -> list[str]:
    m = _PARAMS.search(line)
    return re.findall(r"[\w$]+", m[1]) if m else []


def _ext(path: str | None) -> str:
    return path[path.rfind(".") :].lower() if path and "." in path else ""


def _from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for repo, path, content in zip(batch["repo_id"], batch["path"], batch["content"], strict=True):
            source = Source(content, _ext(path))
            for i, name in source.declared():
                text = source.described(i)
                if text and says_something(text, name, _parameters(source.lines[i])):
                    rows.append((repo, path, i + 1, name, text, "\n".join(source.lines[i : source.body_end(i)])))
        yield pd.DataFrame(rows, columns=["repo_id", "path", "line", "name", "description", "code"])


def _from_symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        say = [says_something(d, n, None if p is None else list(p)) for d, n, p in zip(batch["doc"], batch["name"], batch["params"], strict=True)]
        yield batch.loc[say, ["sym_id", "doc"]].rename(columns={"doc": "description"})


def _from_bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, path, name, body in zip(batch["sym_id"].tolist(), batch["path"], batch["name"], batch["body"], strict=True):
            if not name:
                continue
            source = Source(body, _ext(path))
            at = next((i for i, x in enumerate(source.lines) if name in x and signature(x) == name), None)
            if at is None:
                continue
            text = source.described(at)
            if text and says_something(text, name, _parameters(source.lines[at])):
                rows.append((key, text, "\n".join(source.lines[at : source.body_end(at)])))
        yield pd.DataFrame(rows, columns=["sym_id", "description", "code"])


_SPOKEN = "repo_id string, path string, line int, name string, description string, code string"


def _descriptions(symbols: DataFrame, bodies: DataFrame, files: DataFrame) -> DataFrame:
    wanted = symbols.where("type in ('function', 'method')")
    own = spread(wanted.where("trim(doc) <> ''").select("sym_id", "name", "doc", "params"), "sym_id").mapInPandas(_from_symbols, "sym_id long, description string")
    inner = spread(bodies.where("type in ('function', 'method') and body <> ''").select("sym_id", "path", "name", "body"), "sym_id").mapInPandas(_from_bodies, "sym_id long, description string, code string")
    spoken = spread(files.select("repo_id", "path", "content").where("content <> ''"), "repo_id", "path").mapInPandas(_from_files, _SPOKEN)
    spoken = spoken.groupBy("repo_id", "path", "line", "name").agg(F.first("description").alias("description"), F.first("code").alias("code"))
    outer = wanted.select("sym_id", "repo_id", "path", "line", "name").distinct().join(spoken, ["repo_id", "path", "line", "name"]).select("sym_id", "description", "code")
    return (
        outer.withColumn("rank", F.lit(0))
        .unionByName(own.withColumn("code", F.lit(None).cast("string")).withColumn("rank", F.lit(1)))
        .unionByName(inner.withColumn("rank", F.lit(2)))
    )


def described_symbols(symbols: DataFrame, bodies: DataFrame, files: DataFrame) -> DataFrame:
    """sym_id of functions and methods with a description that says something, from any of the three tables; distinct.

    Repeated deliveries count once. Null texts, names and paths give no description; an empty table gives none. A comment
    on another line than the symbol's declares is not taken, nor are comments inside bodies or at the head of a file.
    """
    return _descriptions(symbols, bodies, files).select("sym_id").distinct()


def code_description_pairs(symbols: DataFrame, bodies: DataFrame, files: DataFrame) -> DataFrame:
    """One row per described function or method: sym_id, repo_id, path, name, description, code.

    The description from the source is preferred to that of the index, which may be cut; the code is the declaration and
    its body from the file, or the body of ``bodies`` where the file has no such declaration.
    """
    best = _descriptions(symbols, bodies, files).groupBy("sym_id").agg(F.min(F.struct("rank", "description", "code")).alias("b"), F.min(F.when(F.col("code").isNotNull(), F.struct("rank", "code"))).alias("c"))
    names = symbols.groupBy("sym_id").agg(F.min(F.struct("repo_id", "path", "name")).alias("s"))
    code = bodies.groupBy("sym_id").agg(F.min("body").alias("body"))
    return best.join(names, "sym_id").join(code, "sym_id", "left").select("sym_id", "s.repo_id", "s.path", "s.name", "b.description", F.coalesce("c.code", "body").alias("code"))
