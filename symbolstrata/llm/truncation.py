"""Text cut off by field limits (problem 8).

Method: self-join by prefix, at two grains. Whole values are sorted, so a value that is a strict prefix of a longer one
stands right before it. And since most cut texts have no longer copy, the same is asked of their last sentence or line:
its last words, open-class words made equal, are looked up among the ends and among the strict prefixes of all sentences
and lines of all documents. A last sentence that is a prefix of many others and hardly ever an end was cut.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side, spread

#: Tokens of context.
CONTEXT = 6
#: Sentences of up to LITERAL tokens, their start included, can be closings; openings of that length are counted as they stand.
LITERAL = 8
#: A word is kept if it makes up FREQUENT of all tokens, or SEEN of them while one token follows it in FIXED_NEXT of its places.
#: At most 1 / SEEN words can make up that share, so the kept ones are a bounded set at every size of the table.
FREQUENT, FIXED_NEXT, SEEN = 0.004, 0.3, 8e-6
#: An ending counts as unusual below this share of the places where the same words go on.
RARE_END, RARE_WORD = 0.1, 0.002
#: A sentence that goes on in more than this share of the places where it ends is no closing.
GOES_ON = 0.5
#: A value shorter than this is cut only if a longer one goes on inside its last word; "LGTM" is whole beside "LGTM, thanks".
SHORT = 40
#: Characters by which values are range-partitioned, and those of prefixes that more than HOT_PREFIX values share.
RANGE_KEY, LONG_KEY, HOT_PREFIX = 512, 8_192, 50_000

# ---- fixed values: marks that stand where a text was cut ----
_MARK = re.compile(r"\s*(?:…|\.{3,}|[\[(<]\s*(?:\.{3}|…|truncated|cut(?: off)?|continued|more|snip)\s*[\])>])\s*$", re.I)
_MARK_SQL = r"(?i)\s*(…|\.{3,}|[\[(<]\s*(\.{3}|…|truncated|cut( off)?|continued|more|snip)\s*[\])>])?\s*$"
_TOKEN = re.compile(r"[^\W\d_][^\W_]*(?:['’][^\W_]+)*|\d+(?:[.,:]\d+)*|```|`[^`\n]*`|\n+|[^\w\s]|_")
#: The token of a quote of code that its line doesn't close.
OPEN = "`?"
#: Narrow sides of up to this many rows are broadcast.
BROADCAST_ROWS = 2_000_000
_DIGITS = re.compile(r"\d+")


def tokens(text: str) -> list[str]:
    """Words, numbers by their form, quoted code as one token, signs, line ends."""
    out = []
    for t in _TOKEN.findall(text):
        c = t[0]
        if c == "\n":
            out.append("\n")
        elif c == "`" and t != "```":
            out.append("`" if len(t) > 1 else OPEN)
        elif c.isdigit():
            out.append(_DIGITS.sub("0", t))
        else:
            out.append(t)
    return out


def unmarked(text: str) -> str:
    """A text without blanks around it and without a mark of truncation at its end."""
    text = text.strip()
    start = max(0, len(text) - 60)  # marks are short; the pattern is slow on whole texts
    mark = _MARK.search(text, start)
    return text[: mark.start()] if mark and mark.start() else text


class Codes(dict):
    """Numbers for raw tokens, given as they come, with what the operator needs of each token in arrays."""

    def __init__(self, kept: frozenset[str] = frozenset()):
        super().__init__()
        self.kept = kept
        self.names: list[str] = []
        self._place: dict[str, int] = {}
        self._rows: list[tuple[int, int, int]] = []

    def __missing__(self, raw: str) -> int:
        name = tokens(raw)[0] if raw != "`" else OPEN
        place = self._place.get(name)
        if place is None:
            place = self._place[name] = len(self.names)
            self.names.append(name)
            opened = name[0].isalpha() and name not in self.kept
            flags = (name == "\n") * LINE_END | (name in ".?!") * FULL_STOP | name[0].isalpha() * WORD | (name == OPEN) * UNCLOSED
            self._rows.append((xxhash.xxh64_intdigest("W" if opened else name, 1), xxhash.xxh64_intdigest(name, 2), flags))
        self[raw] = place
        return place

    def arrays(self) -> tuple[np.ndarray, ...]:
        shape, literal, flags = zip(*self._rows, strict=True)
        return np.array(shape, dtype=np.uint64), np.array(literal, dtype=np.uint64), np.array(flags, dtype=np.int64)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of all texts one after the other, and where each text ends."""
        each = [list(map(self.__getitem__, _TOKEN.findall(t))) for t in texts]
        ends = np.cumsum([len(x) for x in each], dtype=np.int64) if each else np.zeros(0, dtype=np.int64)
        return np.fromiter(itertools.chain.from_iterable(each), dtype=np.int64, count=int(ends[-1]) if len(ends) else 0), ends


LINE_END, FULL_STOP, WORD, UNCLOSED = 1, 2, 4, 8
_START = np.uint64(0x9E3779B97F4A7C15)
_STEP = [pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(max(CONTEXT, LITERAL) + 1)]


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _looked_at(codes: Codes, texts: list[str]) -> dict[str, np.ndarray] | None:
    """For each token that is no line end: keys of its pattern and of its sentence before it, and where it stands."""
    code, ends = codes.of(texts)
    if not len(code):
        return None
    shape, literal, flags = (x[code] for x in codes.arrays())
    first = np.zeros(len(code), dtype=bool)
    first[np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]] = True
    first[1:] |= (flags[:-1] & (LINE_END | FULL_STOP)) > 0
    last_of_text = np.zeros(len(code), dtype=bool)
    last_of_text[ends[np.diff(ends, prepend=0) > 0] - 1] = True
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    stay = (flags & LINE_END) == 0
    code, shape, literal, flags, first, last_of_text, owner = (x[stay] for x in (code, shape, literal, flags, first, last_of_text, owner))
    if not len(shape):
        return None
    at = np.arange(len(shape))
    begin = np.maximum.accumulate(np.where(first, at, 0))
    place = at - begin
    pattern = np.zeros(len(shape), dtype=np.uint64)
    for k in range(CONTEXT):
        before = np.where(place >= k, np.roll(shape, k), np.where(place + 1 == k, _START, np.uint64(0)))
        pattern += before * np.uint64(_STEP[k])
    powers = np.array(_STEP[:LITERAL], dtype=np.uint64)
    terms = np.where(place < LITERAL, literal * powers[np.minimum(place, LITERAL - 1)], np.uint64(0))
    sums = np.cumsum(terms)
    context = sums - terms - np.where(begin > 0, sums[begin - 1], np.uint64(0))
    since = lambda flag: (c := np.cumsum((flags & flag) > 0)) - np.where(begin > 0, c[begin - 1], 0)
    return {
        "pattern": _mix(pattern, 11), "context": _mix(context, 12), "code": code, "word": _mix(literal, 13), "is_word": (flags & WORD) > 0, "place": place, "owner": owner,
        "ends": np.append(first[1:], True), "text_ends": last_of_text, "unclosed": since(UNCLOSED) > 0,
    }


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    codes = Codes()
    for batch in batches:
        code, ends = codes.of(list(batch["text"]))
        if len(code) < 2:
            continue
        inner = np.ones(len(code) - 1, dtype=bool)
        inner[ends[(ends > 0) & (ends < len(code))] - 1] = False
        _, _, flags = codes.arrays()
        both, n = np.unique((code[:-1] << 32 | code[1:])[inner], return_counts=True)
        kept = (flags[both >> 32] & WORD) > 0
        names = np.array(codes.names, dtype=object)
        yield pd.DataFrame({"word": names[both[kept] >> 32], "next": names[both[kept] & 0xFFFFFFFF], "n": n[kept]})
        yield pd.DataFrame({"word": [""], "next": [""], "n": [int(n.sum())]})


def kept_words(documents: DataFrame) -> frozenset[str]:
    """Words that stay themselves in a pattern: frequent ones and those that one token mostly follows.

    Counted over all documents. Only shares decide, so the answer doesn't shift with the size of the table, and at most
    1 / SEEN words (125,000) can come to the driver.
    """
    pairs = documents.select("text").where("text is not null").mapInPandas(_pairs, "word string, next string, n long").groupBy("word", "next").agg(F.sum("n").alias("n"))
    words = cut_lineage(pairs.groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most")))
    total = (words.where("word = ''").agg(F.sum("n")).first() or [0])[0] or 0
    fit = words.where("word <> ''").where((F.col("n") >= FREQUENT * total) | ((F.col("n") >= SEEN * total) & (F.col("most") >= FIXED_NEXT * F.col("n"))))
    return frozenset(r[0] for r in fit.select("word").collect())


def _counted(key: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct key: its first place, how often it ends and how often it goes on."""
    where, keys = pd.factorize(key)
    first = np.zeros(len(keys), dtype=np.int64)
    first[where[::-1]] = np.arange(len(key))[::-1]
    end = np.bincount(where, weights=ends, minlength=len(keys)).astype(np.int64)
    return first, end, np.bincount(where, minlength=len(keys)) - end


def _patterns(kept: frozenset[str]):
    """Counts of patterns as ends and as strict prefixes, of literal sentences likewise, and of words inside texts.

    A literal sentence is named by the key of what stands before its last token and by that token, so that sentences whose
    last word is longer are found beside it; patterns and words have no name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(kept)
        for batch in batches:
            x = _looked_at(codes, [unmarked(t) for t in batch["text"]])
            if x is None:
                continue
            ends, goes = x["ends"], ~x["ends"]
            short, opening = ends & (x["place"] + 2 <= LITERAL), goes & (x["place"] + 2 <= LITERAL)
            inner = x["is_word"] & ~x["text_ends"]
            key = np.concatenate([x["pattern"], x["word"][inner]])
            first, end, goes = _counted(key, np.concatenate([ends, np.zeros(inner.sum(), dtype=bool)]))
            yield pd.DataFrame({"key": key[first].view(np.int64), "name": "", "ends": end, "goes": goes})
            at = np.flatnonzero(short | opening)
            context, code = x["context"][at], x["code"][at]
            first, end, goes = _counted(context + code.astype(np.uint64) * np.uint64(_STEP[LITERAL]), ends[at])
            yield pd.DataFrame({"key": context[first].view(np.int64), "name": np.array(codes.names, dtype=object)[code[first]], "ends": end, "goes": goes})

    return run


def _last(kept: frozenset[str]):
    """What to look up for each document: its last pattern, that without its last token, its words as they stand, the last word.

    A sentence doesn't go past a line end, so the last line is all that is read of a text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Codes(kept)
        for batch in batches:
            x = _looked_at(codes, [unmarked(t).rstrip().rpartition("\n")[2] for t in batch["text"]])
            if x is None:
                continue
            last = np.flatnonzero(x["text_ends"])
            docs, place, opened = batch["doc_id"].to_numpy()[x["owner"][last]], x["place"][last], x["unclosed"][last]
            closing = place + 2 <= LITERAL  # tokens of the sentence with its start
            parts = [("shape", last, np.ones(len(last), dtype=bool), "pattern"), ("before", last - 1, place > 0, "pattern"), ("literal", last, closing, "context"), ("word", last, x["is_word"][last], "word")]
            for what, at, on, column in parts:
                name = np.array(codes.names, dtype=object)[x["code"][at[on]]] if what == "literal" else ""
                yield pd.DataFrame({"doc_id": docs[on], "what": what, "key": x[column][at[on]].view(np.int64), "name": name, "open": opened[on] & (what == "shape")})

    return run


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over sorted distinct values: keys of those that the next one extends; then the partition's first and last value."""
    first = last = None
    for batch in batches:
        found = []
        for key, text in zip(batch["key"].tolist(), batch["value"], strict=True):
            if last is None:
                first = (key, text)
            elif text.startswith(last[1]):
                found.append(last[0])
            last = (key, text)
        yield pd.DataFrame({"key": found, "edge": "hit", "value": None})
    if first:
        yield pd.DataFrame({"key": [first[0], last[0]], "edge": ["first", "last"], "value": [first[1], last[1]]})


def unmarked_values(documents: DataFrame) -> DataFrame:
    """doc_id, value (its text without a mark at its end) and key (the value's hash) of all documents whose text isn't null."""
    # only the last characters are searched for a mark; the pattern is slow on whole texts
    tail = F.length(F.regexp_extract(F.right(F.col("text"), F.lit(60)), _MARK_SQL, 0))
    value = F.when((F.col("tail") > 0) & (F.col("tail") < F.length("text")), F.expr("left(text, length(text) - tail)")).otherwise(F.col("text"))
    values = documents.where("text is not null").withColumn("tail", tail).select("doc_id", value.alias("value"))
    return values.withColumn("key", F.xxhash64("value"))


def distinct_values(values: DataFrame) -> DataFrame:
    """key, value: equal values are made one. Only those that occur again are shuffled, pre-aggregated; the others stay where they are."""
    again = cut_lineage(values.groupBy("key").count().where("count > 1").select("key"))
    again = small_side(again, BROADCAST_ROWS)
    once = values.join(again, "key", "left_anti").select("key", "value")
    return once.unionByName(values.join(again, "key", "left_semi").groupBy("key").agg(F.first("value").alias("value")))


def sharing_heads(distinct: DataFrame) -> DataFrame:
    """Those of the distinct values of SHORT characters or more that can be a strict prefix of another one or have one: key, value.

    Hashed prefixes of SHORT, 2 SHORT, 4 SHORT, ... characters: a value and its extension share the longest that the value
    has, so a prefix that no two values share, or that is no value's longest, brings nobody in. Values bring a narrow row for each
    doubling of their length.
    """
    long = distinct.select("key", "value", F.length("value").alias("n")).where(F.col("n") >= SHORT)
    long = long.select("key", "value", F.floor(F.log2(F.col("n") / SHORT) + 1e-9).cast("int").alias("last"))
    head = F.expr(f"transform(sequence(0, last), k -> xxhash64(k, left(value, shiftleft({SHORT}, k))))")
    heads = long.select("key", "last", F.posexplode(head).alias("k", "head"))
    heads = cut_lineage(heads.select("key", "head", (F.col("k") == F.col("last")).alias("longest")))
    shared = heads.groupBy("head").agg(F.count("*").alias("n"), F.max("longest").alias("longest")).where("n > 1 and longest").select("head")
    wanted = heads.join(small_side(cut_lineage(shared), BROADCAST_ROWS), "head", "left_semi").select("key").distinct()
    return distinct.join(small_side(cut_lineage(wanted), BROADCAST_ROWS), "key", "left_semi")


def short_prefixes(distinct: DataFrame) -> DataFrame:
    """key of the values under SHORT characters that go on inside their last word in another value: hashed prefixes, joined.

    The heads of all values are made distinct first, so a head that many share asks once.
    """
    short = distinct.where(F.length("value").between(1, SHORT - 1)).select("key", F.length("value").alias("n"), F.col("value").alias("head"))
    lengths = sorted(r[0] for r in short.select("n").distinct().collect())  # fewer than SHORT numbers
    if not lengths:
        return short.select("key")
    heads = distinct.select(F.left("value", F.lit(SHORT)).alias("whole")).distinct()
    word = r"[\\p{L}\\p{N}]"
    longer = heads.select("whole", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where("n < length(whole)")
    longer = longer.where(F.expr(f"substr(whole, n, 1) rlike '{word}' and substr(whole, n + 1, 1) rlike '{word}'"))
    return short.join(longer.select("n", F.expr("left(whole, n)").alias("head")).distinct(), ["n", "head"], "left_semi").select("key")


def strict_prefixes(distinct: DataFrame, range_key: int = RANGE_KEY, long_key: int = LONG_KEY, hot_prefix: int = HOT_PREFIX) -> DataFrame:
    """key of the distinct values (key, value) that are a strict prefix of another one; short ones only inside a word.

    Values that share a hashed prefix as far as it goes (``sharing_heads``) are range-partitioned and sorted, so each task gets
    a like share and a value's extensions follow it directly; the
    edges of the partitions, two values each, are matched in a second small step. The ranges are drawn from the first
    ``range_key`` characters, so the sample that Spark takes to the driver has no long texts in it; only values that share
    these with more than ``hot_prefix`` others are told apart by ``long_key`` characters.
    """
    values = cut_lineage(sharing_heads(distinct))
    start = F.xxhash64(F.left("value", F.lit(range_key)))
    hot = values.groupBy(start.alias("start")).count().where(F.col("count") > hot_prefix)
    # at most one start for each hot_prefix values
    hot = small_side(cut_lineage(hot.select("start", F.lit(True).alias("hot"))), BROADCAST_ROWS)
    keyed = values.withColumn("start", start).join(hot, "start", "left")
    keyed = keyed.withColumn("range", F.when(F.col("hot"), F.left("value", F.lit(long_key))).otherwise(F.left("value", F.lit(range_key))))
    ordered = keyed.repartitionByRange("range").sortWithinPartitions("value").select("key", "value")
    seen = cut_lineage(ordered.mapInPandas(_neighbours, "key long, edge string, value string").withColumn("part", F.spark_partition_id()))
    edges = seen.where("edge <> 'hit'")
    follows = F.lag("part").over(W.orderBy("part"))  # a row for each partition
    nexts = edges.where("edge = 'first'").select(follows.alias("part"), F.col("value").alias("next_value"))
    over = edges.where("edge = 'last'").join(nexts, "part").where(F.col("next_value").startswith(F.col("value"))).select("key")
    return seen.where("edge = 'hit'").select("key").unionByName(over).unionByName(short_prefixes(distinct))


def prefixes_of_others(documents: DataFrame) -> DataFrame:
    """doc_id of documents whose text, without a mark at its end, is a strict prefix of another document's text."""
    values = unmarked_values(documents)
    return values.select("doc_id", "key").join(strict_prefixes(distinct_values(values)), "key", "left_semi").select("doc_id").distinct()


def longer_words(counts: DataFrame, sentences: DataFrame) -> DataFrame:
    """How often sentences (key, name) go on after a longer word that starts with their last one: key, name, longer.

    A self-join by prefix of last words against inner words behind the same words. Each counted word is cut to the lengths
    asked for behind these words, so the join is by equality and no task compares all words of one place.
    """
    lengths = sentences.groupBy("key").agg(F.collect_set(F.length("name")).alias("lengths"))
    inner = counts.where("name <> '' and goes > 0").join(lengths, "key").select("key", "name", "goes", F.explode("lengths").alias("n"))
    starts = inner.where(F.col("n") < F.length("name")).select("key", F.expr("left(name, n)").alias("name"), "goes")
    return starts.join(sentences, ["key", "name"]).groupBy("key", "name").agg(F.sum("goes").alias("longer"))


def cut_documents(documents: DataFrame, rare_end: float = RARE_END, rare_word: float = RARE_WORD) -> DataFrame:
    """Documents whose text lost its end: doc_id, sign.

    sign tells by what: ``prefix`` (a longer copy exists), ``open`` (a code block or a quote of code is not closed), ``phrase`` (the last
    sentence goes on almost everywhere else) or ``word`` (its last word stands nowhere else). Endings that recur as they
    stand are closings, hence complete, unless they go on elsewhere, be it only inside their last word. Null and blank texts
    are no cases; copies of one text count once and are judged alike; an empty
    table gives an empty result.
    """
    values = unmarked_values(spread(documents.select("doc_id", "text").where("trim(text) <> ''"), "doc_id"))
    distinct = cut_lineage(distinct_values(values))  # read by every step
    texts = distinct.select(F.col("key").alias("doc_id"), F.col("value").alias("text"))
    kept = kept_words(texts)
    counts = texts.select("text").mapInPandas(_patterns(kept), "key long, name string, ends long, goes long").groupBy("key", "name").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    counts = cut_lineage(counts)
    asked = texts.mapInPandas(_last(kept), "doc_id long, what string, key long, name string, open boolean")
    known = asked.join(counts, ["key", "name"], "left").groupBy("doc_id").agg(
        F.max("open").alias("open"),
        F.max(F.when(F.col("what") == "literal", F.col("key"))).alias("key"),
        F.max("name").alias("name"),
        *[F.max(F.when(F.col("what") == what, F.coalesce(n, F.lit(0)))).alias(f"{what}_{n}") for what in ("shape", "before", "literal", "word") for n in ("ends", "goes")],
    )
    known = cut_lineage(known)
    recurs = (F.col("literal_ends") >= 3) & (F.col("literal_goes") <= GOES_ON * F.col("literal_ends"))
    longer = longer_words(counts, known.where(recurs & F.col("word_goes").isNotNull()).select("key", "name").distinct())
    known = known.join(longer, ["key", "name"], "left").withColumn("longer", F.coalesce("longer", F.lit(0)))
    ends = F.col("shape_ends") - 1  # without this text's own end
    phrase = (F.col("shape_goes") >= 1) & (ends <= rare_end * F.col("shape_goes"))
    rare = (F.col("before_goes") >= 50) & (ends <= rare_word * F.col("before_goes"))
    # a sentence that also goes on, by a token or inside its last word, more than half as often as it ends was cut at the same
    # place in several texts; so was one whose last word goes on nowhere but where it is longer
    inside = (F.col("longer") > 0) & (F.col("word_goes") == 0)
    closing = recurs & (F.col("literal_goes") + F.col("longer") <= GOES_ON * F.col("literal_ends")) & ~F.coalesce(inside, F.lit(False))
    sign = F.when(F.col("open"), "open").when(phrase | F.coalesce(rare, F.lit(False)), "phrase").when(F.col("word_goes") == 0, "word")
    told = known.where(~F.coalesce(closing, F.lit(False))).select("doc_id", sign.alias("sign")).where("sign is not null")
    opened = texts.where("regexp_count(text, '(?m)^ *```') % 2 = 1").select("doc_id", F.lit("open").alias("sign"))
    longer = strict_prefixes(distinct).select(F.col("key").alias("doc_id"), F.lit("prefix").alias("sign"))
    judged = told.unionByName(opened).unionByName(longer).groupBy(F.col("doc_id").alias("key")).agg(F.min("sign").alias("sign"))
    return values.select("doc_id", "key").join(judged, "key").groupBy("doc_id").agg(F.min("sign").alias("sign"))


def source_name(column: str = "source"):
    """A source's name without differences of case and blanks; unknown ones are null."""
    name = F.lower(F.trim(F.col(column)))
    return F.when(name != "", name)


def cut_share_by_source(documents: DataFrame) -> DataFrame:
    """Per source, spelling aside: documents, cut documents, their share; documents with null or blank text count as whole."""
    cut = cut_documents(documents).select("doc_id", F.lit(1).alias("cut"))
    return documents.select("doc_id", source_name().alias("source")).join(cut, "doc_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count("cut").alias("cut_documents")).withColumn("cut_share", F.round(F.col("cut_documents") / F.col("documents"), 6))
