"""Long exact spans shared between records (problem 2).

Method: suffix automata of reference shards. Streaming every record past the automaton of every shard would be quadratic,
so a shard holds what can match: records are cut where their text itself says so (winnowing of character hashes, which
selects at least one anchor inside every span of the wanted length, the same one in every copy), and the stretches around
equal anchors form one reference shard. A task builds the automaton of a shard's distinct stretches and streams the same
stretches through it; the state reached tells the class of the span that ends there, so classes of stretches that share
a span come out without comparing pairs. Nothing is lost: two records with a common span of the wanted length have a
common anchor in it, and the stretch around the anchor holds the whole span in both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, small_side, split_join, spread

#: Least length of a shared span, in characters.
SPAN = 200
#: Characters hashed for an anchor; with SPAN it fixes the winnowing window SPAN - GRAM + 1.
GRAM = 100
#: A shard with more distinct stretches than this is not put into one task; its spans are matched by hash instead.
SHARD_STRETCHES = 2_000
#: Members of a class that a task of the expansion into pairs gets on one side at most.
CLASS_PART = 1_000
#: Sides up to this many narrow rows (16 to 24 bytes each) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 2_000_000

_CHUNK = 1 << 20
_BASE = 6364136223846793005


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    size = max(1024, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            power = np.full(size, base, dtype=np.uint64)
            power[0] = 1
            made.append(np.multiply.accumulate(power))
        _POWERS[size] = (made[0], made[1])
    return _POWERS[size]


class Hashes:
    """Hashes of all substrings of a text, from running sums."""

    def __init__(self, codes: np.ndarray):
        forward, self._back = _powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(_mixed(codes) * forward[: len(codes)], out=sums[1:])
        self._sums = sums

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        h = (self._sums[stop] - self._sums[start]) * self._back[start]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(28)) ^ (stop - start).astype(np.uint64)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts: (index of the text, position, hash of the gram, hash of the stretch, its length).

    In any ``span`` consecutive characters at least one anchor is chosen, by their content alone. The stretch around an
    anchor at p reaches from p - (span - gram) to p + span, cut at the ends of the text. Texts shorter than ``span``
    have none. Long texts are worked off in overlapping slices, so memory doesn't follow the longest text.
    """
    width = span - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    piece: list[tuple[int, int, str, bool]] = []  # text, offset, slice, whether the text ends with it
    held = 0

    def flush() -> None:
        nonlocal held
        if not piece:
            return
        codes = np.frombuffer("".join(p[2] for p in piece).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(p[2]) for p in piece])
        first = np.concatenate([[0], np.cumsum(sizes)])
        hashes = Hashes(codes)
        at = np.arange(len(codes) - gram + 1)
        order = (hashes.of(at, at + gram) >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - at.astype(np.uint64))
        least = _window_min(order, width)
        owner = np.repeat(np.arange(len(piece)), sizes)
        start = np.arange(len(least))
        inside = owner[start] == owner[start + span - 1]
        where = np.unique(np.uint64((1 << 24) - 1) - (least[inside] & np.uint64((1 << 24) - 1))).astype(np.int64)
        whose = owner[where]
        low, high = np.maximum(where - (span - gram), first[whose]), np.minimum(where + span, first[whose + 1])
        texts_of, offsets, ends = (np.array([p[k] for p in piece]) for k in (0, 1, 3))
        # a stretch that only the slice cuts lies whole in the next or last slice
        whole = ((offsets[whose] == 0) | (where - first[whose] >= span - gram)) & (ends[whose] | (where + span <= first[whose + 1]))
        where, whose, low, high = where[whole], whose[whole], low[whole], high[whole]
        out.append((texts_of[whose], where - first[whose] + offsets[whose], hashes.of(where, where + gram), hashes.of(low, high), high - low))
        piece.clear()
        held = 0

    for i, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        if len(text) <= _CHUNK:
            parts = [(0, text)]
        else:  # slices overlap so that each stretch that one of them cuts lies whole in another
            parts = [(o, text[o : o + _CHUNK]) for o in range(0, len(text) - span + 1, _CHUNK - 4 * span)]
        for offset, part in parts:
            if held + len(part) > 2 * _CHUNK:
                flush()
            piece.append((i, offset, part, offset + len(part) == len(text)))
            held += len(part)
    flush()
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixAutomaton:
    """Automaton of all substrings of several texts; states are classes of substrings with the same ends."""

    def __init__(self) -> None:
        self.go: list[dict[str, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _copy(self, of: int, length: int) -> int:
        self.go.append(self.go[of].copy())
        self.link.append(self.link[of])
        self.length.append(length)
        return len(self.go) - 1

    def _redirect(self, state: int, char: str, old: int, new: int) -> None:
        go, link = self.go, self.link
        while state != -1 and go[state].get(char) == old:
            go[state][char] = new
            state = link[state]

    def add(self, text: str) -> None:
        go, link, length = self.go, self.link, self.length
        last = 0
        for char in text:
            known = go[last].get(char)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                else:
                    new = self._copy(known, length[last] + 1)
                    self._redirect(last, char, known, new)
                    link[known] = new
                    last = new
                continue
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            here, state = len(go) - 1, last
            while state != -1 and char not in go[state]:
                go[state][char] = here
                state = link[state]
            if state != -1:
                known = go[state][char]
                if length[known] == length[state] + 1:
                    link[here] = known
                else:
                    new = self._copy(known, length[state] + 1)
                    self._redirect(state, char, known, new)
                    link[known] = link[here] = new
            last = here

    def matching(self, text: str) -> Iterator[tuple[int, int]]:
        """Matching statistics: after each character, the state and the length of the longest suffix that occurs."""
        go, link, length = self.go, self.link, self.length
        state = matched = 0
        for char in text:
            step = go[state].get(char)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = go[state].get(char)
            if step is None:
                matched = 0
            else:
                state = step
                matched += 1
            yield state, matched


def shared_classes(texts: list[str], span: int) -> dict[frozenset[int], dict[int, list[list[int]]]]:
    """Sets of texts that share spans of ``span`` characters, with the intervals [start, stop) that those cover in each."""
    automaton = SuffixAutomaton()
    for text in texts:
        automaton.add(text)
    link, length = automaton.link, automaton.length
    top: dict[int, int] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for i, text in enumerate(texts):
        for stop, (state, matched) in enumerate(automaton.matching(text), 1):
            if matched >= span:
                kind = top.get(state)
                if kind is None:
                    kind = state
                    while length[link[kind]] >= span:
                        kind = link[kind]
                    top[state] = kind
                ends.setdefault(kind, []).append((i, stop))
    out: dict[frozenset[int], dict[int, list[list[int]]]] = {}
    for found in ends.values():
        cover = out.setdefault(frozenset(i for i, _ in found), {})
        for i, stop in found:
            intervals = cover.setdefault(i, [])
            intervals.append([stop - span, stop])
    for cover in out.values():
        for i, intervals in cover.items():
            intervals.sort()
            merged = intervals[:1]
            for start, stop in intervals[1:]:
                if start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], stop)
                else:
                    merged.append([start, stop])
            cover[i] = merged
    return out


def _anchor_rows(span: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whose, where, anchor, stretch, size = anchors(list(batch["text"]), span, gram)
            if len(whose):
                kind = batch["kind"].to_numpy()[whose]
                salted = anchor ^ (kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))  # tables don't mix
                yield pd.DataFrame({"anchor": salted.view(np.int64), "kind": kind, "id": batch["id"].to_numpy()[whose], "file": batch["file"].to_numpy()[whose], "pos": where.astype(np.int32), "stretch": stretch.view(np.int64), "size": size.astype(np.int32)})

    return run


_CLASSES = "anchor long, stretch long, class long, start int, stop int"


def _class_rows(span: int):
    def solve(anchor: int, rows: list[tuple[int, str]]) -> Iterator[tuple[int, int, int, int, int]]:
        if len(rows) == 1:  # copies of one stretch; the automaton of a single text matches it from end to end
            yield anchor, rows[0][0], hash((anchor, rows[0][0])), 0, len(rows[0][1])
            return
        for members, cover in shared_classes([text for _, text in rows], span).items():
            name = hash((anchor, *sorted(rows[i][0] for i in members)))
            for i, intervals in cover.items():
                for start, stop in intervals:
                    yield anchor, rows[i][0], name, start, stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int, int, int]] = []
        names = [c.split()[0] for c in _CLASSES.split(", ")]
        now, rows = None, []
        for batch in batches:
            for anchor, stretch, text in zip(batch["anchor"].tolist(), batch["stretch"].tolist(), batch["text"], strict=True):
                if anchor != now and rows:
                    out.extend(solve(now, rows))
                    rows = []
                    if len(out) > 20_000:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                now = anchor
                rows.append((stretch, text))
        if rows:
            out.extend(solve(now, rows))
        if out:
            yield pd.DataFrame(out, columns=names)

    return run


def _gram_rows(span: int):
    """For overfull shards: each span of exactly ``span`` characters is a class of its own, named by its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for anchor, stretch, text in zip(batch["anchor"].tolist(), batch["stretch"].tolist(), batch["text"], strict=True):
                if len(text) >= span:
                    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                    start = np.arange(len(codes) - span + 1)
                    name = Hashes(codes).of(start, start + span).view(np.int64) ^ np.int64(anchor)
                    yield pd.DataFrame({"anchor": anchor, "stretch": stretch, "class": name, "start": start.astype(np.int32), "stop": (start + span).astype(np.int32)})

    return run


def shared_spans(records: DataFrame, span: int = SPAN, gram: int = GRAM, shard_stretches: int = SHARD_STRETCHES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Classes of records that share a span: class, kind, id, file, start, stop (characters of the record, stop excluded).

    ``records`` has kind (a number; only records of one kind are compared), id (long), file (long; a class counts only
    if records of two files are in it) and text. Records of one class all share a stretch of ``span`` characters; every
    two records of different files that share one are in some class together. Null and short texts are in none;
    repeated rows change nothing; empty input gives an empty result. The result is checkpointed.
    """
    cut = records.select("kind", "id", "file", "text").where(F.length("text") >= span)
    found = cut_lineage(spread(cut, "kind", "id").mapInPandas(_anchor_rows(span, gram), "anchor long, kind int, id long, file long, pos int, stretch long, size int"))
    shared = found.groupBy("anchor").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").select("anchor")
    hits = cut_lineage(found.join(small_side(cut_lineage(shared), broadcast_rows), "anchor").distinct())
    stretches = hits.groupBy("anchor", "stretch").agg(F.min(F.struct("kind", "id", "pos", "size")).alias("r"), F.min("file").alias("a"), F.max("file").alias("b"))
    stretches = cut_lineage(stretches.select("anchor", "stretch", "r.*", "a", "b"))
    # counted before the join, so the stretches of a hot anchor (what follows one licence header) don't meet in a task
    shards = stretches.groupBy("anchor").agg(F.count("*").alias("shard"))
    stretches = split_join(shards, stretches, ["anchor"])
    # a stretch alone in its shard needs no text: its records are copies of each other there
    alone = stretches.where(f"shard = 1 and size >= {span} and a <> b").select("anchor", "stretch", F.xxhash64("anchor", "stretch").alias("class"), F.lit(0).alias("start"), F.col("size").alias("stop"))
    wanted = cut_lineage(stretches.where("shard > 1").select("anchor", "stretch", "kind", "id", "pos", "shard"))
    texts = cut.join(small_side(wanted, broadcast_rows), ["kind", "id"]).select("anchor", "stretch", "shard", F.substring("text", F.greatest(F.col("pos") - (span - gram), F.lit(0)) + 1, F.col("pos") + span - F.greatest(F.col("pos") - (span - gram), F.lit(0))).alias("text")).dropDuplicates(["anchor", "stretch"])
    texts = cut_lineage(texts)
    normal = texts.where(F.col("shard") <= shard_stretches).repartition("anchor").sortWithinPartitions("anchor", "stretch").select("anchor", "stretch", "text").mapInPandas(_class_rows(span), _CLASSES)
    overfull = texts.where(F.col("shard") > shard_stretches).select("anchor", "stretch", "text").mapInPandas(_gram_rows(span), _CLASSES)
    classes = alone.unionByName(normal).unionByName(overfull)
    low = F.greatest(F.col("pos") - (span - gram), F.lit(0))
    placed = hits.join(classes, ["anchor", "stretch"]).select("class", "kind", "id", "file", (low + F.col("start")).alias("start"), (low + F.col("stop")).alias("stop"))
    placed = cut_lineage(placed)
    across = placed.groupBy("class").agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").select("class")
    return placed.join(across, "class", "left_semi")


def linked_pairs(spans: DataFrame) -> DataFrame:
    """Pairs (kind, id_a, id_b) with id_a < id_b of records from different files that share a span, from shared_spans().

    Classes with the same members are expanded once, large ones by parts in many tasks. The result has a row for every pair, as asked of p2_found; in a
    group of copies these are many by nature, and only this last step grows so.
    """
    members = cut_lineage(spans.select("class", "kind", "id", "file").distinct())
    key = F.xxhash64("kind", "id")
    sets = members.groupBy("class").agg(F.count("*").alias("n"), F.sum(key.cast("decimal(38,0)")).alias("s"), F.bit_xor(key).alias("x"))
    once = sets.groupBy("n", "s", "x").agg(F.min("class").alias("class")).select("class")
    kept = members.join(once, "class", "left_semi")
    a = kept.select("class", "kind", F.col("id").alias("id_a"), F.col("file").alias("file_a"))
    b = kept.select("class", F.col("id").alias("id_b"), F.col("file").alias("file_b"))
    return split_join(a, b, ["class"], CLASS_PART).where("id_a < id_b and file_a <> file_b").select("kind", "id_a", "id_b").distinct()


def shared_characters(spans: DataFrame) -> DataFrame:
    """Per record (kind, id): number of its characters inside spans that another file also has, and of such stretches."""
    return _islands(spans).groupBy("kind", "id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"), F.count("*").alias("shared_stretches"))


def _islands(spans: DataFrame) -> DataFrame:
    """The merged stretches of each record (kind, id) that other files also have: start, stop; touching ones are one."""
    parts = spans.select("kind", "id", "start", "stop").distinct()
    by = W.partitionBy("kind", "id").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    opens = parts.withColumn("opens", (before.isNull() | (F.col("start") > before)).cast("int"))
    marked = opens.withColumn("island", F.sum("opens").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("kind", "id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def without_shared(records: DataFrame, spans: DataFrame) -> DataFrame:
    """The texts of the records that share spans with those taken out: kind, id, text, removed (characters).

    Every maximal stretch that another file also has goes, in all its places; records that share nothing are not in the
    result. A record's stretches are a list no longer than its text allows; repeated rows of a record count once.
    """
    lists = _islands(spans).groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cut"))
    texts = records.where("text is not null").groupBy("kind", "id").agg(F.first("text").alias("text"))
    left = F.expr("""concat_ws('', transform(sequence(0, size(cut)), k ->
        substring(text, if(k = 0, 0, cut[k - 1].stop) + 1, if(k = size(cut), length(text), cut[k].start) - if(k = 0, 0, cut[k - 1].stop))))""")
    removed = F.aggregate("cut", F.lit(0), lambda a, x: a + x["stop"] - x["start"])
    return texts.join(lists, ["kind", "id"]).select("kind", "id", left.alias("text"), removed.alias("removed"))
