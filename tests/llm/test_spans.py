"""Shared spans against brute force; the automaton against its definition; overfull shards and long texts."""

import random

import pytest
from symbolstrata.llm import spans as S

SCHEMA = "kind int, id long, file long, text string, anchor string, size int"


def brute(records, span):
    grams = {}
    for kind, key, file, text in records:
        for i in range(len(text or "") - span + 1):
            grams.setdefault((kind, text[i : i + span]), set()).add((key, file))
    pairs = {(kind, a[0], b[0]) for (kind, _), held in grams.items() for a in held for b in held if a[0] < b[0] and a[1] != b[1]}
    chars = {}
    for kind, key, file, text in records:
        covered = set()
        for i in range(len(text or "") - span + 1):
            if {f for _, f in grams[kind, text[i : i + span]]} - {file}:
                covered |= set(range(i, i + span))
        if covered:
            chars[kind, key] = len(covered)
    return pairs, chars


def corpus(seed):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("ab \n{}xyz=ü") for _ in range(n))
    shared = [draw(rng.randint(18, 70)) for _ in range(6)] + ["=" * 60, "ab" * 40]
    records = []
    for i in range(60):
        parts = [draw(rng.randint(0, 40)), rng.choice(shared)[rng.randint(0, 4) :], draw(rng.randint(0, 40)), rng.choice(shared)]
        records.append((i % 2, i, rng.randint(0, 20), "".join(parts)))
    records += [(0, 100, 1, None), (0, 101, 2, ""), (0, 102, 3, "short"), records[0], records[5]]
    return records


@pytest.mark.parametrize("shard", [2_000, 1])
def test_pairs_and_characters(spark, shard):
    records = corpus(shard)
    df = spark.createDataFrame([(*r, "clash", 1) for r in records], SCHEMA).repartition(5)
    found = S.shared_spans(df, span=20, gram=9, shard_stretches=shard)
    pairs, chars = brute(records, 20)
    got = [tuple(r) for r in S.linked_pairs(found).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and pairs
    assert {(r["kind"], r["id"]): r["shared_chars"] for r in S.shared_characters(found).collect()} == chars


def test_what_is_left(spark):
    records = corpus(7)
    df = spark.createDataFrame([(*r, "clash", 1) for r in records], SCHEMA)
    found = S.shared_spans(df, span=20, gram=9)
    left = {(r["kind"], r["id"]): r for r in S.without_shared(df, found).collect()}
    assert {k: r["removed"] for k, r in left.items()} == brute(records, 20)[1]
    texts = {r[:2]: r[3] for r in records}
    assert all(len(r["text"]) == len(texts[k]) - r["removed"] for k, r in left.items())
    assert S.without_shared(df.limit(0), found).count() == 0


def test_large_classes_are_expanded_by_parts(spark, monkeypatch):
    records = corpus(5)
    df = spark.createDataFrame([(*r, "clash", 1) for r in records], SCHEMA)
    monkeypatch.setattr(S, "CLASS_PART", 2)
    assert {tuple(r) for r in S.linked_pairs(S.shared_spans(df, span=20, gram=9)).collect()} == brute(records, 20)[0]


def test_shuffled_instead_of_broadcast(spark):
    records = corpus(9)
    df = spark.createDataFrame([(*r, "clash", 1) for r in records], SCHEMA)
    found = S.shared_spans(df, span=20, gram=9, broadcast_rows=0)
    assert {tuple(r) for r in S.linked_pairs(found).collect()} == brute(records, 20)[0]


def test_empty(spark):
    found = S.shared_spans(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and S.linked_pairs(found).count() == 0


def test_automaton():
    rng = random.Random(1)
    for _ in range(20):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(4)]
        automaton = S.SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        query = "".join(rng.choice("abc") for _ in range(20))
        for i, (_, n) in enumerate(automaton.matching(query), 1):
            assert n == max(k for k in range(i + 1) if any(query[i - k : i] in t for t in texts))


def test_slices_of_long_texts_keep_every_anchor(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdef \n") for _ in range(5000))
    whole = S.anchors([text], 20, 9)
    monkeypatch.setattr(S, "_CHUNK", 300)
    cut = S.anchors([text], 20, 9)
    assert {tuple(x) for x in zip(*[a.tolist() for a in cut])} == {tuple(x) for x in zip(*[a.tolist() for a in whole])}
