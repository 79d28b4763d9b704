"""Orphan references against a brute-force search, with nulls, repeats, hot keys and empty tables."""

import datetime as dt

from symbolstrata.operators import references as R

T = [dt.datetime(2025, 1, d) for d in range(1, 12)]
SYMBOLS = "sym_id long, repo_id string, path string, name string, calls array<string>, indexed_at timestamp, loaded_at timestamp, removed_at timestamp, key string, t int"
CALLS = "call_id long, repo_id string, path string, dst string, indexed_at timestamp, loaded_at timestamp, alive int"
DEPS = "dep_id long, repo_id string, src_path string, dst_path string, indexed_at timestamp, loaded_at timestamp"
FILES = "repo_id string, path string, loaded_at timestamp, removed_at timestamp"
BUILTIN = "ext string, name string"


def tables(spark, empty=False):
    symbols = [
        (1, "r", "a.py", "alive", ["gone", "len", "len", None, ""], T[0], T[5], None, "x", 1),
        (1, "r", "a.py", "alive", ["gone", "len", "len", None, ""], T[0], T[7], None, "x", 1),  # again, later
        (2, "r", "a.py", "gone", None, T[0], T[0], T[5], "x", 1),  # ends exactly when 1 arrives
        (3, "r", "a.py", "late", [], T[0], T[9], None, "x", 1),
        (4, None, "a.py", "alive", ["alive"], T[0], T[1], None, "x", 1),
        (5, "r", None, None, ["Owner.alive"], None, T[5], None, "x", 1),
        (6, "r", "b.py", "broken", [], T[0], T[3], T[2], "x", 1),  # gone before it came
    ]
    calls = [(10 + i, "r", "b.js", n, T[0], T[4], 1) for i, n in enumerate(["late", "x.gone", "len", None, "", "alive", "Alive", "nobody", "broken"])]
    calls += [(50, "r", "b.js", "alive", T[0], T[5], 1), (50, "r", "b.js", "alive", T[0], T[5], 1), (51, "other", "b.js", "alive", T[0], T[6], 1)]
    deps = [(70, "r", "q.py", "./src\\a.py", T[1], T[2]), (71, "r", "q.py", "src/b.py", T[1], T[2]), (72, "r", "q.py", None, T[1], T[2])]
    files = [("r", "src/a.py", T[2], None), (None, "src/b.py", T[0], None)]
    builtin = [(".py", "len"), (None, "x")]
    rows = lambda x: [] if empty else x
    make = spark.createDataFrame
    return [make(rows(symbols), SYMBOLS), make(rows(calls), CALLS), make(rows(deps), DEPS), make(rows(files), FILES), make(rows(builtin), BUILTIN)]


WANTED = {
    ("symbols", 1, "gone", "deleted"), ("symbols", 4, "alive", "missing"),
    ("calls", 10, "late", "late"), ("calls", 12, "len", "missing"), ("calls", 15, "alive", "late"), ("calls", 16, "Alive", "missing"), ("calls", 17, "nobody", "missing"), ("calls", 18, "broken", "missing"), ("calls", 51, "alive", "missing"),
    ("file_deps", 71, "src/b.py", "missing"),
}


def test_states(spark):
    got = R.classify_references(*tables(spark)).where("state <> 'present'").select("table_name", "row_id", "ref", "state")
    assert {tuple(r) for r in got.collect()} == WANTED
    assert got.count() == len(WANTED)


def test_orphans_are_those_and_splitting_hot_keys_changes_nothing(spark):
    for hot in (1, 1_000_000):
        got = R.orphan_references(*tables(spark), hot_rows=hot)
        assert sorted(tuple(r) for r in got.collect()) == sorted(w[:3] for w in WANTED)


def test_empty_and_months(spark):
    assert R.orphan_references(*tables(spark, empty=True)).count() == 0
    months = {tuple(r) for r in R.orphans_by_month(*tables(spark)).collect()}
    assert ("file_deps", "2025-01", "missing", 1) in months and sum(m[3] for m in months) == len(WANTED)
