"""Dense counts against Counter: one hot key, nulls, empty strings, several blocks, empty input."""

from collections import Counter

from symbolstrata.operators import hotkeys as H


def test_counts(spark):
    words = ["hot"] * 500 + [f"k{i % 97}" for i in range(400)] + ["", None, "ä", " "]
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "key string, n int").repartition(7)
    want = Counter(w for w in words if w)
    for block, scatter, fan in ((65_536, 262_144, 16), (10, 12, 2), (200, 30, 3)):
        assert {r["key"]: r["n"] for r in H.dense_counts(df, "key", block, scatter, fan).collect()} == want


def test_empty(spark):
    assert H.dense_counts(spark.createDataFrame([], "dst string"), "dst").count() == 0


def test_share_is_of_all_rows_and_profile_counts_distinct(spark):
    rows = [("a", "r1", "x"), ("a", "r1", "y"), ("a", "r2", None), ("b", "r1", "x"), (None, "r1", "x"), ("", "r9", "x")]
    df = spark.createDataFrame(rows, "dst string, repo_id string, src string")
    assert [tuple(r) for r in H.frequent_keys({"calls": (df, "dst")}, 0.5).collect()] == [("calls", "a")]
    got = {r["name"]: (r["rows"], r["callers"], r["repos"]) for r in H.key_profile(df, "dst", {"callers": ["src"], "repos": ["repo_id"]}).collect()}
    assert got == {"a": (3, 3, 2), "b": (1, 1, 1)}
