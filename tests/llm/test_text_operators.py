"""Files, documentation, packing, mixing and truncation on small cases and by their defining properties."""

import numpy as np
import pytest
from symbolstrata.llm import catalog, docpairs, handwritten, mixing, packing, sizes, truncation

FILE = "repo_id string, path string, content string, kind string, sign string"


def test_files_by_their_own_signs(spark):
    getter = "".join(f"def get_{a}(o):\n    return o._f[{i}].{a}\n\n" for i, a in enumerate(["ab", "cd", "ef", "gh", "ij", "kl"]))
    hand = "import os\n\ndef run(a, b):\n    total = a + b\n    for x in range(total):\n        print(x, 'code generated by me')\n    return os.sep\n# reads the generated files; it is not generated itself\n"
    lib = "def align(rows, width):\n    out = []\n    for row in rows:\n        out.append(row.ljust(width))\n    return out\n\ndef fold(text, size):\n    while len(text) > size:\n        yield text[:size]\n        text = text[size:]\n"
    rows = [
        ("r1", "a.py", "# Code generated by x. DO NOT EDIT.\n" + hand), ("r1", "b.py", getter), ("r1", "vendor/c.py", hand), ("r1", "min.js", "function a(b){" + "b?c(d):e;" * 40 + "}"),
        ("r1", "data.py", "T = [\n" + "    1, 2, 3, 0xff,\n" * 40 + "]\n"), ("r1", "l.py", lib), ("r2", "m.py", "\r\n# moved\r\n" + lib.replace("\n", "\r\n")), ("r3", "n.py", lib), ("r1", "a.py", "# Code generated by x. DO NOT EDIT.\n" + hand),
        ("r1", "up.py", "# Upstream: thing, release 1.2.3\n" + lib.replace("row", "cell")), ("r2", "up2.py", "# Upstream: thing, release 1.2.3\n" + lib.replace("row", "cell")), ("r1", "own.py", lib.replace("text", "line")), ("r2", "own2.py", lib.replace("text", "line")), ("r1", "null.py", None), ("r1", "empty.py", ""), (None, None, "x = 1"), ("r4", "two.py", hand + "x = [1, 2]\n" + "y" * 300),
    ]
    got = handwritten.judge_files(spark.createDataFrame([(*r, "clash", "clash") for r in rows], FILE))
    kinds = {r["path"]: r["kind"] for r in got.collect()}
    assert got.count() == len({r[:2] for r in rows})
    assert kinds == {"a.py": "generated", "b.py": "generated", "vendor/c.py": None, "min.js": "minified", "data.py": "data", "l.py": "vendored", "m.py": "vendored", "n.py": "vendored", "up.py": "vendored", "up2.py": "vendored", "own.py": None, "own2.py": None, "null.py": None, "empty.py": None, None: None, "two.py": None}
    assert handwritten.not_handwritten(spark.createDataFrame([], FILE)).count() == 0


SAYS = [
    ("Turns rows into one grid.", "f", True), ("Run. TODO tune the limit, but for now it spreads each edge.", "run", True), ("Parses it!", "parse", False), ("TODO", "f", False), ("FIXME: add docs", "f", False), ("See above.", "f", False),
    ("{@inheritDoc}", "f", False), ("noqa: E501", "f", False), ("@param a @returns", "f", False), (":param a:\n:return:", "f", False), ("x = g(y, 1);", "f", False), ("-----", "f", False), ("Auto generated method stub", "f", False),
    ("The map basin function.", "mapBasin", False), ("Indexs the palette marker.", "indexPaletteMarker", False), (None, "f", False), ("  ", "f", False), ("Retries until the lock is free.", None, True), ("Mapbasin. Keeps at most 3 entries.", "mapBasin", True),
]


@pytest.mark.parametrize(("text", "name", "says"), SAYS)
def test_descriptions(text, name, says):
    assert docpairs.says_something(text, name, ["a", None]) is says


def test_pairs(spark):
    py = "class A:\n    '''Holds the open rows of a run.'''\n    # Drops rows that nobody asked for.\n    @cached\n    def one(self):\n        # not this comment, inside\n        return 1\n\n    # Keeps the order of arrival.\n\n    def two(self):\n        return 2\n\ndef three(\n    a,\n):\n    \"\"\"Waits for the\n    next free slot.\"\"\"\n    return a\n"
    java = "/**\n * Moves the cursor to the next page.\n * @param x\n */\n@Override\npublic int go(int x) {\n    return \"}\".length();\n}\n"
    files = spark.createDataFrame([("r", "a.py", py, "clash"), ("r", "a.py", py, "clash"), ("r", "b.java", java, "clash"), ("r", "n.py", None, "clash")], "repo_id string, path string, content string, code string")
    S = "sym_id long, repo_id string, path string, name string, type string, line int, doc string, params array<string>, description string"
    symbols = spark.createDataFrame([(1, "r", "a.py", "one", "method", 5, None, [], ""), (2, "r", "a.py", "two", "method", 11, None, None, ""), (3, "r", "a.py", "three", "function", 14, "three", [], ""), (4, "r", "b.java", "go", "method", 6, None, ["x"], ""), (5, "r", "n.py", "five", "function", 1, "Counts the open files.", [], ""), (6, "r", "a.py", "A", "class", 1, "Holds the rows.", [], ""), (7, None, None, None, "function", None, None, None, ""), (5, "r", "n.py", "five", "function", 1, "Counts the open files.", [], "")], S)
    bodies = spark.createDataFrame([(8, "r", "z.py", "eight", "function", "\n\ndef eight():\n    'Sorts the pages by size.'\n"), (9, "r", "z.py", "nine", "function", None)], "sym_id long, repo_id string, path string, name string, type string, body string")
    assert {r[0] for r in docpairs.described_symbols(symbols, bodies, files).collect()} == {1, 3, 4, 5, 8}
    got = {r["sym_id"]: (r["description"], r["code"]) for r in docpairs.code_description_pairs(symbols, bodies, files).collect()}
    assert got[4] == ("Moves the cursor to the next page.\n@param x", "public int go(int x) {\n    return \"}\".length();\n}")
    assert got[3][0] == "Waits for the\nnext free slot." and got[3][1].startswith("def three(") and got[3][1].endswith("return a")
    none = spark.createDataFrame([], S)
    assert docpairs.described_symbols(none, bodies.limit(0), files.limit(0)).count() == 0


def test_bodies_by_their_stacks():
    ruby = "class A\n  # Adds up.\n  def add(a, b)\n    if a then\n      x = 'end'\n    end\n    items.each do |i|\n      puts i if i\n    end\n    a\n  end\n\n  def two()\n    2 # end\n  end\nend\n"
    script = "/* f(x) { */\nfunction a(x) {\n  const t = `}\n}`; // }\n  return '}';\n}\nconst b = (y) => y;\n"
    python = 'def f(\n    a,\n    b=(1,\n       2),\n):\n    s = """\nno end\n"""\n    return s\n\n\nx = 1\n'
    ends = lambda text, ext: [(n, i, docpairs.Source(text, ext).body_end(i)) for i, n in docpairs.Source(text, ext).declared()]
    assert ends(ruby, ".rb") == [("add", 2, 11), ("two", 12, 15)]
    assert ends(script, ".js") == [("a", 1, 6), ("b", 6, 7)]
    assert ends(python, ".py") == [("f", 0, 9)]
    assert docpairs.Source(ruby, ".rb").described(2) == "Adds up."
    long = "def g(\n" + "".join(f"    a{i},\n" for i in range(200)) + "):\n    '''Sums them.'''\n"
    assert docpairs.Source(long, ".py").described(0) == "Sums them."


def test_packing_keeps_every_token(spark, data):
    docs = spark.createDataFrame([(i, "word " * (i * 7 % 400 + 1), 1) for i in range(300)] + [(900, None, 1), (901, " \n", 1), (902, "x " * 9000, 1), (5, "again", 1)], "doc_id long, text string, block int")
    budgets = spark.createDataFrame([("s", 256), ("s", 256), ("l", 2048), ("bad", None), ("zero", 0)], "budget_name string, capacity_tokens int")
    out = packing.containers(docs, budgets, block_documents=100).toPandas()
    sized = sizes.with_tokens(docs, ["doc_id"]).toPandas()
    for name, cap in (("s", 256), ("l", 2048)):
        part = out[out.budget_name == name]
        assert part.groupby("container_id").piece_tokens.sum().max() <= cap
        assert part.piece_tokens.sum() == sized.tokens.sum()
        big = part[part.doc_id == 902].sort_values("piece")
        assert (big.piece_tokens.iloc[:-1] == cap).all() and (big.token_start == big.piece * cap).all()
        whole = part.groupby("doc_id").piece.max()
        assert all(whole[d] == 0 for d, t in zip(sized.doc_id, sized.tokens, strict=True) if 0 < t <= cap and d != 5)
    assert set(out.budget_name) == {"s", "l"}
    assert packing.containers(docs.limit(0), budgets).count() == 0
    fill = {r["budget_name"]: r["fill"] for r in packing.fill_report(packing.containers(docs, budgets)).collect()}
    assert fill["l"] > 0.9


def test_pack_is_tight_and_deterministic():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 600, 2000)
    a = packing.pack(n, 2048)
    assert (a == packing.pack(n, 2048)).all()
    used = np.bincount(a, weights=n)
    assert used.max() <= 2048 and len(used) <= np.ceil(n.sum() / 2048) * 1.01 + 1


def test_pivotal_keeps_sums_and_expectations():
    rng = np.random.default_rng(3)
    size, share = rng.integers(1, 500, 40).astype(float), rng.random(40)
    hits = np.zeros(40)
    for i in range(3000):
        out = mixing.pivotal(share, size, np.random.default_rng(i))
        open_ = [x for x in out if 1e-9 < x < 1 - 1e-9]
        assert len(open_) <= 1 and abs((out * size).sum() - (share * size).sum()) < 1e-6
        hits += out
    assert np.abs(hits / 3000 - share).max() < 0.05


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i % 50), s, 9) for i, s in enumerate([" Wiki "] * 300 + ["issues"] * 900 + ["ADR"] * 6 + ["other"] * 40 + [None] * 5)] + [(5000, None, "wiki", 9), (5001, "", "wiki", 9)], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("wiki", 0.5, 2), ("issues", 0.4, 1), ("adr", 0.1, 3), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    for total, fan in ((None, 50), (60_000, 10_000)):
        copies, report = mixing.mix(docs, targets, total, fan=fan)
        c = copies.toPandas()
        cap = {"wiki": 2, "issues": 1, "adr": 3}
        assert c.doc_id.is_unique and set(c.source) <= set(cap) and all(x <= cap[s] for s, x in zip(c.source, c.copies, strict=True))
        r = report.toPandas().set_index("source")
        assert abs(r.actual_share.sum() - 1) < 1e-4 and r.loc["none", "mixed_tokens"] == 0 and not r.loc["none", "met"]
        near = 69 / r.mixed_tokens.sum()  # the longest document
        assert all(m == (t > 0 and abs(a - g) <= near) for a, g, t, m in zip(r.actual_share, r.target_share, r.mixed_tokens, r.met, strict=True))
        if total is None:
            assert all(abs(r.loc[s, "actual_share"] - t) < 0.03 for s, t in (("wiki", 0.5), ("issues", 0.4), ("adr", 0.1)))
        else:
            assert not r.loc["adr", "met"] and r.loc["adr", "most_copies"] == 3
    everything = mixing.mix(docs, targets, "all")[1].toPandas().set_index("source")
    assert everything.loc["adr", "mixed_tokens"] == 3 * everything.loc["adr", "tokens"] and everything.goal_tokens.sum() >= everything.tokens.sum()
    copies, report = mixing.mix(docs.limit(0), targets)
    assert copies.count() == 0 and report.count() == 4


def test_long_generated_files_need_no_statement(spark):
    rows = [("r1", "g.py", "".join(f"def get_{'abcdefgh'[i % 8]}{i}(o):\n    return o._f[{i}].v{i}\n\n" for i in range(60)))]
    kinds = {r["path"]: r["kind"] for r in handwritten.judge_files(spark.createDataFrame(rows, "repo_id string, path string, content string")).collect()}
    assert kinds == {"g.py": "generated"}


def test_prefixes_of_any_length_by_brute_force(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "al", "alphabet", "be", "beta", "gamma"]
    values = sorted({v[: rng.randint(2, len(v))] for v in (" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(800))})
    inside = lambda v, w: v[-1].isalnum() and w[len(v)].isalnum()
    want = {i for i, v in enumerate(values) for w in values if w != v and w.startswith(v) and (len(v) >= truncation.SHORT or inside(v, w))}
    df = spark.createDataFrame(list(enumerate(values)), "key long, value string").repartition(5)
    assert {r[0] for r in truncation.strict_prefixes(df).collect()} == want
    assert {r[0] for r in truncation.strict_prefixes(df, range_key=8, long_key=30, hot_prefix=20).collect()} == want


def test_truncation(spark):
    words = ["pump", "valve", "gate", "wheel", "lamp", "rope", "crate", "shelf"]
    full = [f"The {a} holds the {b} until the {c} is read. Nothing depends on the order of the {a}s, except the {b}.\n\nFixes #12" for a in words for b in words for c in words[:3]]
    docs = list(enumerate(full))
    cut = {1000: "The pump holds the valve until the ga", 1001: "The lamp holds the rope until the crate is read. Nothing depends on the", 1002: "The gate holds the shelf until ...", 1003: full[7][:60] + "…", 1004: full[9][:49], 1005: "The rope holds the gate until the lamp is read.\n\n```\nx = 1"}
    whole = {2000: "The lamp holds the pump until the gate is read.", 2001: "Nothing depends on the order of the ropes, except the lamp.\n\nFixes #12", 2002: None, 2003: " ", 2004: full[0]}
    rows = docs + list(cut.items()) + list(whole.items())
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, source string, key int").repartition(6)
    got = {r["doc_id"] for r in truncation.cut_documents(df).collect()}
    assert got == set(cut) | ({2000} & got)  # 2000 is by chance no prefix of another
    assert truncation.cut_documents(df.limit(0)).count() == 0
    share = truncation.cut_share_by_source(df).collect()
    assert [(r["source"], r["documents"]) for r in share] == [("a", len(rows))]


def test_same_cut_in_several_texts_is_no_closing(spark):
    """A sentence cut at one place in three texts goes on in the others; a closing that stands in three texts never does."""
    whole = [(i, f"Case {i} is open. Please split this method: the part that reads item number {i} has nothing to do with part {i + 1}.\n\n-- the amber tooling group") for i in range(200)]
    cut = [(1000 + i, f"Case {i} is closed. Please split this method: the part that rea") for i in range(3)]
    short = [(2000 + i, f"Case {i} is closed. Please split this method") for i in range(3)]
    df = spark.createDataFrame(whole + cut + short, "doc_id long, text string")
    assert {r["doc_id"] for r in truncation.cut_documents(df).collect()} == {1000, 1001, 1002, 2000, 2001, 2002}


@pytest.mark.parametrize("n", [3, 30, 300])
def test_fragment_of_a_word_is_no_closing_however_often_it_recurs(spark, n):
    """Three sentences cut inside a word in n texts each; a closing that recurs as often stays one, though its last word has a plural."""
    whole = [(i, f"Case {i} is open. Drain the valve of part {i} first. The amber tooling groups of part {i} meet at noon.\n\n-- the amber tooling group") for i in range(100 + n)]
    cut = [(10_000 * k + i, f"Case {i} is closed by step {k}.\n\n{end}") for i in range(n) for k, end in enumerate(("Drain the val", "D", "The amber tooling groups of pa"), 1)]
    df = spark.createDataFrame(whole + cut, "doc_id long, text string")
    assert {r["doc_id"] for r in truncation.cut_documents(df).collect()} == {i for i, _ in cut}


def test_copies_of_a_cut_text_do_not_vouch_for_each_other(spark):
    """50 copies of texts cut inside a word, behind a word and with a mark are found, as one of them is; copies of whole texts are not."""
    whole = [(i, f"Case {i} is open. Please drain the valve of part number {i} and then close the gate behind it.\n\n-- the amber tooling group") for i in range(60)]
    cut = ["The case is closed.\n\nPlease drain the valve of part num", "The case was closed early. Please drain the valve of part number 7 and then close", "Nobody knows.\n\nUnlike the qua"]
    copies = [(1000 + 100 * k + i, text + (" …" if i % 2 else "")) for k, text in enumerate(cut) for i in range(50)] + [(5000 + i, whole[0][1]) for i in range(50)]
    schema = "doc_id long, text string"
    assert {r["doc_id"] for r in truncation.cut_documents(spark.createDataFrame(whole + copies[:150:50], schema)).collect()} == {1000, 1100, 1200}
    assert {r["doc_id"] for r in truncation.cut_documents(spark.createDataFrame(whole + copies, schema)).collect()} == set(range(1000, 1050)) | set(range(1100, 1150)) | set(range(1200, 1250))


def test_prefixes_across_partitions(spark):
    texts = [f"{i:03d} " + "long enough to be looked up as a prefix " * 2 for i in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " and more") for i, t in enumerate(texts[:20])] + [(200, texts[3])], "doc_id long, text string").repartition(8)
    assert {r[0] for r in truncation.prefixes_of_others(df).collect()} == {*range(20), 200}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_queries_run(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0
