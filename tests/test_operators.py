"""Operators on small authored tables: what SQL on the given tables doesn't reach."""

import difflib
import itertools
import random

from pyspark.sql import functions as F

from symbolstrata.functions.text import sequence_ratio
from symbolstrata.operators import diff, extract, filters, frameworks, graph, profile, quality, resolve, search
from symbolstrata.sources import manifests, tree
from symbolstrata.streaming import watch


def rows(df):
    return {tuple(r) for r in df.collect()}


def edges(spark, pairs):
    return spark.createDataFrame([("r", a, b) for a, b in pairs], "repo_id string, src string, dst string")


def test_cycles_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(3):
        nodes = "abcdef"
        pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(14)}
        want = set()
        for k in range(1, 6):
            for p in itertools.permutations(nodes, k):
                if p[0] == min(p) and all((a, b) in pairs for a, b in zip(p, p[1:] + p[:1])):
                    want.add(p)
        got = graph.cycles(edges(spark, pairs), 5)
        assert {tuple(r["path"]) for r in got.collect()} == want and got.count() == len(want)


def test_components_hold_cycles_of_every_length(spark):
    ring = [(f"n{i:02d}", f"n{(i + 1) % 15:02d}") for i in range(15)]  # too long for cycles()
    e = edges(spark, [*ring, ("n03", "tail"), ("head", "n05"), ("p", "q"), ("q", "p"), ("n00", "p"), ("s", "s"), ("x", "y"), ("q", "a"), ("a", "u"), ("u", "v"), ("v", "u")])
    got = rows(graph.cycle_components(e))
    assert got == {("r", a, "n00", 15) for a, _ in ring} | {("r", "p", "p", 2), ("r", "q", "p", 2), ("r", "u", "u", 2), ("r", "v", "u", 2), ("r", "s", "s", 1)}
    assert {tuple(r["path"]) for r in graph.cycles(e).collect()} == {("p", "q"), ("u", "v"), ("s",)}


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    nodes = [f"{i:02d}" for i in range(24)]
    pairs = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(34)}
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in pairs if b == c} - reach:
        reach |= more
    mutual = {a: {b for b in nodes if (a, b) in reach and (b, a) in reach} for a in nodes}
    assert rows(graph.cycle_components(edges(spark, pairs))) == {("r", a, min(m), len(m)) for a, m in mutual.items() if m}


def test_trace_drops_what_does_not_end(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g"), ("b", "z")])
    got = graph.trace_paths(e, spark.createDataFrame([("r", "a"), ("r", "q")], "repo_id string, name string"), 5)
    assert {tuple(r["path"]) for r in got.collect()} == {("a", "b", "z")}  # a..f would go on to g


def test_graph_takes_nulls_and_nothing(spark):
    calls = spark.createDataFrame([("r", None, "b"), ("r", "a", None), (None, "a", "b"), ("r", "a", "b"), ("r", "a", "b")], "repo_id string, src string, dst string")
    assert rows(graph.call_edges(calls)) == {(None, "a", "b"), ("r", "a", "b")}
    none = edges(spark, [])
    assert graph.degrees(none).count() == graph.cycles(none).count() == graph.display_graph(none).count() == 0


FILES = "repo_id string, path string, content string, size_bytes long, text string, line int"


def files(spark, *items):
    return spark.createDataFrame([("r", p, c, len(c or ""), "clash", 7) for p, c in items], FILES)


def test_declarations_by_language(spark):
    f = files(
        spark, ("a.py", "class A(B):\r\n    async def go(self):\r\n        pass\r\ndef f(x): return x"), ("b.ts", "export default class B {}\nexport const g = async (x) => x\ninterface I {}\nexport async function h() {}"),
        ("C.java", "public final class C {\n    public static int run(int a) {\n}\n"), ("d.go", "func (s *S) Do(x int) {}\ntype S struct {\nfunc Main() {"), ("e.rs", "pub async fn go<T>(x: T) {\npub struct P {"),
        ("f.dart", "abstract class W {"), ("g.swift", "public func s() {\nfinal class K {"), ("n.py", None), ("m.py", ""),
    )
    got = {(r["path"], r["type"], r["name"]) for r in extract.declarations(f).collect()}
    assert got == {
        ("a.py", "class", "A"), ("a.py", "method", "go"), ("a.py", "function", "f"), ("b.ts", "class", "B"), ("b.ts", "function", "g"), ("b.ts", "interface", "I"), ("b.ts", "function", "h"),
        ("C.java", "class", "C"), ("C.java", "method", "run"), ("d.go", "method", "Do"), ("d.go", "type", "S"), ("d.go", "function", "Main"), ("e.rs", "function", "go"), ("e.rs", "class", "P"), ("f.dart", "class", "W"), ("g.swift", "function", "s"), ("g.swift", "class", "K"),
    }


def test_imports_routes_findings(spark):
    f = files(
        spark, ("pkg/a.py", "from .b import x, y as z  # note\nimport os.path\nfrom q import (one, two)\npassword = 'hunter22'\n# password = 'hunter22'\n@app.route('/p', methods=['POST'])\n@router.get('/q')"),
        ("s.js", "import D, { e as f, g } from './t'\napp.post('/x', h)\neval(x)"), ("S.java", "@GetMapping(\"/m\")"), ("test_u.py", "eval(x)"),
    )
    assert {(r["module"], r["imported"]) for r in extract.imports(f).collect()} == {(".b", "x y"), ("os.path", "path"), ("q", "one two"), ("./t", "D e g")}
    assert {(r["method"], r["route"]) for r in extract.routes(f).collect()} == {("POST", "/p"), ("GET", "/q"), ("POST", "/x"), ("GET", "/m")}
    assert {(r["path"], r["line"], r["category"]) for r in extract.findings(f).collect()} == {("pkg/a.py", 4, "secret"), ("s.js", 3, "unsafe_code")}


def test_resolution(spark):
    f = files(spark, ("pkg/a.py", "from .b import x\nfrom pkg.c import *\nimport nowhere"), ("pkg/b.py", ""), ("pkg/c/__init__.py", "z"), ("web/s.js", "import D from './t'"), ("web/t.js", ""))
    i = extract.imports(f)
    assert rows(resolve.file_dependencies(i, f)) == {("r", "pkg/a.py", "pkg/b.py"), ("r", "pkg/a.py", "pkg/c/__init__.py"), ("r", "web/s.js", "web/t.js")}
    s = spark.createDataFrame([("r", "pkg/b.py", "x", "function", 3, None), ("r", "pkg/c/__init__.py", "w", "class", 1, ""), ("r", "pkg/c/__init__.py", "m", "method", 2, "w")], "repo_id string, path string, name string, type string, line int, class_name string")
    assert rows(resolve.type_map(i, f, s)) == {("r", "pkg/a.py", "x", "pkg/b.py", "function", 3), ("r", "pkg/a.py", "w", "pkg/c/__init__.py", "class", 1)}
    assert rows(resolve.external_modules(i, f)) == {("r", "nowhere", 1)}


def test_ignore_rules(spark):
    f = files(spark, ("src/a.py", "x"), ("lib/a.py", "x"), ("src/x_pb2.py", "x"), ("tests/test_a.py", "x"), ("src/library.py", "x"), ("big.py", "x" * 2000), (None, "x"))
    ex = spark.createDataFrame([("r", "*_pb2.py"), ("r", None), ("q", "src")], "repo_id string, pattern string")
    got = {r["path"]: r["reason"] for r in filters.ignore_reasons(f, ex, max_bytes=1000).collect()}
    assert got == {"src/a.py": None, "lib/a.py": "default", "src/x_pb2.py": "excluded", "tests/test_a.py": "test", "src/library.py": None, "big.py": "too_large"}
    paths = spark.createDataFrame([("r", p) for p in ("a.log", "keep.log", "d/e/f.txt", "d/f.txt", "x/build/y", "build")], "repo_id string, path string")
    rules = spark.createDataFrame([("r", i, p) for i, p in enumerate(["*.log", "!keep.log", "d/**/f.txt", "build/", "# no", ""])], "repo_id string, ordinal int, pattern string")
    assert {p for _, p in rows(filters.gitignored(paths, rules))} == {"a.log", "d/e/f.txt", "d/f.txt", "x/build/y"}


def test_snapshots_and_hunks(spark):
    a = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "1"), ("r", "gone", "1"), ("r", "nul", None)], "repo_id string, path string, sha256 string")
    b = spark.createDataFrame([("r", "same", "1"), ("r", "mod", "2"), ("r", "new", "1"), ("r", "nul", None), ("r", "new", "1")], "repo_id string, path string, sha256 string")
    assert {(r["path"], r["change"]) for r in diff.file_changes(a, b).collect()} == {("same", "same"), ("mod", "modified"), ("gone", "removed"), ("new", "added"), ("nul", "same")}
    assert {r["path"] for r in diff.to_index(a, b).collect()} == {"mod", "new"}
    d = spark.createDataFrame([("r", "--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def\n+a\n@@ -9 +20 @@\n--- a/y\n+++ b/y\n@@ -0,0 +1,2 @@")], "repo_id string, diff string")
    assert rows(diff.parse_hunks(d)) == {("r", "x.py", 3, 7), ("r", "x.py", 20, 21), ("r", "y", 1, 3)}
    two = spark.createDataFrame([("r", "+++ b/x.py\n@@ -1 +1 @@\n@@ -5 +6,2 @@"), ("r", "+++ b/a b.py\r\n@@ -1 +3 @@\r\n@@ -9,2 +9,0 @@"), ("r", "+++ /dev/null\n@@ -1 +0,0 @@"), ("r", None), ("r", "@@ -1 +1 @@")], "repo_id string, diff string")
    assert rows(diff.parse_hunks(two)) == {("r", "x.py", 1, 2), ("r", "x.py", 6, 8), ("r", "a b.py", 3, 4), ("r", "a b.py", 9, 9), ("r", None, 1, 2)}
    assert rows(diff.changed_paths(spark.createDataFrame([("r", "./a\\b")], "repo_id string, path string"), spark.createDataFrame([("r", "a/b"), ("r", None)], "repo_id string, path string"))) == {("r", "a/b")}
    s = spark.createDataFrame([(1, "r", "x.py", "f", 7), (2, "r", "x.py", "g", 8), (3, "r", "y", "h", None)], "sym_id long, repo_id string, path string, name string, line int")
    assert {r["name"] for r in diff.changed_symbols(s, diff.parse_hunks(d)).collect()} == {"f"}


def test_manifests(spark):
    f = files(
        spark, ("package.json", '{"dependencies": {"a": "*", "b": "1.0"}, "devDependencies": {"c": "http://x"}}'), ("x/package.json", "{bad"), ("requirements.txt", "# c\nflask==1.0\nrequests\n-r o.txt\n"),
        ("pyproject.toml", '[project]\ndependencies = [\n  "numpy>=1",\n  "pandas",\n]\nname = "z"\n'), ("go.mod", "module m\nrequire (\n  github.com/a/b v1.2.3\n)"), ("Cargo.toml", '[package]\nname = "n"\n[dependencies]\nserde = "1"\nrand = { version = "0.8", features = [] }\n'),
    )
    deps = manifests.all_dependencies(f)
    assert {(r["name"], r["version"]) for r in deps.collect()} == {("a", "*"), ("b", "1.0"), ("c", "http://x"), ("flask", "==1.0"), ("requests", ""), ("numpy", ">=1"), ("pandas", ""), ("github.com/a/b", "v1.2.3"), ("serde", "1"), ("rand", "0.8")}
    assert {r["name"] for r in manifests.dependency_warnings(deps).collect()} == {"a", "c", "requests", "pandas"}


def test_tree_bundle_and_stream(spark, tmp_path):
    src = tmp_path / "tree"
    (src / "pkg").mkdir(parents=True)
    (src / "node_modules").mkdir()
    (src / "pkg/a.py").write_text("x = 1\n")
    (src / "pkg/bad.py").write_bytes(b"\xff\xfe\xff")
    (src / "node_modules/b.js").write_text("y")
    (src / "big.py").write_text("z" * 5000)
    got = tree.scan_tree(spark, str(src), "r", max_bytes=1000)
    assert [(r["path"], r["content"]) for r in got.collect()] == [("pkg/a.py", "x = 1\n")]
    tree.write_snapshot({"files": got}, str(tmp_path / "snap"))
    assert tree.read_snapshot(spark, str(tmp_path / "snap"), ["files"])["files"].count() == 1
    tree.export_bundle({"files": got.drop("content")}, str(tmp_path / "bundle"))
    back = tree.import_bundle(spark, str(tmp_path / "bundle"), {"files": "repo_id string, path string, ext string, size_bytes long, sha256 string"})["files"]
    assert rows(back) == rows(got.drop("content"))
    late = [("a", 1, 1), ("a", 1, 400), ("b", 2, 90), (None, 3, 3), ("b", 2, None)]
    spark.createDataFrame(late, "k string, v int, d int").selectExpr("k", "v", "timestamp_seconds(d * 86400) as loaded_at").write.parquet(str(tmp_path / "in"))
    out = watch.ingest(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, ["k"], ["k", "v"])
    assert rows(out) == {("a", 1), ("b", 2), (None, 3)}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(40)]
        texts += [base, base[:], [*base[:-2], "q", "z"], [*base[:20], "p", *base[20:]]]
    data = [(i, "r", "p", "function", " ".join(t)) for i, t in enumerate(texts)] + [(900, "r", "p", "function", None), (901, "r", "p", "function", "a b")]
    got = {r["sym_id"]: r for r in quality.near_duplicates(spark.createDataFrame(data, "sym_id long, repo_id string, path string, type string, body string")).collect()}
    import re

    norm = [re.sub(r"\d+", "NUM", " ".join(t)).split() for t in texts]
    sets = [frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4)) for t in norm]
    assert set(got) == set(range(len(texts)))
    for i, a in enumerate(sets):
        others = {b for b in sets if b != a and len(a & b) >= 0.8 * len(a | b)}
        assert got[i]["links"] == len(others) and got[i]["copies"] == sets.count(a)


def test_complexity_of_a_known_body(spark):
    body = "def f(a):\n    # c\n    if a and b:\n        for x in y:\n            g(x)\n\n    return 1\n"
    s = spark.createDataFrame([(1, "r", "a.py", "f", "function", 1, 7, ["a"], ["g", "g"]), (2, "r", "nope.py", "h", "function", 1, 2, None, None)], "sym_id long, repo_id string, path string, name string, type string, line int, end_line int, params array<string>, calls array<string>")
    (r,) = quality.source_metrics(s, files(spark, ("a.py", body))).collect()
    assert (r["lines"], r["cyclomatic"], r["nesting"], r["calls"], r["rating"]) == (4, 4, 3, 1, "low")


def test_ratio_and_search(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "a"), ("", "")], "a string, b string").select("a", "b", sequence_ratio(F.col("a"), F.col("b")).alias("r"))
    for r in df.collect():
        assert r["r"] == (None if r["a"] is None else difflib.SequenceMatcher(None, r["a"], r["b"]).ratio())
    s = spark.createDataFrame([(1, "r", "p", 0, "parse", "function", 1), (1, "r", "p", 0, "parse", "function", 1), (2, "r", "p", 1, None, "class", 2)], "sym_id long, repo_id string, path string, ordinal int, name string, type string, line int")
    assert search.symbol_search(s, "PAR").count() == 1
    assert search.subsequence_search(s, "psr").count() == 0 and search.subsequence_search(s, "pr").count() == 0 and search.subsequence_search(s, "pse").count() == 1
    assert {(r["name"], r["score"]) for r in search.fuzzy_search(s, "parse").collect()} == {("parse", 1.0)}


def test_frameworks_and_entities(spark):
    b = spark.createDataFrame(
        [(1, "r", "a.tsx", "Page", "function", "const [x] = useState(0)"), (2, "r", "a.tsx", "useX", "function", "useEffect(f)"), (3, "r", "b.py", "go", "function", "@app.get('/x')\ndef go(): pass"), (4, "r", "C.java", "C", "class", "@RestController\nclass C {}"),
         (5, "r", "b.py", "P", "class", "class P(BaseModel):\n    a: int = 1\n    b = 2\n"), (6, "r", "b.py", None, "class", None), (7, "r", "d.go", "x", "function", "useState"), (1, "r", "a.tsx", "Page", "function", "const [x] = useState(0)")],
        "sym_id long, repo_id string, path string, name string, type string, body string",
    )
    assert rows(frameworks.detected_frameworks(b)) == {(1, "react-component"), (2, "react-hook"), (3, "fastapi-endpoint"), (4, "spring-controller")}
    assert {(r["name"], r["kind"], r["fields"]) for r in frameworks.entities(b).collect()} == {("P", "pydantic", "a b"), ("C", "unknown", "")}
    assert frameworks.entities(b.limit(0)).count() == 0


def test_shown_ends_counts_all_and_shows_some(spark):
    e = edges(spark, [(f"n{i:03d}", "hot") for i in range(50)] + [("a", "b")])
    got = {r["dst"]: (r["n"], r["shown"]) for r in graph.shown_ends(e, "dst", "src", 3).collect()}
    assert got == {"hot": (50, ["n000", "n001", "n002"]), "b": (1, ["a"])}
    assert graph.shown_ends(e.limit(0), "dst", "src").count() == 0


def test_nearest_against_brute_force(spark):
    rng = random.Random(5)
    pairs = {(f"n{rng.randrange(15)}", f"n{rng.randrange(15)}") for _ in range(40)}
    calls = {}
    for a, b in sorted(pairs):
        calls.setdefault(a, []).append(b)
    want = set()
    for seed in ("n1", "n2", "alone"):
        at, level = {seed: 0}, [seed]
        for d in (1, 2, 3):
            level = sorted({b for a in level for b in calls.get(a, [])[:2]})
            for b in level:
                at.setdefault(b, d)
        want |= {(seed, n, d) for d, n in sorted((d, n) for n, d in at.items())[:4]}
    seeds = spark.createDataFrame([("r", n) for n in ("n1", "n2", "alone")], "repo_id string, name string")
    got = graph.nearest(edges(spark, pairs), seeds, 2, 3, 4).select("seed", "name", "distance")
    assert rows(got) == want


def test_both_ways(spark):
    assert rows(graph.both_ways(edges(spark, [("a", "b")])).select("name", "other", "direction")) == {("a", "b", "to"), ("b", "a", "from")}


FILE = "repo_id string, path string, content string"


def test_exports_of_scripts_and_python(spark):
    f = spark.createDataFrame(
        [
            ("r", "a.ts", "export default async function go() {}\nexport abstract class Box {}\nexport type T = 1\r\nexport const x = 1\nexport { p, q as z }\nconst hidden = 2"),
            ("r", "b.py", "__all__ = [\n    'one',\n    \"two\",\n]\nthree = 3"),
            ("r", "c.py", None), ("r", "d.js", ""), (None, None, "export const y = 1"),
        ],
        FILE,
    )
    got = extract.exports(f)
    assert rows(got) == {("r", "a.ts", "go", "function"), ("r", "a.ts", "Box", "class"), ("r", "a.ts", "T", "type"), ("r", "a.ts", "x", "variable"), ("r", "a.ts", "p", "named"), ("r", "a.ts", "z", "named"), ("r", "b.py", "one", "named"), ("r", "b.py", "two", "named")}
    s = spark.createDataFrame([("r", "a.ts", "go", None, "method"), ("r", "a.ts", "m", "Box", "method"), ("r", None, "q", None, "class"), ("r", "a.ts", "", None, "class")], "repo_id string, path string, name string, class_name string, type string")
    seen = extract.visible_names(s, got.where("path = 'a.ts'"))
    assert rows(seen.where("name in ('go', 'm', 'Box', 'q')")) == {("r", "a.ts", "go", "method"), ("r", "a.ts", "Box", "class")}


def test_brace_depth(spark):
    f = spark.createDataFrame([("r", "a", "a {\n b { {\n }\n"), ("r", "b", "} } {"), ("r", "c", None), ("r", "d", ""), ("r", "a", "a {\n b { {\n }\n")], FILE)
    assert sorted(map(tuple, quality.brace_depth(f).collect())) == [("r", "a", 4, 3, 2), ("r", "b", 1, 0, -1)]


def test_budget_keeps_the_row_that_overflows(spark):
    t = spark.createDataFrame([("f", i, n) for i, n in enumerate([3, 4, 5, 6])] + [("g", 0, None), ("g", 1, 9), (None, 0, 2)], "path string, ordinal int, tokens int")
    kept = profile.within_budget(t, "tokens", ["path"], ["ordinal"], 7)
    assert rows(kept.select("path", "ordinal")) == {("f", 0), ("f", 1), ("g", 0), ("g", 1), (None, 0)}
    assert profile.within_budget(t, "tokens", ["path"], ["ordinal"], 0).count() == 7


def test_shares_and_names_across_repositories(spark):
    n = spark.createDataFrame([("r", 1), ("r", 3), (None, 2), (None, 4)], "repo_id string, n int")
    assert rows(profile.share_of_max(n, "n", "repo_id")) == {("r", 1, 33), ("r", 3, 100), (None, 2, 50), (None, 4, 100)}
    s = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "c", None), (5, "d", "")], "sym_id long, repo_id string, name string")
    assert rows(profile.shared_names(s)) == {("x", 2, 2)}
    c = spark.createDataFrame([("r", "p", "K", ["a", "b", ""]), ("r", "p", "K", ["b", None]), ("r", "p", None, ["z"]), ("r", "p", "L", None)], "repo_id string, path string, class_name string, calls array<string>")
    assert rows(profile.class_callees(c)) == {("r", "p", "K", "a"), ("r", "p", "K", "b")}


def test_outline_and_concept_points(spark):
    s = spark.createDataFrame([(1, "r", "p", 0, "f", "function", 5), (1, "r", "p", 0, "f", "function", 5), (2, "r", "p", None, None, None, None)], "sym_id long, repo_id string, path string, ordinal int, name string, type string, line int")
    assert rows(search.outline(s)) == {(1, "r", "p", 0, "f", 12, 4), (2, "r", "p", None, "?", 13, 0)}
    points = search.concept_points("error handling of the cache")
    assert (points["error_handling"], points["caching"], points["search"]) == (18, 0, 0)
    assert (search.concept_points("search it")["search"], search.concept_points("Cache invalidation?")["caching"]) == (13, 8)
