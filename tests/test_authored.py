"""Registered queries beside their SQL over authored tables that hold what the given ones lack, and rules one by one."""

import re

import duckdb
import pytest

from compare import normal
from symbolstrata import settings
from symbolstrata.operators import extract, frameworks, lookup, plugins, search
from symbolstrata.plans import catalog
from symbolstrata.session import split_join
from symbolstrata.sources import manifests
from symbolstrata.tables import load

FILES = [
    ("r", "api/app.py", "from flask import Flask\nfrom .store import Item, keep\n\n@app.route('/a', methods=['POST', \"put\"])\ndef a():\n    return 1\n\n@bp.get('/b')\n@app.route('/c')\ndef b(): return 2\n# @app.get('/no')\nurlpatterns = [path('x/<int:i>', view), path(\"y\", view)]\n@router.delete('/d')\n"),
    ("r", "web/server.js", "import D, { e as f } from './t'\napp.get('/one', h); router.post(\"/two\", h)\n// app.get('/no')\n@Get('three')\napp.use('/mw', m)\n"), ("r", "web/t.js", "export const e = 1\n"), ("r", "src/app/api/users/route.ts", "export async function GET(req) {}\nexport function POST(req) {}\n"),
    ("r", "pages/api/route.index.ts", "export function HEAD(r) {}"), ("r", "S.java", "@GetMapping(\"/m\")\n@RequestMapping(value = \"/n\")\n"), ("r", "m.go", 'http.HandleFunc("/go", h)\nmux.Handle("/g2", h)\n'), ("r", "routes.rb", "  get '/rails', to: 'x#y'\n"),
    ("r", "api/store.py", "class Item(Base):\n    id = 1\n    def many(self):\n        local = 2\n        return local\n"), ("r", "null.py", None), ("r", None, "app.get('/x')"), ("r", "main.py", "def start():\n    print(a())\n"),
]
BODIES = [
    (1, "r", "api/store.py", "Item", "class", 1, FILES[8][2]), (2, "r", "ui/Page.tsx", "Page", "function", 1, "const [x] = useState(0)"), (3, "r", "ui/Page.tsx", "useX", "function", 9, "useEffect(f)"), (4, "r", "api/app.py", "a", "function", 4, "@app.get('/x')\ndef a(): pass"),
    (5, "r", "C.java", "C", "class", 1, "@RestController\nclass C {}"), (6, "r", "K.kt", "k", "function", 1, "routing { }"), (7, "r", "V.swift", "MyApp", "class", 1, "@main struct MyApp"), (8, "r", "d.dart", "D", "class", 1, "class D extends Cubit<int>"), (9, "r", "D.cs", "D", "class", 1, "class D : DbContext"),
    (10, "r", "web/server.js", "mw", "function", 5, "app.use(m)"), (11, "r", "web/server.js", "routerMw", "function", 5, "app.use(m)"), (12, "r", "web/m.js", "UserModel", "class", 1, "class UserModel {\n  name: string;\n}"), (13, "r", "x.py", None, "function", 1, None), (1, "r", "api/store.py", "Item", "class", 1, FILES[8][2]),
]
SYMBOLS = [
    (1, "r", "api/store.py", 0, "Item", "class", 1, 5, [], [], None, None, None), (2, "r", "ui/Page.tsx", 0, "Page", "function", 1, 1, [], ["a"], None, "Shows a page.", "react-component"), (4, "r", "api/app.py", 0, "a", "function", 4, 6, [], ["keep"], None, None, None),
    (14, "r", "api/store.py", 1, "manyPages", "method", 3, 5, ["self"], ["a"], "Item", None, None), (15, "r", "main.py", 0, "start", "function", 1, 2, [], ["a"], None, None, None), (16, "r", "ui/Page.tsx", 1, "Pages", "class", 3, 4, None, None, None, None, None), (17, None, None, None, None, None, None, None, None, None, None, None, None),
]
CALLS = [(1, "r", "ui/Page.tsx", "Page", "a"), (2, "r", "api/app.py", "a", "keep"), (3, "r", "main.py", "start", "a"), (4, "r", "main.py", None, "a"), (5, None, "x", "a", "b")]


@pytest.fixture(scope="module")
def authored(spark, data, tmp_path_factory):
    """A folder with the given tables, those above in place of four of them; other columns are null."""
    root = str(tmp_path_factory.mktemp("authored"))
    own = {
        "files": (FILES, "repo_id string, path string, content string"), "symbol_bodies": (BODIES, "sym_id long, repo_id string, path string, name string, type string, line int, body string"),
        "symbols": (SYMBOLS, "sym_id long, repo_id string, path string, ordinal int, name string, type string, line int, end_line int, params array<string>, calls array<string>, class_name string, doc string, framework string"),
        "calls": (CALLS, "call_id long, repo_id string, path string, src string, dst string"),
    }
    for name in ("files", "symbol_bodies", "symbols", "calls", "file_deps", "snippets", "exclude_patterns"):
        like = load(spark, data, name)
        df = like.limit(0)
        if name in own:
            df = df.unionByName(spark.createDataFrame(*own[name]), allowMissingColumns=True)
        df.select(*like.columns).coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.fixture(scope="module")
def duck(authored):
    c = duckdb.connect()
    for t in ("files", "symbol_bodies", "symbols", "calls", "file_deps", "snippets", "exclude_patterns"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{authored}/{t}.parquet/*.parquet')")
    return c


FULL = "routes endpoints endpoint_summary detected_frameworks entity_kinds content_roles layer_totals output_recommendations reasoned_entry_points imports exports declarations external_modules_of_code top_level_flows most_called entity_relations importing_files resolved_dependencies type_map external_modules package_symbols rebuilt_bodies smells".split()


@pytest.mark.parametrize("name", FULL)
def test_equals_sql_on_authored_tables(spark, authored, duck, name):
    ours, theirs = catalog.queries()[name](spark, authored).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert normal(ours) == normal(theirs)
    assert len(ours) > 0 or name == "importing_files"


def test_routes_say_what_the_lines_say(spark, authored):
    got = {(r["path"], r["method"], r["route"], r["framework"]) for r in extract.routes(load(spark, authored, "files")).collect()}
    assert got == {
        ("api/app.py", "POST", "/a", "flask"), ("api/app.py", "PUT", "/a", "flask"), ("api/app.py", "GET", "/b", "flask"), ("api/app.py", "GET", "/c", "flask"), ("api/app.py", "GET", "x/<int:i>", "django"), ("api/app.py", "GET", "y", "django"), ("api/app.py", "DELETE", "/d", "fastapi"),
        ("web/server.js", "GET", "/one", "express"), ("web/server.js", "POST", "/two", "express"), ("web/server.js", "GET", "three", "nestjs"), ("web/server.js", "USE", "/mw", "express"), ("src/app/api/users/route.ts", "GET", "/api/users", "nextjs"), ("src/app/api/users/route.ts", "POST", "/api/users", "nextjs"),
        ("pages/api/route.index.ts", "HEAD", "/api/route.index", "nextjs"), ("S.java", "GET", "/m", "spring"), ("S.java", "GET", "/n", "spring"), ("m.go", "ANY", "/go", "go-http"), ("m.go", "ANY", "/g2", "go-http"), ("routes.rb", "GET", "/rails", "rails"),
    }


def test_imports_resolve_on_authored_tables(spark, authored):
    deps = catalog.queries()["resolved_dependencies"](spark, authored).collect()
    assert {(r["src_path"], r["dst_path"]) for r in deps} == {("api/app.py", "api/store.py"), ("web/server.js", "web/t.js")}
    assert {(r["imported_in"], r["name"], r["defined_in"]) for r in catalog.queries()["type_map"](spark, authored).collect()} == {("api/app.py", "Item", "api/store.py")}


def test_frameworks_say_what_the_bodies_say(spark, authored):
    got = {r["sym_id"]: r["framework"] for r in frameworks.detected_frameworks(load(spark, authored, "symbol_bodies")).collect()}
    assert got == {2: "react-component", 3: "react-hook", 4: "fastapi-endpoint", 5: "spring-controller", 6: "ktor-route", 7: "swiftui-app", 8: "flutter-bloc", 9: "ef-entity", 10: "express-middleware"}
    kinds = {r["name"]: (r["kind"], r["fields"]) for r in frameworks.entities(load(spark, authored, "symbol_bodies")).collect()}
    assert kinds == {"Item": ("sqlmodel", "id"), "C": ("unknown", ""), "UserModel": ("sequelize", "name")}


def test_every_framework_rule_fits_its_own_text(spark):
    """A body made of one text of each list gives the rule's label unless an earlier rule of its list fits it, too."""
    rows, want = [], {}
    paths = ["f.js", "f.js", "f.py", "f.java", "f.cs", "f.kt", "f.swift", "f.dart"]
    for (_, kinds, rules), path in zip(frameworks.RULES, paths, strict=True):
        for i, rule in enumerate(rules):
            name = {None: "abc", "^[A-Z]": "Abc", "!router": "abc", "App": "MyApp"}.get(rule[1]) or re.findall(r"\w{5,}", rule[1])[0]
            body = "\n".join(group[0] for group in rule[2:]) or "x"
            fits = lambda r: (r[1] is None or (not re.search(r[1][1:], name) if r[1].startswith("!") else re.search(r[1], name))) and all(any(t in body for t in g) for g in r[2:])  # noqa: B023, E731
            want[len(rows)] = next(r[0] for r in rules[: i + 1] if fits(r))
            rows.append((len(rows), path, name, (kinds or ["class"])[0], body))
    got = {r[0]: r[1] for r in frameworks.detected_frameworks(spark.createDataFrame(rows, "sym_id long, path string, name string, type string, body string")).collect()}
    assert got == want and len(set(want.values())) >= 60


LINES = [
    "api_key = 'abcdefghijklmnop1'", "password = 'hunter22'", "token: abcdefghijklmnop12", "aws_secret = ABCDEFGHIJKLMNOP/q", "ssh_key = 'x'", "postgres://u@h/d", "x sk-abcdefghijklmnopqrstu", "ghp_" + "a" * 36, "xoxb-1-a", "AKIA" + "A" * 16,
    "db.execute(f'x')", "cursor.execute('a {x}')", "e.innerHTML = x", "<a dangerouslySetInnerHTML>", "document.write(x)", "eval(x)", "exec(x)", "subprocess.run(c, shell=True)", "os.system(c)", "pickle.load(f)", "yaml.load(f)", "Math.random()",
]


def test_every_finding_rule_by_one_line(spark):
    assert len(LINES) == len(extract.FINDINGS) == 22
    f = spark.createDataFrame([("r", f"f{i}.py", line) for i, line in enumerate(LINES)] + [("r", "safe.js", "e.innerHTML = ''"), ("r", "safe2.js", "e.innerHTML='  ")], "repo_id string, path string, content string")
    got = {r["path"]: (r["category"], r["severity"], r["description"]) for r in extract.findings(f).collect() if r["path"] != "safe.js"}
    assert got == {f"f{i}.py": rule[:3] for i, rule in enumerate(extract.FINDINGS)}


SMELLY = [
    "eval(x)", "exec (x)", "pickle.loads(x)", "yaml.load(x)", "subprocess.call(input())", "os.system(x)", "'a'.format(b % c)", "Password = 'x'", "api_key='x'", "secret='x'", "token='x'", "select a + b FROM t", "cursor.execute(f'x')", "requests.get(f'x')", "open(a + b)", "Path(a + b)",
    "except:", "  pass\r\nx", "todo: x", "FIXME : x", "print(x)", "import *", "from a import b, c, d, e, f, g", "for a in b:\n  for c", "x.append([1])", "while True:", "time.sleep( 0 )", "if __name__ == '__main__':", "class A(B):\n  def __init__", "@property\n  def x():\n    return self.y",
]


def test_every_smell_rule_by_one_text(spark):
    assert len(SMELLY) == len(extract.SMELLS) == 30
    f = spark.createDataFrame([("r", str(i), text) for i, text in enumerate(SMELLY)], "repo_id string, path string, content string")
    got = {(r["path"], r["smell"]) for r in extract.smells(f).collect()}
    assert {(str(i), rule[0]) for i, rule in enumerate(extract.SMELLS)} <= got


def test_tables_are_whole():
    assert len(search.SYNONYMS) == 31 and sum(map(len, search.SYNONYMS.values())) == 138
    assert len(search.CONCEPTS) == 15 and sum(map(len, search.CONCEPTS.values())) == 158 and sum(map(len, search.ALIASES.values())) == 54


def test_signatures(spark):
    py = "class A:\n    @cached\n    @limit(3)\n    async def go(self, a: int = f(1), *rest, key=None) -> list[str]:\n        '''Turns rows\n        into one.'''\n        return 1\n# Above\n# two.\ndef plain(\n    x,\n    y,\n):\n    pass\n"
    js = "/**\n * Moves it.\n */\nexport async function move(a, { b }, c = 2) {\n}\nclass K {\n  static run(x) {\n    if (x) {\n    }\n  }\n}\n"
    java = "// See.\n@Override\npublic static List<String> all(final Map<String, Integer> m, int n) {\n}\n"
    f = spark.createDataFrame([("r", "a.py", py), ("r", "a.py", py), ("r", "b.js", js), ("r", "C.java", "class C {\n  " + java.replace("\n", "\n  ") + "}"), ("r", "n.py", None)], "repo_id string, path string, content string")
    got = {(r["path"], r["name"]): (r["type"], r["params"], r["return_type"], r["modifiers"], r["decorators"], r["doc"]) for r in extract.signatures(f).collect()}
    assert got[("a.py", "go")] == ("method", ["a", "rest", "key"], "list[str]", ["async"], ["@cached", "@limit(3)"], "Turns rows into one.")
    assert got[("a.py", "plain")] == ("function", ["x", "y"], None, [], [], "Above two.")
    assert got[("b.js", "move")][1:] == (["a", "c"], None, ["async"], [], "Moves it.")
    assert got[("b.js", "run")] == ("method", ["x"], None, ["static"], [], None)
    assert got[("C.java", "all")] == ("method", ["m", "n"], "List<String>", ["public", "static"], ["@Override"], "See.")
    assert set(got) == {("a.py", "A"), ("a.py", "go"), ("a.py", "plain"), ("b.js", "move"), ("b.js", "K"), ("b.js", "run"), ("C.java", "C"), ("C.java", "all")}
    assert extract.signatures(f.limit(0)).count() == 0


def test_split_join_is_a_join(spark):
    left = spark.createDataFrame([(i % 4 or None, f"l{i}") for i in range(20)], "k int, l string")
    right = spark.createDataFrame([(1, f"r{i}") for i in range(50)] + [(2, "a"), (None, "n")], "k int, r string")
    want = {tuple(r) for r in left.join(right, ["k"]).collect()}
    got = split_join(left, right, ["k"], 7).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_plugins(spark, tmp_path):
    known = plugins.Plugins()
    mine = plugins.Plugin("sql", [".sql"], symbols=lambda f: f.selectExpr("repo_id", "path", "1 as line", "'table' as type", "'t' as name"))
    known.register(mine)
    f = spark.createDataFrame([("r", "a.py", "def f(x): pass"), ("r", "b.sql", "create table t")], "repo_id string, path string, content string")
    assert {(r["path"], r["name"]) for r in known.symbols(f, extract.declarations).collect()} == {("a.py", "f"), ("b.sql", "t")}
    assert known.imports(f, extract.imports).count() == 0
    assert known.listed() == [("sql", [".sql"])] and known.handled() == {".sql"}
    assert known.unregister("sql") and not known.unregister("sql") and known.handled() == set()
    (tmp_path / "p.json").write_text('{"plugins": [{"module": "no.such", "name": "x"}, {"name": "y"}]}')
    assert known.load(str(tmp_path / "p.json")) == known.load(str(tmp_path / "none.json")) == 0
    assert known.finish({"files": f}) == {"files": f}


def test_settings_and_top_files(spark):
    assert settings.settings("{bad") == settings.settings(None) == settings.IndexSettings()
    s = settings.settings('{"indexer": {"include_tests": true, "exclude_patterns": ["x"], "unknown": 1}}', max_file_size=5, include_tests=None)
    assert (s.include_tests, s.exclude_patterns, s.max_file_size) == (True, ["x"], 5)
    rows = [("a", "nx.json", '{"projects": ["p", "q"]}'), ("b", "lerna.json", "{}"), ("c", "package.json", '{"workspaces": {"packages": ["w/*"]}}'), ("d", "package.json", "{}"), ("d", "pnpm-workspace.yaml", ""), ("e", "rush.json", None), ("f", "nx.json", "{bad"), ("g", ".env", "X=1"), ("h", ".env", "X"), ("h", ".gitignore", ".env\n"), ("d", "yarn.lock", "")]
    f = spark.createDataFrame(rows, "repo_id string, path string, content string")
    assert {(r["repo_id"], r["kind"], tuple(r["patterns"])) for r in settings.monorepo_patterns(f).collect()} == {("a", "nx", ("p/*", "q/*")), ("b", "lerna", ("packages/*",)), ("c", "yarn", ("w/*",)), ("d", "pnpm", ("packages/*",)), ("e", "rush", ("projects/*",))}
    assert {(r["repo_id"], r["package"], r["severity"]) for r in manifests.project_warnings(f).collect()} == {("c", "lockfile", "medium"), ("g", ".env", "high")}


def test_usage_and_workspace(spark):
    u = spark.createDataFrame([("p", "m", 1, 2, 3, True, 0.5), ("q", "m", 4, 5, 9, False, None)], "provider string, model string, prompt_tokens int, completion_tokens int, total_tokens int, cached boolean, cost_estimate double")
    r = lookup.usage_totals(u).first()
    assert (r["prompt_tokens"], r["total_tokens"], r["cached_pages"], r["generated_pages"], r["total_pages"], r["cost_estimate"], r["providers"], r["models"]) == (5, 12, 1, 1, 2, 0.5, ["p", "q"], ["m"])
    assert lookup.usage_totals(u.limit(0)).first()["total_pages"] == 0
    calls = spark.createDataFrame([("r", "./a", "x", "y"), ("s", "b", "x", "y")], "repo_id string, path string, src string, dst string")
    got = lookup.merged_workspace({"calls": calls}, spark.createDataFrame([("r", "one")], "repo_id string, alias string"))["calls"]
    assert [tuple(x) for x in got.select("repo_alias", "path", "src", "dst").collect()] == [("one", "one/a", "one:x", "one:y")]


def test_lookups_take_nulls_and_nothing(spark, authored, data):
    empty = spark.createDataFrame([], load(spark, authored, "symbols").schema)
    bodies = load(spark, authored, "symbol_bodies")
    edges = spark.createDataFrame([], "repo_id string, src string, dst string")
    for symbols in (empty, load(spark, authored, "symbols")):
        for df in (
            lookup.symbol_code(symbols, bodies), lookup.symbol_cards(symbols, edges, "a"), lookup.first_matching_file(symbols, "p"), lookup.across_repositories(symbols, "a"), lookup.search_payload(symbols), lookup.faceted(symbols), lookup.largest_modules(symbols), search.answer_symbols(symbols, "the page"),
            search.concept_files(symbols, load(spark, authored, "files").limit(0)), search.explanation_context(symbols, edges, "search"), search.scoped_search(symbols, "store"), search.scoped_search(symbols, "api:"), search.flow_by_file(edges, symbols, "a"),
        ):
            assert df.count() >= 0
    assert {r["name"] for r in search.scoped_search(load(spark, authored, "symbols"), "API/:").collect()} == {"Item", "manyPages", "a"}
    assert {r["name"] for r in search.answer_symbols(load(spark, authored, "symbols"), "how does the page work").collect()} == {"Page", "Pages", "manyPages"}


def test_names_of_nodes_and_included_globs(spark):
    from symbolstrata.functions.text import identifier
    from symbolstrata.operators import filters

    df = spark.createDataFrame([("a.b-c",), ("9x",), ("x" * 60,), (None,)], "t string")
    assert [r[0] for r in df.select(identifier(df["t"])).collect()] == ["a_b_c", "n9x", "x" * 50, None]
    f = spark.createDataFrame([("r", "src/a.py", 1), ("r", "deep/src/b.py", 1), ("r", "c.py", 1), ("r", "lib2/src/d.js", 1), ("q", "x.py", 1)], "repo_id string, path string, size_bytes long")
    inc = spark.createDataFrame([("r", "src/*.py"), ("r", None)], "repo_id string, pattern string")
    got = {(r["repo_id"], r["path"]): r["reason"] for r in filters.ignore_reasons(f, inc.limit(0), inc).collect()}
    assert got == {("r", "src/a.py"): None, ("r", "deep/src/b.py"): None, ("r", "c.py"): "not_included", ("r", "lib2/src/d.js"): "not_included", ("q", "x.py"): "not_included"}


def test_duplicate_links_against_brute_force(spark):
    import random

    from symbolstrata.operators import quality

    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 30)}" for _ in range(40)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((i, "r", "p", "function", " ".join(words)))
    rows += [(100, "r", "p", "function", None), (101, "r", "p", "function", "a b"), rows[0]]
    sets = {}
    for i, *_, body in rows:
        w = re.findall(r"\w+", body or "")
        w = [re.sub(r"\d+", "NUM", x) for x in w]
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        if s:
            sets.setdefault(s, set()).add(i)
    names = {s: min(ids) for s, ids in sets.items()}
    want = {(min(names[a], names[b]), max(names[a], names[b]), round(len(a & b) / len(a | b), 6)) for a in sets for b in sets if a != b and len(a & b) / len(a | b) >= 0.8}
    got = quality.duplicate_links(spark.createDataFrame(rows, "sym_id long, repo_id string, path string, type string, body string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
