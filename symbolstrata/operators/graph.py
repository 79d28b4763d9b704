"""Operators on the call graph and the file graph. Edges have repo_id, src, dst (and path); names are per repository.

All of them take the tables as delivered: edges are made distinct first, edges with a null or empty end are left out,
and empty tables give empty results. Names are compared as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, split_join
from ..tables import clean_path


def call_edges(calls: DataFrame) -> DataFrame:
    """Distinct edges repo_id, src, dst of the call graph."""
    return calls.where("src <> '' and dst <> ''").select("repo_id", "src", "dst").distinct()


def file_edges(file_deps: DataFrame) -> DataFrame:
    """Distinct edges repo_id, src, dst between files, paths cleaned, without self loops."""
    edges = file_deps.where("src_path <> '' and dst_path <> ''").select("repo_id", clean_path(F.col("src_path")).alias("src"), clean_path(F.col("dst_path")).alias("dst"))
    return edges.where("src <> dst").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    """repo_id, name, fan_out, fan_in for every node with an edge."""
    ends = edges.select("repo_id", F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select("repo_id", F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("repo_id", "name").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))


def top_by_degree(edges: DataFrame, end: str, k: int = 10) -> DataFrame:
    """The k names with most distinct (repository, other end) pairs: name, degree; ties by name."""
    return edges.groupBy(F.col(end).alias("name")).agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "name").limit(k)


def roots(edges: DataFrame) -> DataFrame:
    """Names that call and are never called, per repository."""
    called = edges.select("repo_id", F.col("dst").alias("name")).distinct()
    return edges.select("repo_id", F.col("src").alias("name")).distinct().join(called, ["repo_id", "name"], "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    """Names that are called and never call, per repository."""
    return roots(reversed_edges(edges))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select("repo_id", F.col("src").alias("name"))


def change_impact(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """What a change of each called name reaches: direct callers, their callers, the files that define them, the risk.

    Callers of hot names are joined by parts. Columns repo_id, name, direct, indirect, affected_files, test_files, risk. Indirect callers are neither direct ones
    nor the name itself. Risk counts the name too: over 10 high, over 3 medium, else low.
    """
    e = edges.where("src <> dst")
    direct = e.select("repo_id", F.col("dst").alias("name"), F.col("src").alias("by"), F.lit(1).alias("hop"))
    second = split_join(direct, e.select("repo_id", F.col("dst").alias("by"), F.col("src").alias("by2")), ["repo_id", "by"]).where("by2 <> name").select("repo_id", "name", F.col("by2").alias("by"), F.lit(2).alias("hop"))
    reached = direct.unionByName(second).groupBy("repo_id", "name", "by").agg(F.min("hop").alias("hop"))
    counts = reached.groupBy("repo_id", "name").agg(F.count_if(F.col("hop") == 1).alias("direct"), F.count_if(F.col("hop") == 2).alias("indirect"))
    places = symbols.select("repo_id", F.col("name").alias("by"), "path").distinct()
    touched = reached.select("repo_id", "name", "by").unionByName(counts.select("repo_id", "name", F.col("name").alias("by"))).join(places, ["repo_id", "by"]).select("repo_id", "name", "path").distinct()
    test = F.lower("path").contains("test") | F.lower("path").contains("spec")
    files = touched.groupBy("repo_id", "name").agg(F.count("*").alias("affected_files"), F.count_if(test).alias("test_files"))
    total = F.col("direct") + F.col("indirect") + 1
    risk = F.when(total > 10, "high").when(total > 3, "medium").otherwise("low")
    return counts.join(files, ["repo_id", "name"], "left").select("repo_id", "name", "direct", "indirect", F.coalesce("affected_files", F.lit(0)).alias("affected_files"), F.coalesce("test_files", F.lit(0)).alias("test_files"), risk.alias("risk"))


def trace_paths(edges: DataFrame, seeds: DataFrame, max_depth: int = 5) -> DataFrame:
    """Simple paths from the seeds (repo_id, name) that end at a name which calls nothing: repo_id, start, path (array).

    Paths of up to ``max_depth`` + 1 names; those that would go on, or come back to themselves, are dropped. The last step
    goes to ends only and the one before to their callers, so the many paths that the depth cuts off are not built.
    """
    ends = sinks(edges).withColumn("steps", F.lit(0))
    before = edges.join(ends.select("repo_id", F.col("name").alias("dst")), ["repo_id", "dst"], "left_semi").select("repo_id", F.col("src").alias("name")).distinct().withColumn("steps", F.lit(1))
    near = ends.unionByName(before).groupBy("repo_id", "name").agg(F.min("steps").alias("steps"))
    step = edges.join(near.withColumnRenamed("name", "dst"), ["repo_id", "dst"], "left")
    step = cut_lineage(step.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("to"), F.coalesce("steps", F.lit(2)).alias("steps")))
    open_paths = seeds.select("repo_id", F.col("name").alias("start")).distinct().select("repo_id", "start", F.array("start").alias("path"), F.col("start").alias("at"))
    done = None
    for depth in range(1, max_depth + 1):
        near_enough = step.where(F.col("steps") <= max_depth - depth) if max_depth - depth < 2 else step
        longer = open_paths.join(near_enough, ["repo_id", "at"]).where(~F.array_contains("path", F.col("to")))
        longer = longer.select("repo_id", "start", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"), "steps")
        if depth == max_depth - 2:
            longer = cut_lineage(longer)  # the last, largest steps read this one instead of building it again
        ended = longer.where("steps = 0").select("repo_id", "start", "path")
        done = ended if done is None else done.unionByName(ended)
        open_paths = longer.where("steps > 0").drop("steps")
    return done


def trace_report(edges: DataFrame, seeds: DataFrame, per_start: int = 5, most: int = 50) -> DataFrame:
    """The first paths of each start (by length and names), ``per_start`` of them and ``most`` of a repository: repo_id, start, place, path (array)."""
    paths = trace_paths(edges, seeds)
    mine = paths.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "start").orderBy(F.size("path"), F.array_join("path", " > ")))).where(F.col("_i") <= per_start)
    return mine.withColumn("place", F.row_number().over(W.partitionBy("repo_id").orderBy("start", "_i"))).where(F.col("place") <= most).select("repo_id", "start", "place", "path")


def neighbourhood(edges: DataFrame, seeds: DataFrame, callees: int = 10) -> DataFrame:
    """Two steps out of each seed, the first ``callees`` names (in order) of every step: repo_id, seed, depth, src, dst."""
    ranked = edges.withColumn("n", F.row_number().over(W.partitionBy("repo_id", "src").orderBy("dst"))).where(F.col("n") <= callees).drop("n")
    first = seeds.select("repo_id", F.col("name").alias("src")).distinct().join(ranked, ["repo_id", "src"])
    one = first.select("repo_id", F.col("src").alias("seed"), F.lit(1).alias("depth"), "src", "dst")
    two = first.select("repo_id", F.col("src").alias("seed"), F.col("dst").alias("src")).join(ranked, ["repo_id", "src"]).select("repo_id", "seed", F.lit(2).alias("depth"), "src", "dst")
    return one.unionByName(two)


def cycles(edges: DataFrame, most: int = 5) -> DataFrame:
    """Every simple cycle of up to ``most`` nodes, once, starting at its smallest node: repo_id, path (array), length.

    The paths grow only through nodes larger than their start, so each cycle is met exactly once.
    """
    found = edges.where("src = dst").select("repo_id", F.array("src").alias("path"))
    rest = edges.where("src <> dst")
    for _ in range(2):  # nodes that nothing leads to, or that lead nowhere, are on no cycle
        called, calling = rest.select("repo_id", F.col("dst").alias("src")).distinct(), rest.select("repo_id", F.col("src").alias("dst")).distinct()
        rest = cut_lineage(rest.join(called, ["repo_id", "src"], "left_semi").join(calling, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"))
    step = rest.select("repo_id", F.col("src").alias("at"), F.col("dst").alias("to"))
    grow = step.select("repo_id", F.col("at").alias("start"), F.array("at", "to").alias("path"), F.col("to").alias("at")).where("at > start")
    for k in range(2, most + 1):
        wider = grow.join(step, ["repo_id", "at"])
        found = found.unionByName(wider.where("to = start").select("repo_id", "path"))
        if k < most:
            grow = cut_lineage(wider.where((F.col("to") > F.col("start")) & ~F.array_contains("path", F.col("to"))).select("repo_id", "start", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at")))
    return found.withColumn("length", F.size("path"))


def _ends_of_paths(edges: DataFrame) -> DataFrame:
    """Every node with an edge, the smallest node it can be reached from and the smallest it reaches: repo_id, name, low_from, low_to.

    Both labels go one step a round, checkpointed, until none changes; a round keeps a row for each node and joins its edges.
    """
    ends = edges.select("repo_id", F.col("src").alias("name")).unionByName(edges.select("repo_id", F.col("dst").alias("name"))).distinct()
    at = cut_lineage(ends.select("repo_id", "name", F.col("name").alias("low_from"), F.col("name").alias("low_to"), F.lit(True).alias("changed")))
    while at.where("changed").limit(1).count():
        # only labels that have just changed are sent on
        new = at.where("changed")
        down = edges.join(new.withColumnRenamed("name", "src"), ["repo_id", "src"]).select("repo_id", F.col("dst").alias("name"), "low_from", F.lit(None).cast("string").alias("low_to"))
        up = edges.join(new.withColumnRenamed("name", "dst"), ["repo_id", "dst"]).select("repo_id", F.col("src").alias("name"), F.lit(None).cast("string").alias("low_from"), "low_to")
        sent = down.unionByName(up).groupBy("repo_id", "name").agg(F.min("low_from").alias("_from"), F.min("low_to").alias("_to"))
        both = at.join(sent, ["repo_id", "name"], "left").select("repo_id", "name", F.col("low_from").alias("a"), F.col("low_to").alias("b"), F.least("low_from", "_from").alias("low_from"), F.least("low_to", "_to").alias("low_to"))
        at = cut_lineage(both.select("repo_id", "name", "low_from", "low_to", ((F.col("low_from") < F.col("a")) | (F.col("low_to") < F.col("b"))).alias("changed")))
    return at.drop("changed")


def cycle_components(edges: DataFrame) -> DataFrame:
    """Every node that lies on a cycle of any length: repo_id, name, component, size.

    Components are the strongly connected ones, named by their smallest node; nodes on no cycle are left out, and so are
    edges without a repository. Nodes without an edge on either side are trimmed; then each node gets the smallest node that
    reaches it and the smallest that it reaches. Where both are one node, it names the component; edges whose ends differ in a
    label are on no cycle and fall away; the rest goes through it again until no edge is left.
    """
    edges = edges.where("repo_id is not null")
    rest = cut_lineage(edges.where("src <> dst").select("repo_id", "src", "dst").distinct())
    found = edges.where("src = dst").select("repo_id", F.col("src").alias("name"), F.col("src").alias("component"), F.lit(True).alias("loop"))
    while True:
        left = rest.count()
        while left:
            called, calling = rest.select("repo_id", F.col("dst").alias("src")).distinct(), rest.select("repo_id", F.col("src").alias("dst")).distinct()
            rest = cut_lineage(rest.join(called, ["repo_id", "src"], "left_semi").join(calling, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"))
            before, left = left, rest.count()
            if left == before:
                break
        if not left:
            break
        labels = _ends_of_paths(rest)
        found = found.unionByName(labels.where("low_from = low_to").select("repo_id", "name", F.col("low_from").alias("component"), F.lit(False).alias("loop")))
        open_nodes = labels.where("low_from <> low_to")
        a, b = (open_nodes.select("repo_id", F.col("name").alias(end), F.struct("low_from", "low_to").alias(mark)) for end, mark in (("src", "_a"), ("dst", "_b")))
        rest = cut_lineage(rest.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("_a = _b").select("repo_id", "src", "dst"))
    # a self loop inside a larger component has that one's name, which is the smaller
    found = found.groupBy("repo_id", "name").agg(F.min("component").alias("component"), F.max("loop").alias("loop"))
    sized = found.join(found.groupBy("repo_id", "component").agg(F.count("*").alias("size")), ["repo_id", "component"])
    # a node between two components is the smallest both ways, too, if they only have larger ones
    return sized.where("size > 1 or loop").select("repo_id", "name", "component", "size")


def shown_ends(edges: DataFrame, key: str, other: str, k: int = 20) -> DataFrame:
    """Per ``key`` node the number of its other ends and the first ``k`` of them in order: repo_id, key, n, shown (array).

    Counts are aggregated before the shuffle and the window keeps ``k`` rows of a node, so no task gathers a hot node whole.
    """
    counts = edges.groupBy("repo_id", key).agg(F.count("*").alias("n"))
    first = edges.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", key).orderBy(other))).where(F.col("_i") <= k)
    return counts.join(first.groupBy("repo_id", key).agg(F.array_sort(F.collect_list(other)).alias("shown")), ["repo_id", key])


def both_ways(edges: DataFrame) -> DataFrame:
    """Every node with the nodes around it: repo_id, name, other, direction (``to`` or ``from``)."""
    return edges.select("repo_id", F.col("src").alias("name"), F.col("dst").alias("other"), F.lit("to").alias("direction")).unionByName(
        edges.select("repo_id", F.col("dst").alias("name"), F.col("src").alias("other"), F.lit("from").alias("direction"))
    )


def nearest(edges: DataFrame, seeds: DataFrame, fan: int = 5, depth: int = 3, nodes: int = 30) -> DataFrame:
    """The ``nodes`` nearest names out of each seed: repo_id, seed, name, distance.

    Each step takes the first ``fan`` names (in order) that a name calls, up to ``depth`` steps; a name counts at its
    shortest distance, the seed at 0; ties go by name. Seeds that call nothing stand alone.
    """
    step = edges.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "src").orderBy("dst"))).where(F.col("_i") <= fan).select("repo_id", F.col("src").alias("name"), "dst")
    frontier = seeds.select("repo_id", F.col("name").alias("seed"), "name").distinct().withColumn("distance", F.lit(0))
    seen = frontier
    for d in range(1, depth + 1):
        frontier = frontier.join(step, ["repo_id", "name"]).select("repo_id", "seed", F.col("dst").alias("name"), F.lit(d).alias("distance")).distinct()
        seen = seen.unionByName(frontier)
    shortest = seen.groupBy("repo_id", "seed", "name").agg(F.min("distance").alias("distance"))
    return shortest.withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "seed").orderBy("distance", "name"))).where(F.col("_i") <= nodes).drop("_i")


def quotient(edges: DataFrame, group: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Edges between the groups of their ends: repo_id, src_group, dst_group, edges; ends without a group get ``default``."""
    g = group.select("repo_id", F.col(key).alias("_k"), F.col(value).alias("_v"))
    out = edges.join(g.withColumnsRenamed({"_k": "src", "_v": "a"}), ["repo_id", "src"], "left").join(g.withColumnsRenamed({"_k": "dst", "_v": "b"}), ["repo_id", "dst"], "left")
    out = out.select("repo_id", F.coalesce("a", F.lit(default)).alias("src_group"), F.coalesce("b", F.lit(default)).alias("dst_group")).where("src_group <> dst_group")
    return out.groupBy("repo_id", "src_group", "dst_group").agg(F.count("*").alias("edges"))


def display_graph(edges: DataFrame, nodes: int = 120) -> DataFrame:
    """The induced subgraph of each repository's ``nodes`` names of highest degree (ties by name): repo_id, src, dst."""
    d = degrees(edges.where("src <> dst"))
    best = d.withColumn("n", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "name"))).where(F.col("n") <= nodes).select("repo_id", "name")
    kept = edges.where("src <> dst").join(best.withColumnRenamed("name", "src"), ["repo_id", "src"], "left_semi")
    return kept.join(best.withColumnRenamed("name", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst")


def path_tree(paths: DataFrame) -> DataFrame:
    """Every folder of every path with the files below it: repo_id, folder, depth, files."""
    parts = paths.where("path <> ''").select("repo_id", clean_path(F.col("path")).alias("path")).distinct().withColumn("parts", F.split("path", "/"))
    above = parts.where("size(parts) > 1").select("repo_id", "parts", F.explode(F.expr("sequence(1, size(parts) - 1)")).alias("depth"))
    return above.groupBy("repo_id", F.array_join(F.expr("slice(parts, 1, depth)"), "/").alias("folder"), "depth").agg(F.count("*").alias("files"))


def symbol_files(symbols: DataFrame, which: str = "last") -> DataFrame:
    """The one file that stands for a name: repo_id, name, path; of several the ``first`` or ``last`` by path and ordinal.

    Names that two files define get one of them, as a lookup of a name does. Null names and paths are left out.
    """
    best = F.min if which == "first" else F.max
    return symbols.where("name <> '' and path is not null").groupBy("repo_id", "name").agg(best(F.struct("path", "ordinal")).alias("f")).select("repo_id", "name", "f.path")


def importing_files(edges: DataFrame, symbols: DataFrame, deps: DataFrame) -> DataFrame:
    """Files that import a file affected by the change of a name and are not affected themselves: repo_id, name, importing_files.

    Affected are the files (by ``symbol_files``) of the name, its direct and indirect callers; test files among them lead
    no further. ``deps`` are file edges. Names without importing files are left out.
    """
    e = edges.where("src <> dst")
    direct = e.select("repo_id", F.col("dst").alias("name"), F.col("src").alias("by"))
    second = split_join(direct, e.select("repo_id", F.col("dst").alias("by"), F.col("src").alias("by2")), ["repo_id", "by"]).select("repo_id", "name", F.col("by2").alias("by"))
    reached = direct.unionByName(second).unionByName(direct.select("repo_id", "name", F.col("name").alias("by")))
    places = symbol_files(symbols).select("repo_id", F.col("name").alias("by"), clean_path(F.col("path")).alias("path"))
    affected = cut_lineage(reached.distinct().join(places, ["repo_id", "by"]).select("repo_id", "name", "path").distinct())
    test = F.lower("path").contains("test") | F.lower("path").contains("spec")
    importing = split_join(affected.where(~test).withColumnRenamed("path", "dst"), deps, ["repo_id", "dst"]).select("repo_id", "name", F.col("src").alias("path")).distinct()
    return importing.join(affected, ["repo_id", "name", "path"], "left_anti").groupBy("repo_id", "name").agg(F.count("*").alias("importing_files"))


def participants(edges: DataFrame, seeds: DataFrame, first: int = 10, fan: int = 3, depth: int = 4, nodes: int = 15) -> DataFrame:
    """Who takes part in what each seed starts: repo_id, seed, place, name, distance; at most ``nodes`` with the seed.

    The first ``first`` names that the seed calls, then the first ``fan`` of each of those, and so on, ``depth`` steps;
    nearer ones come first, ties by name.
    """
    ranked = edges.where("src <> dst").withColumn("_i", F.row_number().over(W.partitionBy("repo_id", "src").orderBy("dst")))
    step = ranked.where(F.col("_i") <= fan).select("repo_id", F.col("src").alias("name"), "dst")
    start = seeds.select("repo_id", F.col("name").alias("seed")).distinct()
    frontier = start.join(ranked.where(F.col("_i") <= first).select("repo_id", F.col("src").alias("seed"), F.col("dst").alias("name")), ["repo_id", "seed"]).withColumn("distance", F.lit(1))
    seen = start.select("repo_id", "seed", F.col("seed").alias("name"), F.lit(0).alias("distance")).unionByName(frontier)
    for d in range(2, depth + 1):
        frontier = frontier.join(step, ["repo_id", "name"]).select("repo_id", "seed", F.col("dst").alias("name"), F.lit(d).alias("distance")).distinct()
        seen = seen.unionByName(frontier)
    nearest_ = seen.groupBy("repo_id", "seed", "name").agg(F.min("distance").alias("distance"))
    return nearest_.withColumn("place", F.row_number().over(W.partitionBy("repo_id", "seed").orderBy("distance", "name"))).where(F.col("place") <= nodes)


def entity_relations(symbols: DataFrame, words: tuple[str, ...] = ("model", "entity", "schema")) -> DataFrame:
    """Relations between entity classes that method names tell: repo_id, class_name, other, relation (``one`` or ``many``).

    Entities are classes with one of ``words`` in their name. A method of one whose name holds the name of another relates
    them; ``many`` if it also says many or list. Method names are looked up by their parts as long as an entity's name, so
    no class meets every method.
    """
    s = symbols.where("name <> ''").select("repo_id", "name", "type", "class_name", "path").distinct()
    low = F.lower("name")
    named = F.lit(False)
    for w in words:
        named = named | low.contains(w)
    entities = s.where((F.col("type") == "class") & named).select("repo_id", F.col("name").alias("class_name"), "path").distinct()
    methods = s.where("type = 'method' and class_name <> ''").select("repo_id", "path", "class_name", F.col("name").alias("method")).join(entities, ["repo_id", "path", "class_name"], "left_semi")
    others = entities.select("repo_id", F.col("class_name").alias("other"), F.lower("class_name").alias("part"), F.length("class_name").alias("n")).distinct()
    lengths = others.groupBy("repo_id").agg(F.collect_set("n").alias("lengths"))  # as many as names have lengths
    parts = methods.join(lengths, "repo_id").withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("method"))
    parts = parts.withColumn("part", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("method") - F.col("n") + 1), lambda i: F.lower(F.substring("method", i, F.col("n")))))))
    many = F.lower("method").contains("many") | F.lower("method").contains("list") | F.col("method").contains("[]")
    hit = parts.join(others.drop("n"), ["repo_id", "part"]).where("other <> class_name")
    return hit.select("repo_id", "class_name", "other", F.when(many, "many").otherwise("one").alias("relation")).distinct()


def most_called(edges: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most called names of each repository: repo_id, rank, name, callers; ties by name."""
    n = edges.groupBy("repo_id", F.col("dst").alias("name")).agg(F.count("*").alias("callers"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("callers"), "name"))).where(F.col("rank") <= k).select("repo_id", "rank", "name", "callers")


def top_level_flows(edges: DataFrame, k: int = 10, callees: int = 5) -> DataFrame:
    """The first ``k`` names (in order) of each repository that call and are never called, with the first ``callees`` names that they call: repo_id, rank, name, shown (array)."""
    top = roots(edges).withColumn("rank", F.row_number().over(W.partitionBy("repo_id").orderBy("name"))).where(F.col("rank") <= k)
    shown = shown_ends(edges, "src", "dst", callees).select("repo_id", F.col("src").alias("name"), "shown")
    return top.join(shown, ["repo_id", "name"]).select("repo_id", "rank", "name", "shown")
