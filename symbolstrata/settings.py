"""Settings of an index run, from a project's file and the caller, and what a monorepo's files say of its packages."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.filters import MAX_BYTES


@dataclass(frozen=True)
class IndexSettings:
    include_tests: bool = False
    max_file_size: int = MAX_BYTES
    exclude_patterns: list[str] = field(default_factory=list)
    include_patterns: list[str] = field(default_factory=list)


def settings(text: str | None, **given) -> IndexSettings:
    """Settings from a JSON text ({"indexer": {...}}), overridden by what the caller gives; a malformed or missing text is the default.

    Unknown names in the text and given values of None are passed over.
    """
    try:
        found = json.loads(text or "{}").get("indexer", {})
    except (ValueError, AttributeError):
        found = {}
    names = {f.name for f in fields(IndexSettings)}
    told = {k: v for k, v in (found if isinstance(found, dict) else {}).items() if k in names and v is not None}
    return replace(IndexSettings(**told), **{k: v for k, v in given.items() if v is not None})


def monorepo_patterns(files: DataFrame, k: int = 20) -> DataFrame:
    """What each monorepo would include: repo_id, kind (nx, lerna, yarn, pnpm, rush), patterns (array of the first ``k``).

    Told by the files at the top of a repository; the first kind that fits in this order counts. Malformed JSON tells nothing.
    """
    top = files.where("path in ('nx.json', 'lerna.json', 'package.json', 'pnpm-workspace.yaml', 'rush.json')").groupBy("repo_id").pivot("path", ["nx.json", "lerna.json", "package.json", "pnpm-workspace.yaml", "rush.json"]).agg(F.max(F.coalesce("content", F.lit(""))))
    listed = lambda c, p: F.from_json(F.get_json_object(f"`{c}`", p), "array<string>")
    nx = F.transform(listed("nx.json", "$.projects"), lambda x: F.concat(x, F.lit("/*")))
    readable = F.try_parse_json("`lerna.json`").isNotNull() & (F.col("`lerna.json`") != "")
    lerna = F.when(readable, F.coalesce(listed("lerna.json", "$.packages"), F.array(F.lit("packages/*"))))
    yarn = F.coalesce(listed("package.json", "$.workspaces"), listed("package.json", "$.workspaces.packages"))
    pnpm = F.when(F.col("`pnpm-workspace.yaml`").isNotNull() & F.col("`package.json`").isNotNull(), F.array(F.lit("packages/*")))
    rush = F.when(F.col("`rush.json`").isNotNull(), F.array(F.lit("projects/*")))
    found = F.coalesce(*[F.when(F.size(p) > 0, F.struct(F.lit(kind).alias("kind"), F.slice(p, 1, k).alias("patterns"))) for kind, p in (("nx", nx), ("lerna", lerna), ("yarn", yarn), ("pnpm", pnpm), ("rush", rush))])
    return top.select("repo_id", found.alias("f")).where("f is not null").select("repo_id", "f.*")
