"""Plugins: tables of symbols and imports for other extensions, framework rules, and last steps over an index.

A plugin works on whole DataFrames, so what it adds is planned with the rest: ``symbols`` and ``imports`` get the files
of its extensions and give rows with the columns of ``extract.declarations`` and ``extract.imports``.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import extension

Table = Callable[[DataFrame], DataFrame]


@dataclass
class Plugin:
    """What a plugin may bring; every part is optional. ``framework`` maps columns (name, source) to a label or null."""

    name: str
    extensions: list[str] = field(default_factory=list)
    symbols: Table | None = None
    imports: Table | None = None
    framework: Callable[[Column, Column], Column] | None = None
    finish: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None


class Plugins:
    """Registered plugins in order; of two for one extension the later holds."""

    def __init__(self) -> None:
        self._known: dict[str, Plugin] = {}
        self._by_extension: dict[str, str] = {}

    def register(self, plugin: Plugin) -> None:
        self._known[plugin.name] = plugin
        self._by_extension.update(dict.fromkeys(plugin.extensions, plugin.name))

    def unregister(self, name: str) -> bool:
        gone = self._known.pop(name, None)
        self._by_extension = {e: n for e, n in self._by_extension.items() if n != name}
        return gone is not None

    def listed(self) -> list[tuple[str, list[str]]]:
        return [(p.name, p.extensions) for p in self._known.values()]

    def handled(self) -> set[str]:
        return set(self._by_extension)

    def _rows(self, files: DataFrame, builtin: Table, part: str) -> DataFrame:
        """Rows of the built-in table for files that no plugin handles, then those of each plugin for its own."""
        ext = F.lower(extension(F.col("path")))
        taken = {e: n for e, n in self._by_extension.items() if getattr(self._known[n], part) is not None}
        out = builtin(files.where(~ext.isin(list(taken)))) if taken else builtin(files)
        for name in dict.fromkeys(taken.values()):
            mine = [e for e, n in taken.items() if n == name]
            out = out.unionByName(getattr(self._known[name], part)(files.where(ext.isin(mine))))
        return out

    def symbols(self, files: DataFrame, builtin: Table) -> DataFrame:
        return self._rows(files, builtin, "symbols")

    def imports(self, files: DataFrame, builtin: Table) -> DataFrame:
        return self._rows(files, builtin, "imports")

    def framework(self, name: Column, source: Column, builtin: Column) -> Column:
        """The first label that a plugin gives, else the built-in one."""
        return F.coalesce(*[p.framework(name, source) for p in self._known.values() if p.framework], builtin)

    def finish(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for plugin in self._known.values():
            tables = plugin.finish(tables) if plugin.finish else tables
        return tables

    def load(self, config: str) -> int:
        """Register the plugins of a JSON file ({"plugins": [{"module": ..., "name": ...}]}, name being a Plugin or what makes one); their number.

        A missing or malformed file has none; entries that can't be imported are passed over.
        """
        try:
            entries = json.loads(Path(config).read_text(encoding="utf-8")).get("plugins", [])
        except (OSError, ValueError, AttributeError):
            return 0
        before = len(self._known)
        for entry in entries:
            try:
                found = getattr(importlib.import_module(entry["module"]), entry["name"])
                self.register(found if isinstance(found, Plugin) else found())
            except (ImportError, AttributeError, KeyError, TypeError):
                continue
        return len(self._known) - before
