"""Named lists of columns that are known to be noisy."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import yaml
from pyspark.sql import DataFrame

REGISTRY = os.path.join(os.path.dirname(__file__), "blocklists.yaml")


def _registry(path: str = REGISTRY) -> dict[str, list[str]]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


class Blocklist:
    """Columns from named lists and given ones, in order and once each."""

    def __init__(self, features: str | Sequence[str] = (), name: str | Sequence[str] | None = None, registry: str = REGISTRY):
        self._items: dict[str, None] = {}
        names = [] if name is None else [name] if isinstance(name, str) else list(name)
        lists = _registry(registry) if names else {}
        for n in names:
            if n not in lists:
                raise ValueError(f"no blocklist {n}; there are {sorted(lists)}")
            self.add(lists[n])
        self.add(features)

    def add(self, features: str | Sequence[str]) -> Blocklist:
        self._items.update(dict.fromkeys([features] if isinstance(features, str) else features))
        return self

    def to_list(self) -> list[str]:
        return list(self._items)

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)


def blocked(df: DataFrame, blocklist: str | Sequence[str] | Blocklist | None = None, blocklist_name: str | Sequence[str] | None = None, blocklist_file: str | None = None) -> list[str]:
    """Columns of ``df`` on the list: from a file, else those given, else a named list, else the default.

    A file is YAML (a mapping of lists, or a list) or text with a column ``blocklist``.
    """
    if blocklist_file is not None:
        with open(blocklist_file, encoding="utf-8") as f:
            lines = f.read()
        if blocklist_file.endswith((".yaml", ".yml")):
            data = yaml.safe_load(lines)
            chosen = [blocklist_name] if isinstance(blocklist_name, str) else blocklist_name
            if isinstance(data, dict) and chosen and (unknown := set(chosen) - set(data)):
                raise ValueError(f"no blocklists {sorted(unknown)} in {blocklist_file}")
            items = [x for k in (chosen or data) for x in data[k]] if isinstance(data, dict) else list(data)
        else:
            head, *rows = [x.strip() for x in lines.splitlines() if x.strip()]
            if head != "blocklist":
                raise ValueError("a blocklist file has one column, blocklist")
            items = rows
    elif blocklist is not None:
        items = list(Blocklist(name=blocklist)) if isinstance(blocklist, str) else list(blocklist)
    else:
        items = list(Blocklist(name=blocklist_name or "default"))
    there = set(df.columns)
    return [c for c in dict.fromkeys(items) if c in there]
