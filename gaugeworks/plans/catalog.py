"""Task configurations: YAML with includes, templates, and lookup by glob."""

from __future__ import annotations

import fnmatch
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from .evaluate import Aggregate, Group
from .templates import Value, block, pieces


def load(path: str) -> dict:
    """A mapping with its includes merged in: the file wins over its bases, earlier bases over later. Function tags are refused."""
    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    merged: dict = {}
    bases = own.pop("include", [])
    for base in reversed([bases] if isinstance(bases, str) else bases):
        merged |= load(os.path.join(os.path.dirname(path), base))
    return merged | own


def index(folder: str) -> dict[str, dict]:
    """Configurations under a folder by task or group name; the first of equal names stays."""
    out: dict[str, dict] = {}
    for root, _, names in sorted(os.walk(folder)):
        for n in sorted(names):
            if n.endswith((".yaml", ".yml")):
                c = load(os.path.join(root, n))
                name = c.get("group") or c.get("task")
                if isinstance(name, str):
                    out.setdefault(name, c)
    return out


def match(patterns: list[str], names) -> list[str]:
    return sorted({n for p in patterns for n in fnmatch.filter(names, p)})


def expand(name: str, configs: dict[str, dict]) -> list[str]:
    """Tasks under a group or tag name, depth first."""
    c = configs.get(name)
    if c and isinstance(c.get("task"), list):
        return [t for m in c["task"] for t in expand(m if isinstance(m, str) else m["task"], configs)]
    tagged = [n for n, x in configs.items() if name in ([x["tag"]] if isinstance(x.get("tag"), str) else x.get("tag") or [])]
    return tagged if tagged and not c else [name]


#: Keys that describe a group; all others of a group go to its members.
GROUP_KEYS = ("group", "group_alias", "task", "aggregate_metric_list", "metadata", "include", "tag")


def expand_configs(name: str | dict, configs: dict[str, dict], changes: dict | None = None, taken: list[str] | None = None) -> dict[str, dict]:
    """Configurations of the tasks under a group, tag or task, with what the way to them changes.

    A member may be a name, a mapping of a name and its own changes, or a whole configuration; a member's changes win over its
    group's, and both over the task's. A changed member is named apart, name-1, name-2, ..., where members of that name (or one
    that begins with it) came before in its group.
    """
    own = {} if isinstance(name, str) else {k: v for k, v in name.items() if k != "task"}
    label = name if isinstance(name, str) else name.get("group") or name.get("task")
    changes = {**(changes or {}), **own}
    c = configs.get(label, {}) if isinstance(name, str) or isinstance(name.get("task"), str) else name
    if isinstance(c.get("task"), list):
        below = {**{k: v for k, v in c.items() if k not in GROUP_KEYS}, **{k: v for k, v in changes.items() if k not in GROUP_KEYS}}
        seen: list[str] = []
        out: dict[str, dict] = {}
        for m in c["task"]:
            out |= expand_configs(m, configs, below, seen)
        return out
    tagged = [] if label in configs else [n for n, x in configs.items() if label in ([x["tag"]] if isinstance(x.get("tag"), str) else x.get("tag") or [])]
    if tagged:
        return {k: v for t in tagged for k, v in expand_configs(t, configs, changes, taken).items()}
    before = sum(t.startswith(label) for t in taken or ())
    if taken is not None:
        taken.append(label)
    alias = f"{label}-{before}" if changes and before else label
    return {alias: {**c, **changes, "task": alias}}


def groups(configs: dict[str, dict]) -> list[Group]:
    """Groups of the configurations with their metrics: aggregate_metric_list holds metric, weight_by_size (true unless said) and filter_list (a name or a list, none unless said). Only means can be rolled up. A group without a list gives no group."""
    out = []
    for name, c in configs.items():
        listed = c.get("aggregate_metric_list")
        if not isinstance(c.get("task"), list) or not listed:
            continue
        aggregates = []
        for m in [listed] if isinstance(listed, dict) else listed:
            if m.get("aggregation", "mean") != "mean":
                raise ValueError(f"{name}: only means can be rolled up")
            kept = m.get("filter_list", "none")
            aggregates.append(Aggregate(m["metric"], (kept,) if isinstance(kept, str) else tuple(kept), m.get("weight_by_size", True)))
        members = tuple(m if isinstance(m, str) else m.get("group") or m["task"] for m in c["task"])
        out.append(Group(c.get("group", name), members, aggregates=tuple(aggregates)))
    return out


def template(text: str, columns: list[str]) -> Column:
    """A column for a template over columns whose types aren't known: a column's name alone is that column. Where they are known, templates.compiled takes more."""
    return F.col(text) if text in columns else block(pieces(text), {c: Value(F.col(c)) for c in columns})
