"""Data nodes: declared tables that know what they depend on and how to update from a watermark."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import watermarks as wm
from ..operators.merge import map_keys
from ..schema import KEY, TIME
from ..sources.store import PanelStore


def _canonical(x):
    if isinstance(x, Mapping):
        return {str(k): _canonical(v) for k, v in sorted(x.items(), key=lambda kv: str(kv[0]))}
    if isinstance(x, DataNode):
        return x.storage_name
    if isinstance(x, (list, tuple, set, frozenset)):
        items = [_canonical(v) for v in x]
        return sorted(items, key=lambda v: json.dumps(v, sort_keys=True, default=str)) if isinstance(x, (set, frozenset)) or all(isinstance(v, dict) and "id" in v for v in items) else items
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


class DataNode:
    """A table made from constructor arguments.

    Subclasses take keyword arguments and define update(), which returns the new rows as a lazy DataFrame; and where
    they need other tables, dependencies(). Arguments listed in ``ignored`` don't change the table's identity, only the
    updater's, so that several updaters may share one table.
    """

    keys: tuple[str, ...] = (TIME, KEY)
    ignored: tuple[str, ...] = ()
    priority: int = 0
    project: str = ""

    def __init__(self, **arguments):
        self.arguments = arguments

    def _digest(self, arguments: Mapping, salt: str = "") -> str:
        text = json.dumps(_canonical(arguments), sort_keys=True, separators=(",", ":"), default=str) + salt
        return hashlib.md5(text.encode()).hexdigest()

    @property
    def storage_name(self) -> str:
        return f"{type(self).__name__.lower()}_{self._digest({k: v for k, v in self.arguments.items() if k not in self.ignored})}"

    @property
    def update_name(self) -> str:
        return f"{type(self).__name__.lower()}_{self._digest(self.arguments, self.project)}"

    def dependencies(self) -> dict[str, DataNode]:
        return {}

    def update(self, context: Context) -> DataFrame | None:
        raise NotImplementedError

    def asset_list(self, context: Context) -> DataFrame | None:
        """The identifiers to update, or None for all."""
        return None

    def column_metadata(self) -> dict[str, dict]:
        return {}

    def table_metadata(self) -> dict:
        return {}

    def after_update(self, context: Context) -> None:
        """Runs once the rows are stored."""


@dataclass
class Context:
    store: PanelStore
    node: DataNode
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stats: DataFrame | None = None
    #: The identifiers to update, or None for all.
    assets: DataFrame | None = None

    def read(self, **options) -> DataFrame | None:
        return self.store.read(self.node.storage_name, **options)


class FunctionNode(DataNode):
    """A node from a function of the context, for tables that need no class."""

    def __init__(self, name: str, function: Callable[[Context], DataFrame], needs: Mapping[str, DataNode] | None = None, **arguments):
        super().__init__(name=name, **arguments)
        self.function, self.needs = function, dict(needs or {})

    def dependencies(self):
        return self.needs

    def update(self, context):
        return self.function(context)


class TableNode(DataNode):
    """A stored table, read only."""

    def __init__(self, name: str):
        super().__init__(name=name)
        self.name = name

    @property
    def storage_name(self) -> str:
        return self.name

    def update(self, context):
        return None


def order(roots: list[DataNode]) -> list[DataNode]:
    """Every node once, dependencies first; among those that are ready by priority, then most dependants, then name. A cycle raises."""
    nodes: dict[str, DataNode] = {}
    needs: dict[str, set[str]] = {}

    def visit(n: DataNode, path: tuple[str, ...]) -> None:
        if n.update_name in path:
            raise ValueError(f"cycle: {' > '.join((*path, n.update_name))}")
        if n.update_name in nodes:
            return
        nodes[n.update_name] = n
        needs[n.update_name] = {d.update_name for d in n.dependencies().values()}
        for d in n.dependencies().values():
            visit(d, (*path, n.update_name))

    for r in roots:
        visit(r, ())
    users = {k: sum(k in v for v in needs.values()) for k in nodes}
    out: list[DataNode] = []
    done: set[str] = set()
    while len(done) < len(nodes):
        ready = [k for k in nodes if k not in done and needs[k] <= done]
        k = min(ready, key=lambda k: (nodes[k].priority, -users[k], k))
        done.add(k)
        out.append(nodes[k])
    return out


def run(store: PanelStore, *roots: DataNode, filter_new: bool = True) -> list[str]:
    """Updates the nodes and all they depend on; returns the tables written.

    Each node's rows are cut to its asset list and to those after the watermarks (filter_new), validated, and upserted;
    statistics come from the stored table itself. What the node says of its columns and its table is kept with the table.
    An update without rows writes nothing.
    """
    written = []
    for node in order(list(roots)):
        existing = store.scan(node.storage_name)
        stats = wm.watermarks(existing, node.keys[1:], node.keys[0]) if existing is not None else None
        tables = {k: store.scan(d.storage_name) for k, d in node.dependencies().items()}
        context = Context(store, node, tables, stats)
        context.assets = node.asset_list(context)
        rows = node.update(context)
        if rows is None:
            continue
        if context.assets is not None:
            rows = rows.join(context.assets.select(F.col(KEY).alias("_asset")), F.col(KEY) == F.col("_asset"), "left_semi")
        if filter_new and stats is not None:
            rows = wm.newer(rows, stats, node.keys[1:], node.keys[0])
        if not rows.isEmpty():
            store.upsert(rows, node.storage_name, node.keys)
            if node.column_metadata() or node.table_metadata():
                store.annotate(node.storage_name, node.column_metadata(), node.table_metadata())
            written.append(node.storage_name)
        node.after_update(context)
    return written


@dataclass(frozen=True)
class Rule:
    """An entity that meets the condition is read from table under its group's identifier on exchange."""

    condition: Column
    table: str
    exchange: str | None = None


def translate(entities: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds source_table and source_exchange by the first rule that holds; entities without one keep nulls."""
    table, exchange = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rules):
        table = F.when(r.condition, F.lit(r.table)).otherwise(table)
        exchange = F.when(r.condition, F.lit(r.exchange)).otherwise(exchange)
    return entities.withColumns({"source_table": table, "source_exchange": exchange})


def wrapped_read(read: Callable[[str], DataFrame], entities: DataFrame, assets: DataFrame, rules: list[Rule]) -> DataFrame:
    """Reads several tables as one, under the identifiers asked for.

    entities (unique_identifier, group_id, attributes) choose a table by rule; assets (unique_identifier, group_id,
    exchange) say under which identifier the group is stored there. Each table is read once for its own groups; rows
    come back under the entity's identifier. Entities without a rule, or a group with two assets on one exchange, raise.
    """
    chosen = translate(entities, rules)
    lost = chosen.where("source_table IS NULL").limit(1).collect()
    if lost:
        raise ValueError(f"no rule for {lost[0][KEY]}")
    a = assets.select(F.col(KEY).alias("stored_as"), F.col("group_id").alias("_g"), F.col("exchange").alias("_x"))
    pairs = chosen.join(a, (F.col("group_id") == F.col("_g")) & (F.col("source_exchange").isNull() | (F.col("source_exchange") == F.col("_x"))), "left")
    twice = pairs.groupBy(KEY).agg(F.count("stored_as").alias("n")).where("n <> 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][KEY]} is stored {twice[0]['n']} times")
    out = None
    for table in dict.fromkeys(r.table for r in rules):
        mapping = pairs.where(F.col("source_table") == table).select("stored_as", F.col(KEY).alias("asked_as"))
        part = map_keys(read(table), mapping, "stored_as", "asked_as")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
