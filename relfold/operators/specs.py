"""Execution of multi-table feature specs.

A spec names a source table (the finest grain), the tables its columns may come from, and measures
per group of columns. Columns missing on the source are looked up through shared keys that are unique
on the far side, so rows never multiply; then one grouping computes all measures of a group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from relfold.functions.columns import quoted
from relfold.operators.actions import APPLIED, FAILED, ActionResult
from relfold.operators.aggregates import Measure, aggregate_by_key
from relfold.operators.keyed import DEFAULT_SKEW, KeyedFrame, SkewPolicy, attach, attach_grouped, is_unique, keyed
from relfold.plans.models import Aggregation, FeatureSpec
from relfold.session import stored

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_KINDS = {"ratio": "size", "mode_ratio": "mode_ratio"}


class KeyFacts:
    """Which (table, key) pairs are unique: told by the caller or checked once when asked."""

    def __init__(self, tables: Mapping[str, DataFrame], known: Collection[tuple[str, str]] = ()):
        self._tables = tables
        self._facts = {pair: True for pair in known}

    def unique(self, table: str, key: str) -> bool:
        pair = (table, key)
        if pair not in self._facts:
            self._facts[pair] = is_unique(self._tables[table], [key])
        return self._facts[pair]


def named_like_key(column: str) -> bool:
    return column == "id" or column.endswith("_id")


@dataclass(frozen=True)
class Step:
    """A join through ``key`` to ``table``, which is unique on it, for some of its columns."""

    table: str
    key: str
    columns: tuple[str, ...]


def plan_steps(
    present: Sequence[str],
    needed: Sequence[str],
    tables: Mapping[str, DataFrame],
    candidates: Sequence[str],
    facts: KeyFacts,
    is_key: Callable[[str], bool] = named_like_key,
) -> list[Step]:
    """The joins that bring the needed columns, by the shortest way to each. Where a column comes from depends on the
    present columns and the candidates alone, so several needs on one table can be met by one plan."""
    wanted = [c for c in dict.fromkeys(needed) if c not in present]
    steps: list[tuple[str, str]] = []
    seen_columns = list(present)
    origin: dict[str, int] = {}
    open_tables = [t for t in dict.fromkeys(candidates) if t in tables]
    while any(c not in seen_columns for c in wanted):
        step = next(
            (
                (table, key)
                for table in open_tables
                for key in seen_columns
                if key in tables[table].columns and is_key(key) and facts.unique(table, key)
            ),
            None,
        )
        if step is None:
            absent = [c for c in wanted if c not in seen_columns]
            raise ValueError(f"columns {absent} cannot be reached through unique keys")
        open_tables.remove(step[0])
        for column in tables[step[0]].columns:
            if column not in seen_columns:
                seen_columns.append(column)
                origin[column] = len(steps)
        steps.append(step)
    # Keep only the joins that lead to a wanted column.
    used: set[int] = set()
    todo = [c for c in wanted if c in origin]
    while todo:
        index = origin[todo.pop()]
        if index not in used:
            used.add(index)
            if steps[index][1] in origin:
                todo.append(steps[index][1])
    carried = set(wanted) | {steps[i][1] for i in used}
    return [
        Step(*steps[i], tuple(c for c in tables[steps[i][0]].columns if origin.get(c) == i and c in carried)) for i in sorted(used)
    ]


def bring_columns(
    base: DataFrame,
    needed: Sequence[str],
    tables: Mapping[str, DataFrame],
    candidates: Sequence[str],
    facts: KeyFacts,
    skew: SkewPolicy | None = DEFAULT_SKEW,
    is_key: Callable[[str], bool] = named_like_key,
) -> DataFrame:
    """Add the needed columns by left joins through unique keys, by the shortest way to each."""
    result = base
    for step in plan_steps(base.columns, needed, tables, candidates, facts, is_key):
        result = attach(result, [step.key], [keyed(tables[step.table], [step.key], step.columns)], skew)
    wanted = [c for c in dict.fromkeys(needed) if c not in base.columns]
    return result.select(*[quoted(c) for c in [*base.columns, *wanted]])


@dataclass
class Bridges:
    """Source tables widened by the columns that groupings need, once for all groupings of all specs.

    Needs are collected first (``ask``), from schemas alone; a frame is widened by everything that was asked of its
    table and candidates when it is first read (``frame``), and stored if more than one reader will come.
    """

    tables: Mapping[str, DataFrame]
    facts: KeyFacts
    skew: SkewPolicy | None = DEFAULT_SKEW
    is_key: Callable[[str], bool] = named_like_key
    _needs: dict[tuple, dict[str, None]] = field(default_factory=dict)
    _readers: dict[tuple, int] = field(default_factory=dict)
    _frames: dict[tuple, DataFrame] = field(default_factory=dict)

    def ask(self, table: str, candidates: Sequence[str], needed: Sequence[str], readers: int = 1) -> None:
        """Raises if the columns cannot be reached."""
        plan_steps(self.tables[table].columns, needed, self.tables, candidates, self.facts, self.is_key)
        place = (table, tuple(candidates))
        self._needs.setdefault(place, {}).update(dict.fromkeys(needed))
        self._readers[place] = self._readers.get(place, 0) + readers

    def frame(self, table: str, candidates: Sequence[str], needed: Sequence[str]) -> DataFrame:
        place = (table, tuple(candidates))
        if place not in self._frames:
            columns = list(self._needs[place])
            wide = bring_columns(self.tables[table], columns, self.tables, candidates, self.facts, self.skew, self.is_key)
            wide = wide.select(*[quoted(c) for c in columns])
            self._frames[place] = stored(wide) if self._readers[place] > 1 else wide
        return self._frames[place].select(*[quoted(c) for c in dict.fromkeys(needed)])


def _measure(item: Aggregation) -> Measure:
    kind = _KINDS.get(item.operation, item.operation)
    column = None if kind == "size" else item.source_column
    return Measure(kind, item.feature_name, column, where=item.filter_expression)


def group_frame(source: DataFrame, group_by: Sequence[str], items: Sequence[Aggregation]) -> KeyedFrame:
    """All measures of one grouping. ``ratio`` is the rows of the group over the rows of all groups
    with the same first key."""
    frame = aggregate_by_key(source, group_by, [_measure(i) for i in items])
    ratios = [i.feature_name for i in items if i.operation == "ratio"]
    if not ratios:
        return frame
    if len(group_by) == 1:
        shares = {n: F.when(quoted(n) > 0, F.lit(1.0)) for n in ratios}
        return KeyedFrame(frame.frame.withColumns(shares), frame.keys, frame.null_safe)
    # Totals come from the grouped rows, not from the source: one row per group and first key.
    first = Window.partitionBy(*[c for c in frame.tokens if c in ("__key0", "__null0")])
    shares = {n: F.try_divide(quoted(n).cast("double"), F.sum(quoted(n)).over(first).cast("double")) for n in ratios}
    return KeyedFrame(frame.frame.withColumns(shares), frame.keys, frame.null_safe)


def _source_table(item: Aggregation, spec: FeatureSpec, tables: Mapping[str, DataFrame]) -> str:
    """The named table, else the last table of a join path that has the column."""
    if item.source_table:
        if item.source_table not in tables:
            raise ValueError(f"unknown table {item.source_table}")
        return item.source_table
    named = [t for path in sorted(spec.join_paths, key=len, reverse=True) for t in reversed(path)]
    for table in [*named, *spec.required_tables]:
        if table in tables and item.source_column in tables[table].columns:
            return table
    raise ValueError(f"no table of spec {spec.title!r} has column {item.source_column!r}")


@dataclass(frozen=True)
class Grouping:
    """Measures of a spec over one table and grouping, and the columns they need."""

    table: str
    group_by: tuple[str, ...]
    items: tuple[Aggregation, ...]
    candidates: tuple[str, ...]
    needed: tuple[str, ...]


def spec_groupings(spec: FeatureSpec, tables: Mapping[str, DataFrame]) -> list[Grouping]:
    """The groupings of a spec over ``tables``, from schemas alone."""
    named = [t for path in spec.join_paths for t in path] + list(spec.required_tables)
    candidates = [t for t in dict.fromkeys(named) if t in tables]
    groups: dict[tuple[str, tuple[str, ...]], list[Aggregation]] = {}
    for item in spec.aggregations:
        groups.setdefault((_source_table(item, spec, tables), item.group_by), []).append(item)
    found = []
    for (table, group_by), items in groups.items():
        known = {c for t in [table, *candidates] for c in tables[t].columns}
        needed = list(group_by)
        for item in items:
            needed.append(item.source_column)
            needed += [w for w in _WORD.findall(item.filter_expression or "") if w in known]
        others = tuple(t for t in candidates if t != table)
        found.append(Grouping(table, tuple(group_by), tuple(items), others, tuple(dict.fromkeys(needed))))
    return found


def spec_frames(
    spec: FeatureSpec,
    tables: Mapping[str, DataFrame],
    facts: KeyFacts,
    roots: Collection[str] = ("train", "test"),
    skew: SkewPolicy | None = DEFAULT_SKEW,
    is_key: Callable[[str], bool] = named_like_key,
    bridges: Bridges | None = None,
) -> dict[tuple[str, ...], list[KeyedFrame]]:
    """Frames of a spec per group_by. Root tables are not read: their rows carry the label. ``bridges`` must have been
    asked for what the spec needs; without them it has its own."""
    usable = {name: df for name, df in tables.items() if name not in roots}
    groupings = spec_groupings(spec, usable)
    if bridges is None:
        bridges = Bridges(usable, facts, skew, is_key)
        for g in groupings:
            bridges.ask(g.table, g.candidates, g.needed)
    frames: dict[tuple[str, ...], list[KeyedFrame]] = {}
    for g in groupings:
        source = bridges.frame(g.table, g.candidates, g.needed)
        frames.setdefault(g.group_by, []).append(group_frame(source, g.group_by, g.items))
    return frames


def apply_specs(
    roots: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame],
    specs: Sequence[FeatureSpec],
    unique_keys: Collection[tuple[str, str]] = (),
    skew: SkewPolicy | None = DEFAULT_SKEW,
    share: bool = False,
    is_key: Callable[[str], bool] = named_like_key,
) -> ActionResult:
    """Join the features of every spec to all roots alike, or not at all.

    A grouping column the roots lack (the category of an item, say) is looked up for the join and
    dropped again. Each source table is widened once for the groupings of all specs, and stored if several read it.
    ``share`` computes each frame once and stores it for all roots.
    """
    usable = {name: df for name, df in tables.items() if name not in roots}
    facts = KeyFacts(usable, unique_keys)
    bridges = Bridges(usable, facts, skew, is_key)
    problems: dict[int, str] = {}
    for i, spec in enumerate(specs):
        try:
            groupings = spec_groupings(spec, usable)
            for g in groupings:
                plan_steps(usable[g.table].columns, g.needed, usable, g.candidates, facts, is_key)
            for g in groupings:
                # Without stored frames, each root computes a grouping for itself.
                bridges.ask(g.table, g.candidates, g.needed, 1 if share else len(roots))
        except (ValueError, TypeError) as error:
            problems[i] = str(error)
    current = dict(roots)
    statuses: list[tuple] = []
    for i, spec in enumerate(specs):
        try:
            if i in problems:
                raise ValueError(problems[i])
            frames = spec_frames(spec, tables, facts, tuple(roots), skew, is_key, bridges)
            if share:
                frames = {keys: [f.stored() for f in found] for keys, found in frames.items()}
            needed = [c for keys in frames for c in keys]
            named = [t for path in spec.join_paths for t in path] + list(spec.required_tables)
            updated = {}
            for name, root in current.items():
                widened = bring_columns(root, needed, usable, named, facts, skew, is_key)
                extra = [c for c in widened.columns if c not in root.columns]
                updated[name] = attach_grouped(widened, frames, skew).drop(*extra)
        except (ValueError, TypeError) as error:
            statuses.append((i, spec.title, "spec", "", FAILED, str(error)))
            continue
        current = updated
        statuses.append((i, spec.title, "spec", ",".join(dict.fromkeys(needed)), APPLIED, ""))
    return ActionResult(current, statuses)


def category_families(
    category: str,
    owner: str = "user_id",
    item: str = "product_id",
    repeat_flag: str = "reordered",
    source_table: str = "order_items",
    join_path: Sequence[str] = ("train", "orders", "order_items", "products"),
) -> FeatureSpec:
    """Count, share, distinct items and repeat rate of an owner's history per category."""
    group = (owner, category)
    prefix = f"{owner}_{category}"

    def measure(column: str, operation: str, name: str) -> Aggregation:
        return Aggregation(column, operation, group, f"{prefix}_{name}", source_table)

    return FeatureSpec(
        title=f"history of {owner} by {category}",
        aggregations=(
            measure(item, "count", "count"),
            measure(item, "ratio", "share"),
            measure(item, "nunique", "distinct"),
            measure(repeat_flag, "mean", "repeat_rate"),
        ),
        join_paths=(tuple(join_path),),
    )
