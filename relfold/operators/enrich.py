"""Enrichment of a root table along a join tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from relfold.functions.columns import feature_name, quoted
from relfold.operators.aggregates import aggregate_by_key, automatic_measures
from relfold.operators.keyed import (
    DEFAULT_SKEW,
    KeyedFrame,
    SkewPolicy,
    attach,
    attach_grouped,
    with_tokens,
)
from relfold.operators.relationships import JoinEdge
from relfold.session import shuffles_released


def prefixed(table: str, source: DataFrame, key: str, columns: Sequence[str] | None = None, null_safe: bool = True) -> KeyedFrame:
    """Every non-key column under ``{table}__{column}``; only named columns if given."""
    wanted = source.columns if columns is None else list(dict.fromkeys(columns))
    missing = [c for c in [key, *wanted] if c not in source.columns]
    if missing:
        raise ValueError(f"table {table!r} has no columns {missing}")
    payload = [quoted(c).alias(feature_name(table, c)) for c in wanted if c != key]
    return KeyedFrame(with_tokens(source, [key], null_safe, payload), (key,), null_safe)


def direct_enrich(base: DataFrame, table: str, source: DataFrame, key: str, base_key: str | None = None,
                  null_safe: bool = True, skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """Left join of a dimension whose key is unique."""
    return attach(base, [base_key or key], [prefixed(table, source, key, null_safe=null_safe)], skew)


def aggregate_enrich(base: DataFrame, table: str, source: DataFrame, key: str, base_key: str | None = None,
                     exclude_ids: bool = False, approx_distinct: bool = False, skew: SkewPolicy | None = DEFAULT_SKEW) -> DataFrame:
    """Left join of a child table reduced to one row per key first."""
    measures = automatic_measures(table, source, key, exclude_ids)
    frame = aggregate_by_key(source, [key], measures, approx_distinct=approx_distinct)
    return attach(base, [base_key or key], [frame], skew)


def resolve_parent_key(columns: Sequence[str], edge: JoinEdge) -> str | None:
    """``parent_key`` on the base, else its prefixed form, else the edge cannot be joined."""
    for name in (edge.parent_key, feature_name(edge.parent_table, edge.parent_key)):
        if name in columns:
            return name
    return None


@dataclass
class _Planned:
    edge: JoinEdge
    frame: KeyedFrame
    inner: dict[tuple[str, ...], list["_Planned"]] = field(default_factory=dict)


@dataclass
class _Layout:
    """Frames per base key, and the columns they add, in tree order."""

    groups: dict[tuple[str, ...], list[KeyedFrame]]
    added: list[str]


def _lay_out(
    base_columns: Sequence[str],
    tables: Mapping[str, DataFrame],
    edges: Sequence[JoinEdge],
    exclude_ids: bool,
    approx_distinct: bool,
    skew: SkewPolicy | None,
    share: bool,
) -> _Layout:
    """Decide from the schemas alone which frame is joined where."""
    columns = list(base_columns)
    owner: dict[str, _Planned] = {}
    root_groups: dict[tuple[str, ...], list[_Planned]] = {}
    for edge in edges:
        source = tables.get(edge.child_table)
        key = resolve_parent_key(columns, edge)
        if source is None or key is None:
            continue
        null_safe = edge.child_has_null_keys
        if edge.requires_aggregation:
            measures = automatic_measures(edge.child_table, source, edge.child_key, exclude_ids)
            frame = aggregate_by_key(source, [edge.child_key], measures, null_safe, approx_distinct)
            frame = frame.stored() if share else frame
        else:
            frame = prefixed(edge.child_table, source, edge.child_key, null_safe=null_safe)
        if key != edge.child_key:
            # A key reached under a prefixed name stays visible under the child's own name.
            frame = frame.with_key_column()
        added = [c for c in frame.payload if c not in columns]
        planned = _Planned(edge, frame.pick(added))
        parent = owner.get(key)
        home = parent.inner if parent and not null_safe else root_groups
        home.setdefault((key,), []).append(planned)
        columns += added
        if not edge.requires_aggregation:
            owner.update(dict.fromkeys(added, planned))
    groups = {keys: [_folded(p, skew) for p in planned] for keys, planned in root_groups.items()}
    return _Layout(groups, columns[len(base_columns):])


def enrich_tree(
    base: DataFrame,
    tables: Mapping[str, DataFrame],
    edges: Sequence[JoinEdge],
    exclude_ids: bool = False,
    approx_distinct: bool = False,
    skew: SkewPolicy | None = DEFAULT_SKEW,
    store_children: bool = False,
) -> DataFrame:
    """Join every edge of the tree onto the base, aggregating children where a join would add rows.

    Frames that hang on the same base key are joined together, so the base is shuffled once per key.
    A dimension of a dimension is joined to the smaller dimension before that meets the base, unless
    its key has nulls: there a base row without a parent matches the null row, which only the join
    on the base can tell. ``store_children`` aggregates the children one after the other first, and stores them: their
    shuffles, which are larger than what comes of them, are then not on disk all at once.
    """
    with shuffles_released(base.sparkSession) if store_children else nullcontext():
        layout = _lay_out(base.columns, tables, edges, exclude_ids, approx_distinct, skew, share=store_children)
    return attach_grouped(base, layout.groups, skew).select(*[quoted(c) for c in [*base.columns, *layout.added]])


def enrich_roots(
    roots: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame],
    edges: Sequence[JoinEdge],
    exclude_ids: bool = False,
    approx_distinct: bool = False,
    skew: SkewPolicy | None = DEFAULT_SKEW,
) -> dict[str, DataFrame]:
    """``enrich_tree`` for several roots: each aggregated child is computed once, written to the
    checkpoint folder and shared."""
    columns = list(dict.fromkeys(c for df in roots.values() for c in df.columns))
    layout = _lay_out(columns, tables, edges, exclude_ids, approx_distinct, skew, share=len(roots) > 1)
    wide = {}
    for name, base in roots.items():
        joined = attach_grouped(base, layout.groups, skew)
        wide[name] = joined.select(*[quoted(c) for c in [*base.columns, *layout.added]])
    return wide


def _folded(planned: _Planned, skew: SkewPolicy | None) -> KeyedFrame:
    """A dimension with its own dimensions already joined to it."""
    frame = planned.frame.frame
    for keys, inner in planned.inner.items():
        frame = attach(frame, keys, [_folded(p, skew) for p in inner], skew)
    return KeyedFrame(frame, planned.frame.keys, planned.frame.null_safe)


