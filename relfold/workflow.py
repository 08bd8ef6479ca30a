"""The whole run: load, discover, build features, select, validate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from relfold.modeling.selection import Selection, select_features
from relfold.modeling.training import TreeSettings
from relfold.operators.actions import STATUS_SCHEMA, apply_actions
from relfold.operators.builders import apply_builders
from relfold.operators.checks import output_checks, require
from relfold.operators.enrich import enrich_roots
from relfold.operators.keyed import DEFAULT_SKEW, SkewPolicy, bucketed, without_tokens
from relfold.operators.profile import as_metadata, key_profile
from relfold.operators.relationships import (
    UNIQUE_THRESHOLD,
    JoinEdge,
    both_directions,
    find_relationships,
    grow_tree,
    rank_candidates,
    tables_to_plan,
    unreachable,
)
from relfold.operators.specs import apply_specs
from relfold.plans.models import FeatureBuilder, FeatureSpec, TablePlan
from relfold.sources.files import Bundle


def named_like_id(table: str, column: str) -> bool:
    return column == "id" or column.endswith("_id")


@dataclass(frozen=True)
class Discovery:
    keys: DataFrame
    relationships: DataFrame
    edges: list[JoinEdge]
    skipped: list[str]
    unique_keys: frozenset[tuple[str, str]]

    def tables_to_plan(self, exclude: Collection[str] = ("data_dictionary",)) -> list[str]:
        return tables_to_plan(self.edges, exclude)


def discover(
    bundle: Bundle,
    is_key: Callable[[str, str], bool] = named_like_id,
    prefer: Iterable[tuple[str, str]] = (),
    threshold: float = UNIQUE_THRESHOLD,
    strict: bool = True,
) -> Discovery:
    """Profile the key columns, find the joinable pairs and grow the join tree from the train root. A bundle that came
    through a store is profiled from what the store knows; it reads only files that it has not seen."""
    tables = {bundle.train_name: bundle.train, **bundle.additional}
    if bundle.store:
        keys = bundle.store.key_profile(is_key, list(tables), threshold)
    else:
        keys = as_metadata(key_profile(tables, is_key, threshold))
    relationships = find_relationships(keys, bundle.train_name, bundle.test_name, threshold, strict)
    ranked = rank_candidates(both_directions(relationships, threshold, strict), prefer)
    edges = grow_tree(ranked, bundle.train_name)
    return Discovery(
        keys,
        relationships,
        edges,
        unreachable(tables, edges, bundle.train_name, bundle.test_name),
        frozenset((r["table_name"], r["column_name"]) for r in keys.where("unique_ratio = 1").collect()),
    )


@dataclass
class Built:
    roots: dict[str, DataFrame]
    statuses: list[tuple] = field(default_factory=list)

    def status_frame(self) -> DataFrame:
        return next(iter(self.roots.values())).sparkSession.createDataFrame(self.statuses, STATUS_SCHEMA)


def busiest_key(
    roots: Mapping[str, DataFrame], plans: Sequence[TablePlan], builders: Sequence[FeatureBuilder], edges: Sequence[JoinEdge]
) -> str | None:
    """The key of all roots on which most joins are made, if there are two of them or more: actions on a key are one
    join, each builder is one, and so are the tree's edges on a key."""
    uses = Counter({a.join_key: 1 for plan in plans for a in plan.actions if a.action_type != "skip"})
    uses.update(b.keys[0] for b in builders if len(b.keys) == 1)
    uses.update({e.parent_key for e in edges})
    shared = [k for k in uses if uses[k] > 1 and all(k in df.columns for df in roots.values())]
    return max(sorted(shared), key=lambda k: uses[k], default=None)


def build_features(
    bundle: Bundle,
    discovery: Discovery,
    plans: Sequence[TablePlan] = (),
    specs: Sequence[FeatureSpec] = (),
    builders: Sequence[FeatureBuilder] = (),
    join_tree: bool = False,
    target: str = "target",
    is_key: Callable[[str, str], bool] = named_like_id,
    skew: SkewPolicy | None = DEFAULT_SKEW,
) -> Built:
    """Builders, then specs, then actions, then (if asked) the whole join tree, on both roots. Where several of these
    join on one key of the roots, the roots are stored in buckets of it first."""
    tables = dict(bundle.tables.items())
    roots: Mapping[str, DataFrame] = bundle.roots
    key = busiest_key(bundle.roots, plans, builders, discovery.edges if join_tree else ())
    if key and skew is None:
        roots = {name: bucketed(df, key) for name, df in roots.items()}
    bare = {name: df for name, df in tables.items() if name not in roots}
    tables = {**bare, **roots}
    built = apply_builders(roots, {**tables, **bundle.roots}, builders, target, skew=skew)
    statuses = list(built.statuses)
    built = apply_specs(built.roots, tables, specs, discovery.unique_keys, skew, share=True, is_key=lambda c: is_key("", c))
    statuses += built.statuses
    built = apply_actions(built.roots, bundle.additional, plans, target, discovery.unique_keys, skew=skew, share=True)
    statuses += built.statuses
    roots = built.roots
    if join_tree:
        roots = enrich_roots(roots, bundle.additional, discovery.edges, skew=skew)
    return Built({name: without_tokens(df) for name, df in roots.items()}, statuses)


def run(
    bundle: Bundle,
    output_folder: str,
    plans: Sequence[TablePlan] = (),
    specs: Sequence[FeatureSpec] = (),
    builders: Sequence[FeatureBuilder] = (),
    join_tree: bool = False,
    target: str = "target",
    id_column: str = "row_id",
    settings: TreeSettings = TreeSettings(),
    output_format: str = "csv",
    is_key: Callable[[str, str], bool] = named_like_id,
    prefer: Iterable[tuple[str, str]] = (),
    threshold: float = UNIQUE_THRESHOLD,
    strict: bool = True,
    skew: SkewPolicy | None = DEFAULT_SKEW,
    exact_split: bool = True,
) -> Selection:
    """From a bundle to the two written outputs: base columns plus the strongest features.

    Tables are not kept in memory: columnar files are read as often as they are needed, and a bundle loaded through a
    ``TableStore`` has a columnar copy of every delimited one."""
    discovery = discover(bundle, is_key, prefer, threshold, strict)
    built = build_features(bundle, discovery, plans, specs, builders, join_tree, target, is_key, skew)
    base_columns = {name: df.columns for name, df in bundle.roots.items()}
    selection = select_features(
        built.roots, base_columns, target, id_column, settings=settings,
        output_folder=output_folder, output_format=output_format, exact_split=exact_split,
    )
    require(output_checks(bundle.roots, selection.outputs, written=selection.written, base_counts=bundle.counts))
    return selection
