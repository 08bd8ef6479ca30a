"""Execution of declarative feature actions on the train and test roots."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from relfold.operators.aggregates import (
    Measure,
    aggregate_by_key,
    categorical_measures,
    collect_top_values,
    numeric_measures,
)
from relfold.operators.enrich import prefixed
from relfold.operators.keyed import DEFAULT_SKEW, KeyedFrame, SkewPolicy, attach_grouped, is_unique
from relfold.plans.models import Action, TablePlan

STATUS_SCHEMA = "action_ord int, source_table string, action_type string, join_key string, status string, detail string"
APPLIED, SKIPPED, FAILED = "applied", "skipped", "failed"


@dataclass(frozen=True)
class ActionResult:
    roots: dict[str, DataFrame]
    statuses: list[tuple]

    def status_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.statuses, STATUS_SCHEMA)


def action_frames(
    source_table: str,
    source: DataFrame,
    key: str,
    actions: Sequence[Action],
    null_safe: bool = True,
    approx_distinct: bool = False,
) -> list[KeyedFrame]:
    """Frames of all actions on one (table, key): one for direct columns, one for all aggregates."""
    frames = []
    direct = [c for a in actions if a.action_type == "direct_join" for c in a.columns]
    if any(a.action_type == "direct_join" for a in actions):
        frames.append(prefixed(source_table, source, key, direct, null_safe))
    measures: dict[str, Measure] = {}
    ranked = _top_values(source, actions)
    aggregated = False
    for action in actions:
        if action.action_type == "aggregate_numeric":
            aggregated = True
            found = numeric_measures(source_table, source, action.columns, action.aggregations)
        elif action.action_type == "aggregate_categorical":
            aggregated = True
            values = _values_for(source, action, ranked)
            found = categorical_measures(source_table, source, action.columns, action.aggregations, values)
        else:
            continue
        for measure in found:
            measures.setdefault(measure.alias, measure)
    if aggregated:
        frames.append(aggregate_by_key(source, [key], list(measures.values()), null_safe, approx_distinct))
    return frames


def _wants_values(action: Action) -> bool:
    return action.action_type == "aggregate_categorical" and any(
        a in action.aggregations for a in ("top_k_frequency", "top_k_one_hot")
    )


def _open_columns(source: DataFrame, action: Action) -> list[str]:
    """Columns whose top values have to be looked up, as the action does not name them."""
    given = action.values or {}
    return [c for c in dict.fromkeys(action.columns) if c in source.columns and c not in given]


def _top_values(source: DataFrame, actions: Sequence[Action]) -> dict[str, list[str]]:
    """One look-up job for all actions; each action takes its own first k."""
    asked = [a for a in actions if _wants_values(a)]
    columns = list(dict.fromkeys(c for a in asked for c in _open_columns(source, a)))
    if not columns:
        return {}
    return collect_top_values(source, columns, max((a.top_k or 3) for a in asked))


def _values_for(source: DataFrame, action: Action, ranked: Mapping[str, list[str]]) -> dict[str, Sequence[str]]:
    if not _wants_values(action):
        return {}
    values = dict(action.values or {})
    for column in _open_columns(source, action):
        values[column] = ranked.get(column, [])[: action.top_k or 3]
    return values


def _problem(action: Action, roots: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]) -> tuple[str, str] | None:
    """(status, reason) if the action cannot be applied, from schemas alone."""
    if action.action_type == "skip":
        return SKIPPED, "marked skip"
    source = tables.get(action.source_table)
    if source is None:
        return FAILED, f"unknown table {action.source_table}"
    if action.join_key not in source.columns:
        return FAILED, f"key {action.join_key} is not in table {action.source_table}"
    without = [name for name, root in roots.items() if action.join_key not in root.columns]
    if without:
        return SKIPPED, f"key {action.join_key} is not in {', '.join(without)}"
    if action.action_type == "direct_join":
        missing = [c for c in action.columns if c not in source.columns]
        if missing:
            return FAILED, f"columns {missing} are not in table {action.source_table}"
    if action.action_type == "aggregate_numeric":
        try:
            numeric_measures(action.source_table, source, action.columns, action.aggregations)
        except ValueError as error:
            return FAILED, str(error)
    return None


def apply_actions(
    roots: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame],
    plans: Sequence[TablePlan],
    target: str = "target",
    unique_keys: Collection[tuple[str, str]] = (),
    approx_distinct: bool = False,
    skew: SkewPolicy | None = DEFAULT_SKEW,
    share: bool = False,
) -> ActionResult:
    """Apply every valid action to all roots alike, or to none of them.

    Actions on the same (table, key) become one grouping; frames on the same key are joined
    together. A direct join is refused if its source holds a key twice (``unique_keys`` names
    (table, key) pairs known to be unique, which saves the check). A root used as a source lends no
    label. Failing actions are reported and do not stop the others. ``share`` computes each aggregated
    frame once and stores it, which pays if all roots will be written.
    """
    sources = dict(tables)
    for name, root in roots.items():
        sources.setdefault(name, root.drop(target))
    statuses: list[tuple] = []
    accepted: dict[tuple[str, str], list[Action]] = {}
    checked: dict[tuple[str, str], bool] = {pair: True for pair in unique_keys}
    ordered = [a for plan in plans for a in plan.actions]
    for i, action in enumerate(ordered):
        pair = (action.source_table, action.join_key)
        problem = _problem(action, roots, sources)
        if problem is None and action.action_type == "direct_join":
            if pair not in checked:
                checked[pair] = is_unique(sources[pair[0]], [pair[1]])
            if not checked[pair]:
                problem = FAILED, f"key {pair[1]} of table {pair[0]} is not unique, the join would add rows"
        if problem is None:
            accepted.setdefault(pair, []).append(action)
            problem = APPLIED, ""
        statuses.append((i, action.source_table, action.action_type, action.join_key, *problem))
    groups: dict[tuple[str, ...], list[KeyedFrame]] = {}
    for (table, key), actions in accepted.items():
        frames = action_frames(table, sources[table], key, actions, approx_distinct=approx_distinct)
        # Direct frames are mere projections of a table; only aggregates are worth storing.
        aggregated = any(a.action_type != "direct_join" for a in actions)
        if share and aggregated:
            frames[-1] = frames[-1].stored()
        groups.setdefault((key,), []).extend(frames)
    joined = {name: attach_grouped(root, groups, skew) for name, root in roots.items()}
    return ActionResult(joined, statuses)

