"""Plan and spec records. Field names follow the JSON documents they are read from."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Words and field names of the plan and spec documents.
ACTION_TYPES = ("direct_join", "aggregate_numeric", "aggregate_categorical", "skip")
SPEC_OPERATIONS = ("count", "nunique", "sum", "mean", "min", "max", "std", "ratio", "mode_ratio")


def _required(name: str, value: str | None) -> str:
    text = (value or "").strip()
    if not text:
        raise ValueError(f"{name} must not be blank")
    return text


def _items(values: Sequence[str] | None) -> tuple[str, ...]:
    return tuple(text for text in (v.strip() for v in values or ()) if text)


@dataclass(frozen=True)
class Action:
    """One feature action on a source table.

    ``values`` fixes the category values of top_k_frequency / top_k_one_hot per column, so that
    output names do not depend on the data.
    """

    action_type: str
    source_table: str
    join_key: str
    columns: tuple[str, ...] = ()
    aggregations: tuple[str, ...] = ()
    top_k: int | None = None
    reason: str = "given"
    values: Mapping[str, Sequence[str]] | None = None

    def __post_init__(self) -> None:
        kind = self.action_type.strip()
        if kind not in ACTION_TYPES:
            raise ValueError(f"unknown action_type {kind!r}")
        object.__setattr__(self, "action_type", kind)
        for name in ("source_table", "join_key", "reason"):
            object.__setattr__(self, name, _required(name, getattr(self, name)))
        for name in ("columns", "aggregations"):
            object.__setattr__(self, name, _items(getattr(self, name)))


@dataclass(frozen=True)
class TablePlan:
    source_table: str
    join_key: str
    relation_type: str
    requires_aggregation: bool
    actions: tuple[Action, ...] = ()
    join_path: tuple[str, ...] = ()
    parent_table: str | None = None
    comment: str | None = None

    def __post_init__(self) -> None:
        for name in ("source_table", "join_key", "relation_type"):
            object.__setattr__(self, name, _required(name, getattr(self, name)))
        object.__setattr__(self, "join_path", _items(self.join_path))
        object.__setattr__(self, "comment", (self.comment or "").strip() or None)


@dataclass(frozen=True)
class Aggregation:
    """``operation`` over ``source_column`` per ``group_by``, on rows where ``filter_expression``."""

    source_column: str
    operation: str
    group_by: tuple[str, ...]
    feature_name: str
    source_table: str | None = None
    filter_expression: str | None = None

    def __post_init__(self) -> None:
        if self.operation not in SPEC_OPERATIONS:
            raise ValueError(f"unknown operation {self.operation!r}")
        object.__setattr__(self, "group_by", _items(self.group_by))
        if not self.group_by:
            raise ValueError(f"feature {self.feature_name!r} has no group_by columns")


@dataclass(frozen=True)
class FeatureSpec:
    title: str
    aggregations: tuple[Aggregation, ...]
    join_paths: tuple[tuple[str, ...], ...] = ()
    required_tables: tuple[str, ...] = ()
    hypothesis: str = ""
    notes: str | None = None

    @classmethod
    def from_dict(cls, data: Mapping) -> "FeatureSpec":
        """Both spellings of the grouping list are accepted."""
        aggregations = tuple(
            Aggregation(
                source_column=a["source_column"],
                operation=a["operation"],
                group_by=tuple(a.get("group_by") or a.get("group_by_columns") or ()),
                feature_name=a["feature_name"],
                source_table=a.get("source_table"),
                filter_expression=a.get("filter_expression"),
            )
            for a in data.get("aggregations") or ()
        )
        return cls(
            title=data["title"],
            aggregations=aggregations,
            join_paths=tuple(tuple(p) for p in data.get("join_paths") or ()),
            required_tables=tuple(data.get("required_tables") or ()),
            hypothesis=data.get("hypothesis") or "",
            notes=data.get("notes"),
        )


@dataclass(frozen=True)
class FeatureBuilder:
    """User code ``build(root, tables) -> DataFrame`` with one row per ``keys``."""

    title: str
    keys: tuple[str, ...]
    build: Callable[[DataFrame, Mapping[str, DataFrame]], DataFrame] = field(repr=False)
