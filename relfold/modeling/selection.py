"""Selection of the strongest numeric features and the final projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from relfold.functions.columns import quoted, split_columns
from relfold.modeling.metrics import auc_by_rank
from relfold.modeling.split import with_exact_holdout, with_holdout
from relfold.modeling.training import TreeModel, TreeSettings, fit_trees, top_features
from relfold.operators.checks import Counts, write_counted
from relfold.session import stored

KEPT_FEATURES = 5


@dataclass(frozen=True)
class Selection:
    selected: list[str]
    auc_all: float | None
    auc_selected: float | None
    importances: DataFrame
    outputs: dict[str, DataFrame]
    asked_rounds: int = 0
    kept_rounds_all: int = 0
    kept_rounds_selected: int = 0
    #: Counts of the outputs, observed as they were written.
    written: Mapping[str, Counts] = field(default_factory=dict)

    def summary(self) -> DataFrame:
        spark = self.importances.sparkSession
        return spark.createDataFrame(
            [(self.auc_all, self.auc_selected, self.selected, self.asked_rounds, self.kept_rounds_all, self.kept_rounds_selected)],
            "validation_auc_all double, validation_auc_selected double, selected array<string>, "
            "asked_rounds int, kept_rounds_all int, kept_rounds_selected int",
        )


def numeric_features(df: DataFrame, base_columns: Sequence[str]) -> list[str]:
    """Numeric columns that are not base columns, so neither identity nor label."""
    return split_columns(df, exclude=base_columns)[0]


def all_features(df: DataFrame, id_column: str = "row_id", target: str = "target", exclude: Sequence[str] = ()) -> list[str]:
    """Every column but identity, label and the excluded ones."""
    skipped = {id_column, target, *exclude}
    return [c for c in df.columns if c not in skipped]


def final_projection(df: DataFrame, base_columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Base columns, then the chosen features, each once."""
    columns = list(dict.fromkeys([*base_columns, *features]))
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing from the table")
    return df.select(*[quoted(c) for c in columns])


def rank_features(
    train: DataFrame,
    base_columns: Sequence[str],
    target: str = "target",
    id_column: str = "row_id",
    settings: TreeSettings = TreeSettings(),
    exact_split: bool = False,
    keep_split: bool = False,
) -> tuple[TreeModel, DataFrame, list[str]]:
    """Model on all numeric features, the split rows, and the features. ``keep_split`` stores the split rows, for what
    else is to read them."""
    features = numeric_features(train, base_columns)
    if not features:
        raise ValueError("no numeric feature column to train on")
    if target not in train.columns:
        raise ValueError(f"the training table has no {target!r}")
    rows = train.select(quoted(id_column), quoted(target), *[quoted(c) for c in features])
    split = with_exact_holdout(rows, target, id_column) if exact_split else with_holdout(rows, id_column)
    split = stored(split) if keep_split else split
    return fit_trees(split, features, target, settings, "is_holdout"), split, features


def holdout_auc(model: TreeModel, split: DataFrame, target: str = "target") -> float | None:
    scored = model.predict(split.where("is_holdout"), [target])
    return auc_by_rank(scored, "score", target).first()["auc"]


def select_features(
    roots: Mapping[str, DataFrame],
    base_columns: Mapping[str, Sequence[str]],
    target: str = "target",
    id_column: str = "row_id",
    keep: int = KEPT_FEATURES,
    settings: TreeSettings = TreeSettings(),
    output_folder: str | None = None,
    output_format: str = "parquet",
    exact_split: bool = False,
) -> Selection:
    """Rank the numeric features of the first root, keep the strongest, train again on those alone,
    and project every root to base columns plus kept features (written if a folder is given)."""
    first = next(iter(roots))
    for name, df in roots.items():
        missing = [c for c in base_columns[name] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} lacks base columns {missing}")
    features = numeric_features(roots[first], base_columns[first])
    kept = {}
    for name, df in roots.items():
        # All that follows reads these columns; the joins behind them are run once.
        kept[name] = stored(df.select(*[quoted(c) for c in [*base_columns[name], *features] if c in df.columns]))
        if kept[name].isEmpty():
            raise ValueError(f"{name} has no rows")
    train = kept[first]
    model, split, _ = rank_features(train, base_columns[first], target, id_column, settings, exact_split, keep_split=True)
    importances = model.importances(train.sparkSession)
    selected = [r["feature"] for r in top_features(importances, keep).collect()]
    outputs = {name: final_projection(df, base_columns[name], selected) for name, df in kept.items()}
    auc_all = holdout_auc(model, split, target)
    smaller = fit_trees(split, selected, target, settings, "is_holdout")
    auc_selected = holdout_auc(smaller, split, target)
    written = {}
    if output_folder:
        for name, df in outputs.items():
            path = f"{output_folder.rstrip('/')}/{name}.{output_format}"
            written[name] = write_counted(df, path, output_format, selected)
    return Selection(
        selected, auc_all, auc_selected, importances, outputs, model.asked, model.kept, smaller.kept, written
    )
