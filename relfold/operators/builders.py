"""User-supplied feature builders over Spark DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from relfold.operators.actions import APPLIED, FAILED, ActionResult
from relfold.operators.keyed import DEFAULT_SKEW, KeyedFrame, SkewPolicy, attach, guarded, is_unique, keyed, without_tokens
from relfold.plans.models import FeatureBuilder
from relfold.session import stored


class BuilderError(ValueError):
    """A builder result that cannot be joined back."""


def merge_feature(
    base: DataFrame,
    feature: DataFrame,
    keys: Sequence[str],
    skew: SkewPolicy | None = DEFAULT_SKEW,
) -> DataFrame:
    """Left join on composite keys that keeps the rows of the base as they are.

    Missing keys and colliding columns raise at once; a repeated key makes the job fail, as the
    uniqueness test is part of the plan.
    """
    _check_columns(base, feature, keys)
    return attach(base, keys, [guarded(feature, keys)], skew)


def _check_columns(base: DataFrame, feature: DataFrame, keys: Sequence[str]) -> None:
    for side, df in (("base", base), ("feature", feature)):
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise BuilderError(f"keys {missing} are missing on the {side} side")
    both = [c for c in feature.columns if c in base.columns and c not in keys]
    if both:
        raise BuilderError(f"columns {both} exist on both sides")


def apply_builders(
    roots: Mapping[str, DataFrame],
    tables: Mapping[str, DataFrame],
    builders: Sequence[FeatureBuilder],
    target: str = "target",
    on_error: str = "skip",
    skew: SkewPolicy | None = DEFAULT_SKEW,
    store_roots_every: int = 8,
) -> ActionResult:
    """Run builders in turn; each sees the features of those before it, never the label.

    The train root is what a builder gets; its result is joined to every root. A result is written
    once to the checkpoint folder; the uniqueness check and all roots read it from there. The roots
    are stored after every few builders, as later builders read them and their plans grow. A failing
    builder leaves all roots alone; ``on_error`` "raise" ends the run instead.
    """
    current = dict(roots)
    first = next(iter(roots))
    statuses: list[tuple] = []
    applied = 0
    for i, builder in enumerate(builders):
        shown = {name: df.drop(target) if name in roots else df for name, df in tables.items()}
        keys = list(builder.keys)
        try:
            feature = builder.build(without_tokens(current[first].drop(target)), shown)
            if not isinstance(feature, DataFrame):
                raise BuilderError("the builder did not return a DataFrame")
            for root in current.values():
                _check_columns(root, feature, keys)
            feature = stored(feature)
            if not is_unique(feature, keys):
                raise BuilderError(f"more than one row for a key of {keys}")
            frame: KeyedFrame = keyed(feature, keys)
            updated = {name: attach(root, keys, [frame], skew) for name, root in current.items()}
            note = "result is empty" if feature.isEmpty() else ""
        except Exception as error:  # a builder is foreign code and may raise anything
            if on_error == "raise":
                raise
            statuses.append((i, builder.title, "builder", ",".join(keys), FAILED, (str(error).splitlines() or [type(error).__name__])[0]))
            continue
        current = updated
        applied += 1
        if applied % store_roots_every == 0:
            current = {name: stored(root) for name, root in current.items()}
        statuses.append((i, builder.title, "builder", ",".join(keys), APPLIED, note))
    return ActionResult(current, statuses)
