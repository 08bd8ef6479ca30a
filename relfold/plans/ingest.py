"""Plans and specs out of free text that holds a JSON object.

Works on a whole column of responses: extraction, typing, cleaning and validation are expressions, so
each response costs one pass and the rejected ones come back as rows with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relfold.functions.columns import blank_to_null, trimmed_items
from relfold.plans.models import ACTION_TYPES, SPEC_OPERATIONS, Action, FeatureSpec, TablePlan

ACTIONS_TYPE = (
    "array<struct<action_type:string, source_table:string, join_key:string, "
    "columns:array<string>, aggregations:array<string>, top_k:int, reason:string>>"
)
PLAN_SCHEMA = (
    "source_table string, join_path array<string>, parent_table string, join_key string, "
    f"relation_type string, requires_aggregation boolean, comment string, actions {ACTIONS_TYPE}"
)
SPEC_SCHEMA = (
    "compiled_feature_specs array<struct<title string, hypothesis string, required_tables array<string>, "
    "join_paths array<array<string>>, notes string, "
    "aggregations array<struct<source_table string, source_column string, operation string, "
    "group_by array<string>, group_by_columns array<string>, feature_name string, filter_expression string>>>>"
)


def json_payload(text: Column) -> Column:
    """From the first opening to the last closing brace; null when there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def _blank(column: Column) -> Column:
    return F.coalesce(F.trim(column) == F.lit(""), F.lit(True))


def _parse(responses: DataFrame, text: str, schema: str) -> DataFrame:
    return (
        responses.withColumn("payload", json_payload(F.col(text)))
        .withColumn("__valid_json", F.try_parse_json("payload").isNotNull())
        .withColumn("parsed", F.when(F.col("__valid_json"), F.from_json("payload", schema)))
    )


def _split(parsed: DataFrame, error: Column) -> DataFrame:
    problem = (
        F.when(F.col("payload").isNull(), "no JSON object")
        .when(~F.col("__valid_json"), "invalid JSON")
        .otherwise(error)
    )
    return (
        parsed.withColumn("error", problem)
        .withColumn("is_valid", F.col("error").isNull())
        .drop("__valid_json")
    )


def parse_plans(responses: DataFrame, text: str = "text") -> DataFrame:
    """Responses plus payload, the cleaned plan, is_valid and error."""
    parsed = _parse(responses, text, PLAN_SCHEMA)
    plan = F.col("parsed")

    def clean_action(a: Column) -> Column:
        return F.struct(
            F.trim(a["action_type"]).alias("action_type"),
            F.trim(a["source_table"]).alias("source_table"),
            F.trim(a["join_key"]).alias("join_key"),
            F.coalesce(trimmed_items(a["columns"]), F.array().cast("array<string>")).alias("columns"),
            F.coalesce(trimmed_items(a["aggregations"]), F.array().cast("array<string>")).alias("aggregations"),
            a["top_k"].alias("top_k"),
            F.trim(a["reason"]).alias("reason"),
        )

    def bad_type(a: Column) -> Column:
        return ~F.coalesce(F.trim(a["action_type"]).isin(*ACTION_TYPES), F.lit(False))

    def bad_text(a: Column) -> Column:
        return _blank(a["source_table"]) | _blank(a["join_key"]) | _blank(a["reason"])

    actions = F.coalesce(plan["actions"], F.array().cast(ACTIONS_TYPE))
    error = (
        F.when(_blank(plan["source_table"]), "blank source_table")
        .when(_blank(plan["join_key"]), "blank join_key")
        .when(_blank(plan["relation_type"]), "blank relation_type")
        .when(plan["requires_aggregation"].isNull(), "requires_aggregation missing")
        .when(F.exists(actions, bad_type), "unknown action_type")
        .when(F.exists(actions, bad_text), "blank text in an action")
    )
    cleaned = F.struct(
        F.trim(plan["source_table"]).alias("source_table"),
        F.coalesce(trimmed_items(plan["join_path"]), F.array().cast("array<string>")).alias("join_path"),
        plan["parent_table"].alias("parent_table"),
        F.trim(plan["join_key"]).alias("join_key"),
        F.trim(plan["relation_type"]).alias("relation_type"),
        plan["requires_aggregation"].alias("requires_aggregation"),
        blank_to_null(plan["comment"]).alias("comment"),
        F.transform(actions, clean_action).alias("actions"),
    )
    checked = _split(parsed, error)
    return checked.withColumn("plan", F.when(F.col("is_valid"), cleaned)).drop("parsed")


def parse_specs(responses: DataFrame, text: str = "text") -> DataFrame:
    """Responses plus payload, the spec list, is_valid and error."""
    parsed = _parse(responses, text, SPEC_SCHEMA)
    specs = F.col("parsed")["compiled_feature_specs"]

    def bad_aggregation(a: Column) -> Column:
        grouping = F.coalesce(a["group_by"], a["group_by_columns"])
        unknown = ~F.coalesce(a["operation"].isin(*SPEC_OPERATIONS), F.lit(False))
        return unknown | _blank(a["source_column"]) | _blank(a["feature_name"]) | (F.coalesce(F.size(grouping), F.lit(0)) < 1)

    error = (
        F.when(specs.isNull(), "no compiled_feature_specs")
        .when(F.exists(specs, lambda s: _blank(s["title"])), "blank title")
        .when(F.coalesce(F.exists(specs, lambda s: F.exists(s["aggregations"], bad_aggregation)), F.lit(False)), "invalid aggregation")
    )
    return _split(parsed, error).withColumn("specs", F.when(F.col("is_valid"), specs)).drop("parsed")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("is_valid").drop("is_valid", "error")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("not is_valid").select(*[c for c in parsed.columns if c not in ("plan", "specs", "is_valid")])


def plans_from(parsed: DataFrame) -> list[TablePlan]:
    """Valid plans as records; a plan is what the driver needs to lay out a job."""
    plans = []
    for row in accepted(parsed).select("plan.*").toLocalIterator():
        data = row.asDict(recursive=True)
        actions = tuple(
            Action(**{**a, "columns": tuple(a["columns"]), "aggregations": tuple(a["aggregations"])})
            for a in data.pop("actions")
        )
        plans.append(TablePlan(**{**data, "join_path": tuple(data["join_path"])}, actions=actions))
    return plans


def specs_from(parsed: DataFrame) -> list[FeatureSpec]:
    rows = accepted(parsed).select(F.explode("specs").alias("spec")).toLocalIterator()
    return [FeatureSpec.from_dict(row["spec"].asDict(recursive=True)) for row in rows]
