"""Deeply nested records as related flat tables.

Method: Dewey labelling. Every node of a record gets the path of ordinals that leads to it,
``0.2.1``; its parent's label is its own without the last ordinal, and the nodes of one schema
path form one table. Levels are unnested one after another by generators over VARIANT values,
so the whole chain is narrow: no shuffle, no Python.

Defined cases: unreadable, empty and null records have no nodes; a record or plan that was
stored as a JSON string is read; a value where a list is expected is a list of one; a null
inside a list keeps its position but is no node; rows delivered twice count once.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Level(NamedTuple):
    """A table of nodes: its name, and the fields of the parent whose lists it continues through."""

    name: str
    fields: tuple[str, ...]


#: Plans, modules, scenarios, steps and actions.
TEST_PLAN = (
    Level("module", ("modules",)),
    Level("scenario", ("scenarios",)),
    Level("step", ("steps", "given_steps", "when_steps", "then_steps")),
    Level("action", ("actions", "verifications")),
)


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def as_list(value: Column) -> Column:
    """The items of *value*: of a list its own, of a single value that one, of null none."""
    empty = F.array().cast("array<variant>")
    return (
        F.when(value.isNull() | F.is_variant_null(value), empty)
        .when(_kind(value).startswith("ARRAY"), F.coalesce(F.try_variant_get(value, "$", "array<variant>"), empty))
        .otherwise(F.array(value))
    )


def unwrapped(value: Column) -> Column:
    """*value*, or what it holds if it is JSON text within JSON."""
    return F.when(_kind(value) == "STRING", F.try_parse_json(F.try_variant_get(value, "$", "string"))).otherwise(value)


def roots(records: DataFrame, key: str, column: str, inner: str | None = None) -> DataFrame:
    """``key, value`` for every readable record that is an object; *inner* names the field that may hold it."""
    parsed = records.select(F.col(key).cast("long").alias(key), F.try_parse_json(F.col(column)).alias("record")).where("record is not null").select(key, unwrapped(F.col("record")).alias("record"))
    if inner:
        held = unwrapped(_field(F.col("record"), inner))
        parsed = parsed.select(key, F.when(held.isNotNull() & ~F.is_variant_null(held), held).otherwise(F.col("record")).alias("record"))
    return parsed.where(F.col("record").isNotNull() & _kind(F.col("record")).startswith("OBJECT")).select(key, F.col("record").alias("value"))


def children(parents: DataFrame, key: str, level: Level) -> DataFrame:
    """The nodes of *level* under *parents* (``key, label, value``), labelled by position."""
    items = F.concat(*(as_list(_field(F.col("value"), f)) for f in level.fields))
    below = parents.select(key, F.col("label").alias("parent"), F.posexplode(items).alias("position", "value"))
    label = F.when(F.col("parent") == "", F.col("position").cast("string")).otherwise(F.concat_ws(".", "parent", F.col("position").cast("string")))
    return below.where(F.col("value").isNotNull() & ~F.is_variant_null("value")).select(key, label.alias("label"), "parent", F.col("position").cast("int").alias("position"), "value")


def tables(records: DataFrame, key: str, column: str, levels: tuple[Level, ...] = TEST_PLAN, inner: str | None = "testPlan") -> dict[str, DataFrame]:
    """One table of ``key, label, parent, position, value`` for the records and for each level."""
    top = roots(records, key, column, inner).select(key, F.lit("").alias("label"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("position"), "value")
    out, above = {"record": top}, top
    for level in levels:
        above = children(above, key, level)
        out[level.name] = above
    return out


def parent_label(label: Column) -> Column:
    """The parent's label: all but the last ordinal."""
    return F.when(F.instr(label, ".") > 0, F.regexp_replace(label, r"\.\d+$", "")).otherwise(F.lit(""))


def ordinals(label: Column, *names: str) -> list[Column]:
    """The ordinals of *label* as columns."""
    parts = F.split(label, r"\.")
    return [F.get(parts, i).cast("int").alias(n) for i, n in enumerate(names)]


def text_of(value: Column, field: str) -> Column:
    """A scalar field of a node as text; lists and objects as JSON."""
    v = _field(value, field)
    return F.when(v.isNull() | F.is_variant_null(v), None).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def plan_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Saved test plans as plans, modules, scenarios, steps and actions with typed columns."""
    t = tables(records, "plan_id", "record_json")
    v = F.col("value")
    where = ["plan_id", "label", "parent", "position"]
    bare = F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return {
        "plans": t["record"].select("plan_id", text_of(v, "totalSteps").try_cast("double").alias("total_steps"), text_of(v, "estimatedTime").try_cast("double").alias("estimated_time")).distinct(),
        "modules": t["module"].select(*where, F.coalesce(text_of(v, "module"), bare).alias("module"), text_of(v, "priority").alias("priority")).distinct(),
        "scenarios": t["scenario"].select(*where, text_of(v, "id").alias("scenario_id"), F.coalesce(text_of(v, "name"), bare).alias("name"), *(text_of(v, c).alias(f"{c}_text") for c in ("given", "when", "then"))).distinct(),
        "steps": t["step"].select(*where, text_of(v, "order").try_cast("double").alias("step_order"), F.coalesce(text_of(v, "description"), bare).alias("description"), text_of(v, "type").alias("type")).distinct(),
        "actions": t["action"].select(*where, text_of(v, "type").alias("type"), text_of(v, "target").alias("target"), text_of(v, "value").alias("value_text"), F.coalesce(text_of(v, "description"), text_of(v, "expected"), bare).alias("description")).distinct(),
    }


def found_actions(records: DataFrame) -> DataFrame:
    """The place of every action of every readable plan."""
    actions = tables(records, "plan_id", "record_json")["action"]
    return actions.select("plan_id", *ordinals(F.col("label"), "module_no", "scenario_no", "step_no", "action_no")).distinct()
