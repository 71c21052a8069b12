"""Queries over saved test plans: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import nested
from tessera.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every action of every readable plan."""
    return nested.found_actions(table(spark, folder, "test_plans"))


def _flat(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.plan_tables(table(spark, folder, "test_plans"))[name]

    query.__doc__ = f"The {name} of all readable plans, each with its label and parent."
    return query


QUERIES = {"p4_found": p4_found, **{f"p4_{n}": _flat(n) for n in ("plans", "modules", "scenarios", "steps", "actions")}}


def _list(value: str) -> str:
    return f"CASE coalesce(json_type({value}), 'NULL') WHEN 'ARRAY' THEN from_json({value}, '[\"JSON\"]') WHEN 'NULL' THEN []::JSON[] ELSE [{value}] END"


_NODES = f"""
    WITH records AS (SELECT DISTINCT plan_id, record_json::JSON AS j FROM test_plans WHERE record_json IS NOT NULL AND json_valid(record_json)),
    plans AS (
        SELECT plan_id, CASE coalesce(json_type(j, '$.testPlan'), 'NULL')
            WHEN 'NULL' THEN j
            WHEN 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$.testPlan') THEN (j ->> '$.testPlan')::JSON END
            ELSE j -> '$.testPlan' END AS v
        FROM records WHERE json_type(j) = 'OBJECT'),
    module_lists AS (SELECT plan_id, {_list("v -> '$.modules'")} AS l FROM plans WHERE json_type(v) = 'OBJECT'),
    modules AS (SELECT plan_id, i - 1 AS module_no, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM module_lists) WHERE json_type(l[i]) <> 'NULL'),
    scenario_lists AS (SELECT plan_id, module_no, {_list("v -> '$.scenarios'")} AS l FROM modules),
    scenarios AS (SELECT plan_id, module_no, i - 1 AS scenario_no, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM scenario_lists) WHERE json_type(l[i]) <> 'NULL'),
    step_lists AS (
        SELECT plan_id, module_no, scenario_no, list_concat(list_concat({_list("v -> '$.steps'")}, {_list("v -> '$.given_steps'")}), list_concat({_list("v -> '$.when_steps'")}, {_list("v -> '$.then_steps'")})) AS l
        FROM scenarios),
    steps AS (SELECT plan_id, module_no, scenario_no, i - 1 AS step_no, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM step_lists) WHERE json_type(l[i]) <> 'NULL'),
    action_lists AS (SELECT plan_id, module_no, scenario_no, step_no, list_concat({_list("v -> '$.actions'")}, {_list("v -> '$.verifications'")}) AS l FROM steps),
    actions AS (SELECT plan_id, module_no, scenario_no, step_no, i - 1 AS action_no, l[i] AS v FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM action_lists) WHERE json_type(l[i]) <> 'NULL')
"""
SQL = {
    "p4_found": f"{_NODES} SELECT DISTINCT plan_id, module_no::INT AS module_no, scenario_no::INT AS scenario_no, step_no::INT AS step_no, action_no::INT AS action_no FROM actions",
    "p4_modules": f"""{_NODES} SELECT DISTINCT plan_id, module_no::VARCHAR AS label, '' AS parent, module_no::INT AS position,
        CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v ->> '$.module' END AS module, v ->> '$.priority' AS priority FROM modules""",
    "p4_scenarios": f"""{_NODES} SELECT DISTINCT plan_id, concat_ws('.', module_no, scenario_no) AS label, module_no::VARCHAR AS parent, scenario_no::INT AS position, v ->> '$.id' AS scenario_id,
        CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v ->> '$.name' END AS name, v ->> '$.given' AS given_text, v ->> '$.when' AS when_text, v ->> '$.then' AS then_text FROM scenarios""",
    "p4_steps": f"""{_NODES} SELECT DISTINCT plan_id, concat_ws('.', module_no, scenario_no, step_no) AS label, concat_ws('.', module_no, scenario_no) AS parent, step_no::INT AS position,
        try_cast(v ->> '$.order' AS DOUBLE) AS step_order, CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE v ->> '$.description' END AS description, v ->> '$.type' AS type FROM steps""",
    "p4_actions": f"""{_NODES} SELECT DISTINCT plan_id, concat_ws('.', module_no, scenario_no, step_no, action_no) AS label, concat_ws('.', module_no, scenario_no, step_no) AS parent, action_no::INT AS position,
        v ->> '$.type' AS type, v ->> '$.target' AS target, v ->> '$.value' AS value_text,
        CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' ELSE coalesce(v ->> '$.description', v ->> '$.expected') END AS description FROM actions""",
    "p4_plans": f"""{_NODES} SELECT DISTINCT plan_id, try_cast(v ->> '$.totalSteps' AS DOUBLE) AS total_steps, try_cast(v ->> '$.estimatedTime' AS DOUBLE) AS estimated_time FROM plans WHERE json_type(v) = 'OBJECT'""",
}
