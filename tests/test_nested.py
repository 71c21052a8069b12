import json

from tessera.operators import nested

PLAN = {"name": "p", "modules": [{"name": "m0", "scenarios": [{"name": "s0", "steps": [{"name": "t0", "actions": [{"type": "click"}, {"type": "fill", "value": "x"}]}, {"name": "t1"}]}]}, {"name": "m1", "scenarios": []}]}


def frame(spark, records):
    return spark.createDataFrame([(i, "pr", r, "clash") for i, r in enumerate(records)], "plan_id long, project string, record_json string, label string")


def labels(spark, records):
    return {name: sorted(r.label for r in df.collect()) for name, df in nested.tables(frame(spark, records), "plan_id", "record_json").items()}


def test_every_node_has_its_path_and_parent(spark):
    tables = nested.tables(frame(spark, [json.dumps(PLAN)]), "plan_id", "record_json")
    sizes = {name: df.count() for name, df in tables.items()}
    assert [sizes[n] for n in ("module", "scenario", "step", "action")] == [2, 1, 2, 2]
    parents = {r.label for r in tables["step"].collect()}
    for r in tables["action"].select(nested.parent_label(tables["action"]["label"]).alias("p")).collect():
        assert r.p in parents


def test_storage_record_holds_the_same_plan(spark):
    wrapped = json.dumps({"testPlan": PLAN, "savedAt": 1})
    assert labels(spark, [json.dumps(PLAN)]) == labels(spark, [wrapped])


def test_bad_records_give_no_rows(spark):
    bad = [None, "", "not json", "[]", "3", "{}", '{"modules": null}', '{"modules": 5}', json.dumps({"modules": [None, 3, {"scenarios": None}]})]
    found = labels(spark, bad)
    assert found["scenario"] == found["action"] == []
    assert found["module"] == ["0", "1", "2"]  # a single value is a list of one; a null keeps its place
    assert all(df.count() == 0 for n, df in nested.tables(frame(spark, [None]).limit(0), "plan_id", "record_json").items())


def test_a_wide_record(spark):
    wide = {"modules": [{"scenarios": [{"steps": [{"actions": [{"type": "a"}] * 2000}]}]}]}
    assert nested.tables(frame(spark, [json.dumps(wide)]), "plan_id", "record_json")["action"].count() == 2000
