import io
import json
import zipfile

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import repair
from tessera.operators import filters
from tessera.sources import manifests, workbooks

VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.text(alphabet="ab \"\\'{}[],:\n", max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=3), x, max_size=3), max_leaves=12)


@given(st.dictionaries(st.text(alphabet="abc", min_size=1), VALUES, min_size=1))
def test_valid_json_is_kept_and_the_tolerant_reader_agrees(value):
    text = json.dumps(value)
    assert repair.repaired(text) == (text, "valid")
    assert repair._Reader(text).value() == value


@given(VALUES, st.integers(0, 10**6))
def test_cut_off_texts_end_somewhere_valid(value, place):
    text = "[" + json.dumps(value)
    out, state = repair.repaired(text[: 1 + place % len(text)])
    assert state in ("valid", "repaired") and json.loads(out) is not None


@pytest.mark.parametrize(
    "text,want",
    [
        ("```json\n{'a': 1, b: 'x',}\n```", {"a": 1, "b": "x"}),
        ('Here it is: {"a": [1, 2', {"a": [1, 2]}),
        ('{"a": True, // yes\n "b": None}', {"a": True, "b": None}),
        ('{"a": "x\ny"}', {"a": "x\ny"}),
        ('{"a": }', {"a": None}),
    ],
)
def test_repairs(text, want):
    out, state = repair.repaired(text)
    assert state == "repaired" and json.loads(out) == want


def test_lost_and_deep():
    assert repair.repaired(None) == (None, "lost") and repair.repaired("  ") == (None, "lost") and repair.repaired("no json") == (None, "lost")
    assert repair.repaired("[" * 100_000)[1] in ("repaired", "lost")


def test_repair_frame(spark):
    df = spark.createDataFrame([(1, "{a: 1}"), (2, None)], "id long, t string")
    assert {(r.id, r.json, r.state) for r in repair.with_repair(df, "id", "t").collect()} == {(1, '{"a": 1}', "repaired"), (2, None, "lost")}


def test_runnable(spark):
    tasks = spark.createDataFrame([("a", "completed"), ("b", "pending"), ("c", "pending"), ("d", "pending"), ("e", "pending")], "id string, status string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", None), ("e", "zz"), ("b", "a")], "id string, need string")
    assert {r.id for r in filters.runnable(tasks, needs).collect()} == {"b", "d"}


def test_violations(spark):
    rows = spark.createDataFrame([(1, None, "x", "5"), (2, "n", "http://a", "x"), (3, "n", None, None)], "id long, name string, url string, size string")
    contract = [filters.Field("name", required=True), filters.Field("url", test=lambda c: c.startswith("http")), filters.Field("size", cast="int")]
    assert {tuple(r) for r in filters.violations(rows, "id", contract).collect()} == {(1, "name", "missing"), (1, "url", "value"), (2, "size", "type")}


def test_searches(spark):
    rows = spark.createDataFrame([("Ab", 1, None), ("b", 2, "x"), (None, 3, "y")], "key string, n int, value string")
    assert filters.equal_to(rows, key="b", n=2).count() == 1 and filters.equal_to(rows, value=None).count() == 1
    assert filters.key_like(rows, "key", "^AB").count() == 1
    assert filters.texts_like(rows, [], "X").count() == 1 and filters.texts_like(rows, ["A"], "b").count() == 1


def test_sessions_and_registry(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:20:00"), (1, "2024-01-01 02:00:00")], "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.events for r in filters.sessions(e, "30 minutes").collect()) == [1, 2]
    r = filters.Registry()
    r.register("runnable", filters.runnable)
    assert r.get("runnable") is filters.runnable and "pending" in r.schema()["runnable"]
    with pytest.raises(ValueError):
        r.register("runnable", filters.runnable)


def test_manifests(spark):
    texts = [
        (1, "a/package.json", '{"dependencies": {"vue": "^3.0.0"}, "devDependencies": {"jest": "1"}}'),
        (2, "requirements.txt", "numpy==1.2\n# no\nrequests\n"),
        (3, "pubspec.yaml", "dependencies:\n  http: ^1.0.0\n  path: any\n"),
        (4, "go.mod", "module x\n\ngo 1.20\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
        (5, "Cargo.toml", '[dependencies]\nserde = "1.0"\nrand = { version = "0.8" }\n'),
        (6, "Gemfile", "gem 'rails', '7.0'\ngem 'puma'\n"),
        (7, "build.gradle", "dependencies {\n  implementation 'com.a:b:1.0'\n}\n"),
        (8, "composer.json", '{"require": {"php/x": "2"}}'),
        (9, "package.json", "not json"),
        (10, None, None),
    ]
    got = {(r.file_id, r.ecosystem, r.package, r.version) for r in manifests.dependencies(spark.createDataFrame(texts, "file_id long, file_path string, content string")).collect()}
    assert got == {
        (1, "node", "vue", "^3.0.0"), (1, "node", "jest", "1"), (2, "python", "numpy", "1.2"), (2, "python", "requests", ""), (3, "dart", "http", "^1.0.0"), (3, "dart", "path", "any"),
        (4, "go", "github.com/a/b", "v1.2.3"), (5, "rust", "serde", "1.0"), (5, "rust", "rand", "0.8"), (6, "ruby", "rails", "7.0"), (6, "ruby", "puma", ""), (7, "java", "com.a:b", "1.0"), (8, "php", "php/x", "2"),
    }


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


BOOK = {
    "xl/workbook.xml": '<workbook xmlns:r="u"><sheets><sheet name="Cases" r:id="rId1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>title</t></si><si><r><t>lo</t></r><r><t>gin</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>7</v></c><c r="D3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
}


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(archive(BOOK))
    (tmp_path / "b.docx").write_bytes(archive({"word/document.xml": "<d><p><r><t>one</t></r></p><p/></d>"}))
    (tmp_path / "c.xlsx").write_bytes(b"broken")
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.md").write_text("x\ny")
    rows = {(r.path.rsplit("/", 1)[1], r.part, r.row_no): r for r in workbooks.read(spark, str(tmp_path)).collect()}
    assert rows["a.xlsx", "Cases", 3].cells == ["login", None, "7", "x"] and rows["a.xlsx", "Cases", 1].cells == ["title"]
    assert rows["b.docx", "", 1].cells == ["one"]
    assert rows["c.xlsx", None, None].error and rows["d.exe", None, None].error
    assert rows["e.md", "", 2].cells == ["y"]
