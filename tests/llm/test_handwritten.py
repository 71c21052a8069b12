import random

from tessera.llm import handwritten as H

CODE = """
export function openDrawer(list, name) {
  const found = list.find((entry) => entry.name === name);
  if (!found) { return null; }
  return found.items.map((item) => item.title);
}
"""


def judge(spark, rows, schema="file_id long, repo string, file_path string, lang string, content string"):
    return {r.file_id: r.kind for r in H.judged(spark.createDataFrame(rows, schema)).collect()}


def test_kinds(spark):
    words = ["drawer", "ledger", "panel", "route", "queue", "chart", "order", "field"]
    hand = [(i, "r", f"src/{w}_view.js", "javascript", CODE.replace("Drawer", w.title()).replace("items", w)) for i, w in enumerate(words)]
    mini = "!function(e,t){" + "".join(f"var {a}{b}=e[{i}],{b}{a}=t({i});" for i, (a, b) in enumerate(zip("qwxzvjkqyxwz" * 12, "xkzqjwvyqzkx" * 12))) + "}(this,0);"
    rows = hand + [(100, "r", "dist/app.min.js", "javascript", mini), (101, "r", "src/model.g.dart", "dart", "// GENERATED CODE - DO NOT MODIFY BY HAND\n" + CODE), (102, "r", "node_modules/lib/index.js", "javascript", CODE)]
    kinds = judge(spark, rows)
    assert all(kinds[i] == "" for i in range(len(words)))
    assert all(kinds[i] for i in (100, 101, 102))


def test_nulls_empty_and_long(spark):
    rows = [(1, None, None, None, None), (2, "r", "a.js", "javascript", ""), (3, "r", "b.js", None, CODE * 2000), (4, "r", "c.json", "json", '{"a": [' + "1," * 50_000 + "1]}")]
    kinds = judge(spark, rows)
    assert set(kinds) <= {1, 2, 3, 4} and kinds.get(2, "") == ""
    assert judge(spark, []) == {}


def test_names():
    assert H.stem_style("a/b/my_file.js") != H.stem_style("a/b/myFile.js")
    assert "openDrawer" in H.Source(CODE).names


def test_notices_at_any_depth():
    """p3: notices and licences below long headers, and lockfileVersion behind a long start."""
    licence = "".join(f"// Permission line {i} of the licence.\n" for i in range(120))
    imports = "".join(f"import {{ part{i} }} from './part{i}.js';\n" for i in range(300))
    assert H.has_notice(H.Source(licence + imports + "// Code generated by modelgen. DO NOT EDIT.\n" + CODE * 60))
    assert H.has_notice(H.Source(CODE * 60 + "/*\n  This file was generated by modelgen\n*/\n" + CODE * 60))
    assert not H.has_notice(H.Source(CODE * 60 + "const head = `\n// Code generated by modelgen. DO NOT EDIT.\n`;\n" + CODE * 60))
    assert not H.has_notice(H.Source(CODE * 60 + "// Items are written by the drawer.\n" + CODE))
    assert H.names_library("src/tinyslide.js", H.Source(licence + "// tinyslide 2.4.1, copyright its authors\n" + CODE))
    assert not H.names_library("src/tinyslide.js", H.Source(CODE + licence + "// tinyslide 2.4.1, copyright its authors\n"))
    packages = "".join(f'  "package{i}": "1.0.{i}",\n' for i in range(500))
    assert H.told("deps/tree.json", "json", H.Source("{\n" + packages + '  "lockfileVersion": 3\n}')) == "lock file"


WORDS = "drawer ledger panel route queue chart order field window marker ticket roster palette header footer slice column branch cursor session".split()
VERBS = "open close merge split format render collect resolve publish restore".split()


def hand_written(k):
    """A file with some fifty names, put together differently for each *k*."""
    out, pick = [], random.Random(k)
    for _ in range(12):
        verb, (word, other) = pick.choice(VERBS), pick.sample(WORDS, 2)
        out.append(f"export function {verb}{word.title()}({other}, {word}List) {{\n  const {other}{word.title()} = {word}List.filter((x) => x.{other} > 0);\n  return {other}{word.title()};\n}}\n")
    return "\n".join(out)


def test_models_decide_alone(spark):
    """p3: mangled names and names from templates are told by the models, with no telling path, notice or long line."""
    hand = [(i, f"r{i % 3}", f"src/{WORDS[i % 20]}{i}.js", "javascript", hand_written(i)) for i in range(20)]
    letters = "qzxkvjwyhbg"
    mangled = "\n".join(f"var {a}{b}=function({b},{a}){{return {b}*{a}+{b}{a}({i})}};" for i, (a, b) in enumerate((a, b) for a in letters for b in letters if a != b))
    schema = "\n".join(f"export const field{i} = readField{i}(row{i});" for i in range(60))
    rows = [*hand, (100, "r1", "src/report.js", "javascript", mangled), (101, "r1", "src/record.js", "javascript", schema)]
    found = {r.file_id: (r.kind, r.evidence) for r in H.judged(spark.createDataFrame(rows, "file_id long, repo string, file_path string, lang string, content string")).collect()}
    assert found[100] == ("minified", "cross-entropy")
    assert found[101] == ("generated", "diversity")
    assert all(found[i][0] == "" for i in range(20))


def test_data_with_comment_signs_in_a_literal():
    """p3: signs of a comment within a literal do not cut it short."""
    font = "fWCh2ZO3//WU2TgJzLyc/QqubY9pAvJcuN0dbzmJ0Cf8O5eav+JcXK5U" * 20
    assert H.told("src/icon.py", "py", H.Source(f"FONT = '{font}'\n")) == "data"
    assert H.told("src/icon.py", "py", H.Source(hand_written(1))) == ""


def test_copies_of_a_hot_library(spark):
    """p3: a library that a third of all files copy is found in every one of them."""
    library = "\n\n".join(f"export function helperNumber{i}(value) {{ return value * {i} + offset; }}" for i in range(9))
    rows = [(i, f"r{i % 4}", f"src/part{i}/tools.js", "javascript", library) for i in range(12)] + [(50 + i, "r1", f"src/own{i}.js", "javascript", hand_written(i)) for i in range(20)]
    kinds = judge(spark, rows)
    assert all(kinds[i] == "third-party" for i in range(12)) and not any(kinds[50 + i] for i in range(20))
