"""Detectors for Dart on small files: each branch once."""

from tessera.operators import dart, extract


def files(spark, *texts):
    return spark.createDataFrame([(i, "r", f"lib/f{i}.dart", "dart", t) for i, t in enumerate(texts)], "file_id long, repo string, file_path string, lang string, content string")


def test_missing_dispose(spark):
    held = "class _P extends State<P> {\n  final name = TextEditingController();\n  ScrollController rows = ScrollController();\n  @override\n  void dispose() {\n    name.dispose();\n    if (x) {\n      y();\n    }\n    super.dispose();\n  }\n  void other() {\n    rows.dispose();\n  }\n}"
    plain = "class Q {\n  final name = TextEditingController();\n}"
    assert [(r.file_id, r.line_no, r.name) for r in dart.missing_dispose(files(spark, held, plain)).collect()] == [(0, 3, "rows")]


def test_missing_return(spark):
    good = "Widget build(BuildContext c) {\n  if (a) {\n    b();\n  }\n  return Text('x');\n}"
    bad = "class A {\n  Widget build(BuildContext c) {\n    show();\n  }\n  int f() {\n    return 1;\n  }\n}"
    assert [(r.file_id, r.line_no) for r in dart.missing_return(files(spark, good, bad)).collect()] == [(1, 2)]


def test_nullable_lists_and_chains(spark):
    text = "List<Item?> rows = [];\nList<Item> all = [];\nvar a = rows.first;\nvar b = rows?.first;\nvar c = all.first;\n// rows.first\nprint(a.item.name.text);\nprint(a?.item?.name);\n"
    f = files(spark, text)
    assert [(r.line_no, r.name) for r in dart.nullable_lists(f).collect()] == [(3, "rows")]
    assert [(r.line_no, r.chain) for r in dart.property_chains(f).collect()] == [(7, "a.item.name.text")]


def test_late_variables(spark):
    text = "late String title;\nlate int size;\nvoid f() {\n  show(title);\n  size = 3;\n  show(size);\n}\n"
    assert [(r.line_no, r.name) for r in dart.late_variables(files(spark, text)).collect()] == [(4, "title")]


def test_nulls_and_nothing(spark):
    f = files(spark, None, "")
    for detect in (dart.missing_dispose, dart.missing_return, dart.nullable_lists, dart.property_chains, dart.late_variables):
        assert detect(f).count() == 0 and detect(f.limit(0)).count() == 0


def test_class_bodies(spark):
    text = "class Store {\n  final int a;\n  final int b;\n  int sum() {\n    return a + b;\n  }\n  void clear() {\n  }\n}\nclass Other {\n}\n"
    got = {r.name: (r.start, r.methods, r.fields, r.body.count("\n")) for r in extract.class_bodies(files(spark, text)).collect()}
    assert got == {"Store": (1, 2, 2, 8), "Other": (10, 0, 0, 1)}
