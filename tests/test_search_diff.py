import random

from pyspark.sql import functions as F

from tessera.operators import diff, search, visual


def test_similar_against_brute_force(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(5))) for i in range(40)] + [(90, None), (91, "")]
    c = spark.createDataFrame([(*t, "clash", 5) for t in texts], "id long, text string, query string, nq int")
    q = c.where("id < 5").select(F.col("id").alias("query"), "text")
    got = {(r.query, r.id, r.rank): r.similarity for r in search.similar(q, c, 0.3, 3).collect()}
    want = {}
    for i, a in texts[:5]:
        pairs = []
        for j, b in texts:
            if b is None:
                continue
            x, y = set(a.split()), set(b.split(" "))
            pairs.append((-round(len(x & y) / len(x | y), 6), j))
        for k, (s, j) in enumerate([p for p in sorted(pairs) if -p[0] > 0.3][:3], 1):
            want[(i, j, k)] = -s
    assert got == want


def test_matching(spark):
    r = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "requirement string, keywords array<string>")
    c = spark.createDataFrame([(1, ["x", "x", "y"]), (2, ["y"]), (3, [])], "id long, words array<string>")
    assert {tuple(x) for x in search.matching(r, c).collect()} == {("a", 1, 2), ("a", 2, 1)}


def test_cascade_prefers_the_first_stage(spark):
    a = spark.createDataFrame([(1, "exact")], "query long, hit string")
    b = spark.createDataFrame([(1, "near"), (2, "near")], "query long, hit string")
    assert {(r["query"], r.hit) for r in search.cascade(a, b).collect()} == {(1, "exact"), (2, "near")}


def test_snapshot_diff_with_nulls(spark):
    s = "k string, v string"
    a = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", None)], s)
    b = spark.createDataFrame([("a", "1"), ("b", None), ("c", "4"), ("e", None)], s)
    got = {r.k: r.status for r in diff.snapshot_diff(a, b, "k", "v").collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "modified", "d": "deleted", "e": "added"}
    assert diff.snapshot_diff(a.limit(0), b.limit(0), "k", "v").count() == 0


def test_states_merge_and_first(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "fingerprint string") for xs in ("aab", "bcc"))
    assert {tuple(r) for r in diff.compare_fingerprints(a, b).collect()} == {("a", "fixed"), ("b", "recurring"), ("c", "new")}
    old, new = (spark.createDataFrame(x, "k long, v string") for x in ([(1, "o")], [(1, "n"), (2, "n")]))
    assert {tuple(r) for r in diff.merge_keep_old(old, new, ["k"]).collect()} == {(1, "o"), (2, "n")}
    assert {tuple(r) for r in diff.first_by(new.unionByName(old), "k", "v").select("k", "v").collect()} == {(1, "n"), (2, "n")}


def test_hunks(spark):
    kinds = {1: None, 2: "add", 3: None, 4: "modify", 5: None, 6: None, 7: None, 8: "delete"}
    rows = spark.createDataFrame([("p", n, k) for n, k in kinds.items()], "key string, line_no int, kind string")
    assert [tuple(r) for r in diff.hunks(rows, "key").collect()] == [("p", 2, 4, 2), ("p", 8, 8, 1)]
    assert diff.hunks(rows.limit(0), "key").count() == 0


def test_positional_diff(spark):
    s = "key string, line_no int, line string"
    a = spark.createDataFrame([("p", 0, "a"), ("p", 1, None), ("p", 2, "c")], s)
    b = spark.createDataFrame([("p", 0, "x"), ("p", 1, None)], s)
    assert {(r.line_no, r.kind) for r in diff.positional_diff(a, b, "key").collect()} == {(0, "modify"), (2, "delete")}


def test_lcs(spark):
    assert diff.lcs_length("abcbdab", "bdcaba") == 4 and diff.lcs_length("", "a") == 0
    rows = spark.createDataFrame([("abc", "axc", 1), (None, "a", 2)], "a string, b string, n int")
    assert [r.lcs for r in diff.with_lcs(rows, "a", "b").orderBy("n").collect()] == [2, None]


def test_ssim_of_equal_images_is_one(spark):
    g = spark.createDataFrame([(float(i * 7 % 50),) for i in range(64)], "g double")
    assert abs(g.agg(visual.ssim(F.col("g"), F.col("g")).alias("s")).first().s - 1) < 1e-9


def test_continuity_and_leading_share(spark):
    e = spark.createDataFrame([(1, i, t) for i, t in enumerate("abcda")] + [(None, 0, "a")], "user long, n int, type string")
    got = [r.continuity for r in search.continuity(e.where("user = 1"), "user", ["n"], "type").orderBy("n").collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 0.0]
    assert search.leading_share(e, "user", ["n"], 0.5).count() == 4
