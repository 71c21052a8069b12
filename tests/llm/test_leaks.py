import random

import numpy as np

from tessera.llm import leaks as L

WORDS = [f"w{i:03d}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_suffix_array_finds_all_longest_matches():
    rng = random.Random(3)
    items = [text(rng, 40) for _ in range(5)]
    known = L.Items(list(enumerate(items)))
    docs = [text(rng, 30) + " " + items[2] + " " + text(rng, 30), text(rng, 50), items[4].upper()]
    assert {(f[0], f[1]) for f in known.find(docs)} == {(0, 2), (2, 4)}


def longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_matches_against_brute_force():
    rng = random.Random(11)
    for _ in range(40):
        corpus = [rng.randrange(4) for _ in range(60)]
        query = [rng.randrange(4) for _ in range(20)]
        shard = L.Shard(np.array([*corpus, -1], dtype=np.int32), 3)
        own, at = shard.matches(np.array([*query, -2], dtype=np.int32))
        for q, a in zip(own.tolist(), at.tolist()):
            assert query[q : q + 3] == corpus[a : a + 3]
        assert (longest(query, corpus) >= 3) == (len(own) > 0)


def test_tables(spark):
    rng = random.Random(5)
    items = [(i, text(rng, 40), None) for i in range(12)]
    half = " ".join(items[7][1].split()[:25])
    edited = items[9][1].split()
    edited[15] = "changed"
    docs = [(1, text(rng, 20) + "\n" + items[3][1] + "\n" + text(rng, 20)), (2, text(rng, 80)), (3, half + " " + text(rng, 60)), (4, " ".join(edited)), (5, None), (6, ""), (7, "Item 7: " + " ".join(items[7][1].split()[:4])), (3, half + " " + text(rng, 60))]
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, item_id int, answer string")
    i = spark.createDataFrame([(*x, "s") for x in items] + [(98, None, None, None), (99, "", "", "")], "item_id long, text string, answer string, doc_id string")
    found = {(r.item_id, r.doc_id) for r in L.leaks(d, i).collect()}
    assert {(3, 1), (9, 4)} <= found and not any(doc in (2, 5, 6, 7) for _, doc in found)
    assert L.leaks(d.limit(0), i).count() == 0 and L.leaks(d, i.limit(0)).count() == 0


def test_normal_forms():
    assert L.normal("Caf\u00e9 BAR") == L.normal("cafe\u0301 bar")
    assert L.is_chinese("这是一个测试文本") and not L.is_chinese("plain text")


def found(item, doc):
    return list(L.Items([(1, item)]).find([doc]))


def test_edits_near_the_ends_and_of_whole_chinese_words():
    rng = random.Random(8)
    for changed in ([2], [3], [6], [10], [11], []):
        words = rng.sample(WORDS, 12)
        doc = [w if k not in changed else "changed" for k, w in enumerate(words, 1)]
        assert [f[2:4] for f in found(" ".join(words), "x y z " + " ".join(doc) + " x y z")] == [(12, len(changed))]
    words = rng.sample(WORDS, 16)
    assert found(" ".join(words), " ".join(w if k not in (3, 14) else "changed" for k, w in enumerate(words, 1)))
    words = rng.sample(WORDS, 30)  # side by side, two in thirty
    assert found(" ".join(words), " ".join(w if k not in (8, 9) else "changed" for k, w in enumerate(words, 1)))[0][2] == 30
    for changed in ([1], [12], [6, 7], [2, 11], [4, 9]):  # eleven words or fewer, or two edits in ten
        words = rng.sample(WORDS, 12)
        assert not found(" ".join(words), " ".join(w if k not in changed else "changed" for k, w in enumerate(words, 1)))
    letters = "".join(chr(0x4E00 + k) for k in rng.sample(range(5000), 30))
    for put in ("\u9f98\u9f99", "\u9f98", ""):  # a word of two letters replaced, shortened, left out
        assert [f[2:4] for f in found(letters, letters[:14] + put + letters[16:])] == [(30, 1)]
    number = letters[:12] + "81" + letters[12:22]  # two digits are two edits
    assert not found(number, number.replace("81", "6"))
    assert not found(letters, letters[:14] + "\u9f98\u9f99\u9f9a\u9f9b" + letters[18:22])
