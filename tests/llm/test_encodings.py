from tessera.llm import encodings as E

FRENCH = "Le dépôt de données a été vérifié après la livraison, et l'équipe a noté des écarts réguliers."
SPANISH = "La sesión caducó mañana según el último informe de validación y corrección."
ENGLISH = "The drawer keeps the last state and the panel shows what was saved before."


def docs():
    out = []
    for i in range(60):
        out.append((i, ENGLISH + f" Case {i}.", "en", "issue"))
        out.append((1000 + i, FRENCH + f" Cas {i}.", "fr", "issue"))
        out.append((2000 + i, SPANISH + f" Caso {i}.", "es", "note"))
    return out


def broken(text, page="cp1252"):
    return text.encode("utf-8").decode(page)


def test_found_and_restored(spark):
    bad = [(5000, broken(FRENCH), "fr", "issue"), (5001, ENGLISH + "\n" + broken(SPANISH), "es", "note"), (5002, FRENCH + " " + broken(FRENCH), "fr", "issue")]
    odd = [(6000, None, "fr", "issue"), (6001, "", None, None), (6002, "a" * 200_000, "en", "x")]
    df = spark.createDataFrame([(*r, 1) for r in docs() + bad + odd + bad[:1]], "doc_id long, text string, lang string, source string, n int")
    found = {r.doc_id: r for r in E.garbled(df).collect()}
    assert set(found) == {5000, 5001, 5002}
    assert found[5000].restored == FRENCH
    assert found[5001].restored == ENGLISH + "\n" + SPANISH


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert E.garbled(df).count() == 0


def test_decipher_inverts_the_garbling():
    for page in ("cp1252", "latin-1"):
        assert E.decipher(FRENCH.encode("utf-8").decode(page), ("utf-8", page)) == FRENCH or E.decipher(FRENCH.encode("utf-8").decode(page), (page, "utf-8")) == FRENCH


def test_learnt_table_restores(spark):
    """p8: the letters learnt for the units of a cipher restore the runs; the encodings only check them."""
    bad = [(5000 + i, broken(FRENCH) + f" Cas {i}.", "fr", "issue") for i in range(6)] + [(5100, broken(SPANISH, "mac_roman"), "es", "note")]
    df = spark.createDataFrame(docs() + bad, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in E.garbled(df).collect()}
    assert set(found) == {i for i, *_ in bad}
    assert all(found[5000 + i].by_table == found[5000 + i].runs > 0 for i in range(6))
    assert found[5100].restored == SPANISH


def test_translate_with_units_of_several_characters():
    key = E.Key({}, {(0, "Ã©"): "é", (0, "â‚¬"): "€", (1, "‚"): "é"})
    assert key.translate("dÃ©pÃ´t 5 â‚¬", 0) == "dépÃ´t 5 €"
    assert key.translate("d‚p", 1) == "dép" and key.translate("x", 7) == "x"


def test_surprises_of_a_batch_agree_with_single_lines():
    texts = [t for _, t, *_ in docs()] + [broken(FRENCH) + "\n" + ENGLISH, "", "\n\n", "数据已保存。\nplain", "é"]
    model = E.Bigrams(*E.count_bigrams(texts))
    for text, costs in zip(texts, E.Surprises(model).lines(texts), strict=True):
        lines = text.split("\n")
        assert len(lines) == len(costs)
        assert all(line.isascii() or abs(model.surprise(line) - c) < 0.01 for line, c in zip(lines, costs, strict=True))


def test_units_align_by_bytes():
    assert list(E.units("Ã©", "é", ("cp1252", "utf-8"))) == [("Ã©", "é")]
    gbk = "数据".encode("gbk").decode("latin-1")
    assert list(E.units(gbk, "数据", ("latin-1", "gbk"))) == [(gbk[:2], "数"), (gbk[2:], "据")]
