import random

import pytest

from codeloom.llm import langid

VOICES = {"aa": "bakamo lutepi sorane", "bb": "xyrq wzhk vjqx", "cc": "éàüö ñíóú çêî"}


@pytest.fixture(scope="module")
def model(spark):
    rng, rows = random.Random(3), []
    for k in range(240):
        lang = rng.choice(list(VOICES))
        words = ["".join(rng.sample(w, len(w))) for w in VOICES[lang].split() * 12]
        rows.append((k, " ".join(words), lang))
    return langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)


def speech(lang, n, rng):
    return " ".join("".join(rng.sample(w, len(w))) for w in VOICES[lang].split() * n)


def test_held_out_accuracy(spark, model):
    rng = random.Random(99)
    rows = [(k, speech(lang, 6, rng), None, "s", lang) for k in range(150) for lang in [rng.choice(list(VOICES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, truth string")
    got = {r["doc_id"]: r["language"] for r in langid.identify_documents(docs, model).collect()}
    assert sum(got[r[0]] == r[4] for r in rows) >= 148


def test_priors_and_declarations_decide_short_texts(spark, model):
    rng = random.Random(5)
    rows = [(k, speech("aa", 8, rng), "aa", "host-a") for k in range(30)] + [(100 + k, speech("bb", 8, rng), "bb", "host-b") for k in range(30)]
    rows += [(200, "q", None, "host-a"), (201, "q", None, "host-b"), (202, "q", "aa", "host-c"), (203, "q", "bb", "host-c")]
    got = {r["doc_id"]: r["language"] for r in langid.identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), model).collect()}
    assert (got[202], got[203]) == ("aa", "bb")
    plain = [r for r in rows if r[0] < 200]
    assert all(got[k] == lang for k, _, lang, _ in plain)


def test_rejects_only_what_has_no_language(messy, model, nothing):
    got = langid.identify_documents(messy, langid.fit(messy)).collect()
    assert len(got) == 16
    rejected = sorted(str(r["doc_id"]) for r in got if not r["accepted"])
    assert rejected == ["4", "5", "6", "None"]
    assert all(r["language"] == langid.UNKNOWN for r in got if not r["accepted"])
    assert langid.identify_documents(nothing, model).collect() == []


def test_page_parts():
    page = '<html lang="fr"><head><script>var a="<p>";</script></head><body>Un &amp; deux<!-- x --></body></html>'
    text, declared, suffix, domain, host = langid.page_parts("https://m.example.org/fr/7?x=1", page)
    assert text.split() == ["Un", "&", "deux"] and (declared, suffix, domain, host) == ("fr", "org/fr", "example.org", "m.example.org")
    assert langid.page_parts(None, None) == ("", None, "", "", "")
    assert langid.page_parts("http://[bad", "x")[2:] == ("", "", "")


def test_declaration_after_a_long_preamble():
    for preamble in ("<!-- " + "banner " * 900 + "-->", "\n" * 5000, "<!--[if IE]><html lang='xx'><![endif]-->" + " " * 5000):
        assert langid.page_parts("http://a.org", f'<!DOCTYPE html>{preamble}<html class="a" lang="pl-PL"><body>Tak')[1] == "pl"
    assert langid.page_parts(None, " " * 5000 + '<!--[if IE]><html lang="nl"><![endif]-->Ja')[1] == "nl"
    assert langid.page_parts(None, "<html><script>x = '<html lang=\"de\">'</script>" + " " * 5000 + "Ja")[1] is None


def test_pages(spark, model):
    rows = [(1, "http://a.com/aa/1", '<html lang="aa">' + speech("aa", 5, random.Random(1))), (2, None, None), (2, None, None), (None, "", "<p></p>")]
    got = langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()
    assert len(got) == 4 and [r["language"] for r in got if r["page_id"] == 1] == ["aa"]


def test_fit_without_labels(spark):
    empty = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.languages == (langid.UNKNOWN,)


def test_every_label_has_a_class(spark):
    rng = random.Random(7)
    rows = [(k, speech("aa", 20, rng), "aa") for k in range(400)] + [(k, speech("bb", 20, rng), "bb") for k in range(400, 800)]
    rows += [(900, speech("cc", 20, rng), "cc"), (901, "длинный текст на другом языке " * 800, "ru"), (902, "kurz", "xx"), (903, "12 34", "nn")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert model.languages == ("aa", "bb", "cc", "nn", "ru", "xx")
    texts = [(1, speech("cc", 6, rng)), (2, "текст на другом языке длинный"), (3, speech("aa", 6, rng)), (4, speech("bb", 6, rng))]
    docs = spark.createDataFrame([(k, t, None, "s") for k, t in texts], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["language"], r["accepted"]) for r in langid.identify_documents(docs, model).collect()}
    assert got == {1: ("cc", True), 2: ("ru", True), 3: ("aa", True), 4: ("bb", True)}
