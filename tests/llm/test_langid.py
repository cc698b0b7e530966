import random

import numpy as np

from tests.llm.helpers import AWKWARD, pages
from twinlens.llm.langid import identify_languages, learn_languages, word_grams, word_scores

WORDS = {"en": "the shipping and price of every order with free returns".split(), "de": "der versand und preis jeder bestellung mit kostenloser rückgabe".split(), "fr": "le prix et la livraison de chaque commande avec retour gratuit".split()}


def text(lang, seed, n=30):
    made = random.Random(seed)
    return " ".join(made.choice(WORDS[lang]) for _ in range(n))


def labelled(spark):
    rows = [(text(lang, i), lang) for lang in WORDS for i in range(40)] + [(None, "en"), ("no label", None), ("", "de")]
    return spark.createDataFrame(rows, "text string, lang string")


def test_held_out_pages_are_told_apart(spark):
    model = learn_languages(labelled(spark))
    rows = [(f"/{lang}/{i}", text(lang, 1000 + i)) for lang in WORDS for i in range(20)]
    got = identify_languages(pages(spark, rows, extra="fr"), model).collect()
    assert all(r["path"].split("/")[1] == r["lang_pred"] and 0.5 < r["score"] <= 1 for r in got) and len(got) == 60


def test_unseen_words_fall_back_to_their_longest_known_grams(spark):
    model = learn_languages(labelled(spark))
    assert "bestellungen" not in model["words"]
    got = identify_languages(pages(spark, [("/a", "Bestellungen Versandpreis"), ("/b", "livraisons commandes")]), model).collect()
    assert {r["path"]: r["lang_pred"] for r in got} == {"/a": "de", "/b": "fr"}
    rows = [model["grams"][g] for g in word_grams("versandx", 4) if len(g) == 4 and g in model["grams"]]
    assert abs(word_scores("versandx", model) - model["scores"][rows].mean(0)).max() < 1e-12
    # Of a word in unknown letters only the marks at its ends may be known.
    ends = [model["grams"][g] for g in "<日本>" if g in model["grams"]]
    assert np.array_equal(word_scores("日本", model), model["scores"][ends].mean(0) if ends else np.zeros(len(model["languages"])))


def test_awkward_rows(spark):
    model = learn_languages(labelled(spark))
    got = identify_languages(pages(spark, [*AWKWARD, ("/n", "123 ²³ !?")]), model).collect()
    assert len(got) == len(AWKWARD) + 1
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["path"] in ("/a", "/b", "/c", "/n"))
    assert all(r["lang_pred"] in WORDS for r in got if r["path"] in ("/d", "/long"))


def test_empty_tables(spark):
    nothing = learn_languages(spark.createDataFrame([], "text string, lang string"))
    assert identify_languages(pages(spark, [("/a", "words")]), nothing).collect()[0]["lang_pred"] == "und"
    assert identify_languages(pages(spark, []), nothing).collect() == []


def test_the_sample_is_bounded(spark):
    assert learn_languages(labelled(spark), sample_pages=5, most_words=7, most_grams=9)["scores"].shape[0] == 16
