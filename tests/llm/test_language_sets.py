"""Sets of any size are tried, under the documented penalty."""

from __future__ import annotations

import numpy as np

from ripplenet.llm import langid

TEXTS = {
    "en": "the cat and the dog of the house ",
    "fr": "le chat et le chien dans la maison ",
    "de": "der hund und die katze im haus ",
    "es": "el perro y el gato en una casa ",
    "fi": "kissa ja koira ovat talossa ",
}


def test_five_languages_are_all_found(spark):
    docs = spark.createDataFrame([(i, t * 30, lang) for i, (lang, t) in enumerate(TEXTS.items())], "doc_id long, text string, lang string")
    mixed = spark.createDataFrame([(9, TEXTS["en"] * 20 + "".join(t * 10 for lang, t in TEXTS.items() if lang != "en"))], "doc_id long, text string")
    (got,) = langid.identify(mixed, docs).collect()
    words = {lang: len(t.split()) * (20 if lang == "en" else 10) for lang, t in TEXTS.items()}
    assert set(got.languages) == set(TEXTS) and got.lang_pred == "en"
    assert abs(got.score - words["en"] / sum(words.values())) < 0.08


def test_a_further_language_costs_half_the_logarithm_of_the_words():
    """Two words of 100 prefer a second language, by more and more."""
    found = []
    for gain in np.arange(1.0, 14.0, 0.25):
        ll = np.zeros((100, 2), np.float32)
        ll[:, 1] = -20
        ll[:2] = [-gain, 0]
        p = np.exp(ll - ll.max(axis=1, keepdims=True)) + np.float32(1e-30)
        one, two = langid.shares(p[:, :1], 60)[1], langid.shares(p, 60)[1]
        at, _ = langid.infer(ll, 2, 60)
        assert (len(at) == 2) == (two - one > 0.5 * np.log(100))
        found.append(len(at))
    assert set(found) == {1, 2}
