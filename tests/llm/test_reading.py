import random

import numpy as np
import pytest

from orbspan.llm import reading

EASY, HARD = "dog hat pig cup sun bed".split(), "deliberation municipality jurisdiction correspondence".split()


def passage(rng, grade):
    out = []
    for _ in range(14):
        noun = lambda: rng.choice(EASY if rng.random() > (grade - 1) / 3 else HARD)
        s = f"the {noun()} saw the {noun()}"
        for _ in range(grade - 1):
            s += " " + {2: "and", 3: "while", 4: "notwithstanding that"}[grade] + f" the {noun()} of the {noun()} was by the {noun()}"
        out.append(s.capitalize() + ".")
    return " ".join(out)


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(1)
    return [(k, passage(rng, k % 4 + 1), k % 4 + 1) for k in range(80)]


def test_held_out_accuracy(samples):
    model = reading.fit([(t, g) for _, t, g in samples[:60]])
    rng = np.random.default_rng(0)
    pages = [reading.damaged(reading.tokens(t), 0.02, rng) for _, t, _ in samples[60:]]
    assert (model.grades(pages) == [g for _, _, g in samples[60:]]).mean() >= 0.95


def test_tokens_join_words():
    assert reading.tokens("The delib-\r\neration saw 12 cats.\nA cup") == ["the", "deliberation", "saw", "cats", ".", "a", "cup"]


def test_lines_and_language_are_told_by_the_passages(samples):
    text = reading.Lines([t for _, t, _ in samples])
    article = reading._lines(samples[5][1], 40)
    advert = ["COUNCIL LAMB AT HAVIS", "TRY FOO'S SOAP.", "£1 10s. & 8d.", "*** 7/6 ***"]
    assert text.articles(["\r\n".join(advert[:2] + article + advert[2:])]) == ["\n".join(article)]
    # a price or a name inside of an article's line leaves it in
    priced = article[0] + " for 8d. " + article[1]
    assert text.articles(["\n".join([*article, priced])]) == ["\n".join([*article, priced])]
    wide = "   |  ".join(article)
    assert text.articles([wide, "Der Bauer sah die Königin und zählte das Schiff. " * 5, "", "7 7 7"]) == [" ".join(article), None, None, None]
    assert reading.Lines([]).articles(["the cup"]) in (["the cup"], [None], [""])


def test_fit_in_steps_equals_dense_gradient(samples, monkeypatch):
    model = reading.fit([(t, g) for _, t, g in samples[:8]])
    found = [s for _, t, _ in samples[:8] for s in reading.sentences(reading.tokens(t))]
    labels = [k % 4 for k in range(len(found))]
    data, rng = reading._Sentences(model, found, labels), np.random.default_rng(3)
    w = rng.normal(size=model.weights.shape)
    x = np.zeros((len(found), len(w)))
    for row, s in zip(x, found):
        row[np.searchsorted(reading._LENGTHS, len(s), "right") - 1] += 1
        row[len(reading._LENGTHS)] += 1
        for word in s:
            columns, values = model.columns(word)
            np.add.at(row, columns, values / len(s) ** 0.5)
    z = np.exp(x @ w)
    want = x[5:30].T @ (z / z.sum(1, keepdims=True) - np.eye(4)[labels])[5:30] / 25
    assert np.allclose(data.gradient(w, slice(5, 30)), want)
    monkeypatch.setattr(reading, "STEP", 100)
    model = reading.fit([(t, g) for _, t, g in samples[:60]])
    assert (model.grades([reading.tokens(t) for _, t, _ in samples[60:]]) == [g for _, _, g in samples[60:]]).mean() >= 0.95


def test_pages(spark, samples):
    s = spark.createDataFrame(samples + [(900, None, 1), (901, "x", None)], "sample_id bigint, text string, grade int")
    german = "Der Bauer sah die Königin trotz des Regens und der Kaufmann zählte das Schiff. " * 9
    french = "Le fermier regardait la mairie, car la rivière a perdu un évêque et le maître. " * 9
    pages = [(k, t, "de", g) for k, t, g in samples] + [(500, None, "en", 0), (501, "", "en", 0), (502, "the cup of the dog", "en", 0), (503, german, "en", 0), (504, french, None, 0), (505, "\n" * 60, "en", 0), (506, "7 " * 60, "en", 0), (507, samples[3][1] * 200, "en", 4)]
    d = spark.createDataFrame(pages, "doc_id bigint, text string, lang string, grade int")
    got = {r["doc_id"]: r["grade"] for r in reading.reading_grades(d, s).collect()}
    assert got == {k: g for k, t, _, g in pages if g}
    assert reading.reading_grades(d.limit(0), s).count() == 0
