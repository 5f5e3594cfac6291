"""Words set apart by spaces, and words with few letters left."""

import pytest

from attesta.llm import toxicity as X

PLAIN = "you are a loser and an idiot said the moron to a class of idiots who are not in the list that you sent to us and the static text of the page was shit again "
LEXICON = {"=idiot": 5.0, "=moron": 5.0, "=loser": 5.0, "=static": 5.0, "=shit": 5.0, "=ass": 5.0}


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(1, PLAIN * 200)], "id long, text string")
    return X.ToxicModel(X.language_model(X.trigram_counts(docs)), LEXICON, (0.0,) * 6)


@pytest.mark.parametrize("text", ["a m o r o n", "you are a l o s e r", "y o u i d i o t", "an i d i o t again", "the id iot said", "an idi o t", "the m o ron", "5h17", "57a71c", "l 0 5 e r"])
def test_found(model, text):
    assert X._matches(text, model, {})[0]


@pytest.mark.parametrize("text", ["c l a s s", "you are in a class", "the list of us", "2024 517 100", "a b c", ""])
def test_clean(model, text):
    assert not X._matches(text, model, {})[0]


def test_stretched_words_are_found(model):
    for text in ("i" * 80 + "diot", "id" + "-" * 70 + "iot"):
        assert X._matches(text, model, {})[0]


def test_decode_is_the_best_of_all_paths(model):
    """Brute force over all paths of ambiguous tokens, scored as the lattice is."""
    from itertools import product

    def score(token, picks):
        a = b = 26
        last, p = "", 0.0
        for x, cost, repeat in picks:
            if repeat:
                if x != last:
                    return -1e18
                p -= 1.5
            elif x:
                k = X.letter_class(x)
                p, a, b, last = p + cost + model.lm[a, b, k], b, k, x
            else:
                p += cost
        return p + model.lm[a, b, 26]

    for token in ("1|1|1|1|1", "1d1|1o+|"):
        ways = []
        for c in token:
            if c.isalpha():
                one = [(c, -0.05, False)]
            else:
                one = [(x, -1.0, False) for x in X.LOOKALIKES[c]] + [("", -6.0 if c.isalnum() else -1.0, False)]
            ways.append(one + [(x, 0.0, True) for x, _, _ in one if x])
        best = max(((score(token, w), "".join(x for x, _, r in w if not r)) for w in product(*ways)), key=lambda s: s[0])
        assert X.decode(token, model.lm) == best[1]
