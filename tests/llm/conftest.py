import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, chunk string, fp string, key string"

EN = "the of and river stone light house garden winter morning village people water window letter evening summer mountain child story".split()
DE = "der die und fluss stein licht haus garten dorf leute wasser fenster brief abend sommer berg kind geschichte morgen strasse".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "a", "e", "en", "s", "t"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and columns that clash."""
    rng = random.Random(5)
    passage = sentence(rng, EN, 60)
    texts = [None, "", " \n\t ", "one", "One", "ONE", "two words", "é" * 60, "§ 1234 — !!!"]
    for k in range(30):
        texts.append(sentence(rng, EN if k % 3 else DE, rng.randint(5, 120)))
    texts += [t.upper() if k == 2 else t for k, t in enumerate(texts[10:16])]
    texts += [f"{sentence(rng, EN, 12)} {passage} {sentence(rng, EN, 9)}" for _ in range(6)]
    texts.append((sentence(rng, DE, 40) + "\n") * 3)
    texts.append(sentence(rng, EN, 6000))
    texts.append("la " * 500)
    texts += [texts[20]] * 12
    order = list(range(100, 100 + len(texts)))
    rng.shuffle(order)
    return [(i, t, "de" if k % 3 == 0 else "en", "s", 1, "x", "y", "z", "w") for k, (i, t) in enumerate(zip(order, texts, strict=True))]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
