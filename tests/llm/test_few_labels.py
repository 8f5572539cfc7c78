"""Toxicity with few or one-sided labels: held-back evidence decides whether a text can be told at all."""

import random

import numpy as np
import pytest

from lodestore.llm import labelled, toxicity


def texts(n, seed, vile=0.0):
    rng = random.Random(seed)
    say = lambda k: " ".join(f"w{rng.randrange(600)}" for _ in range(k))
    made = [(f"{say(20)} {rng.choice(['zarg', 'blorf', 'krut'])}{rng.choice(['', 'en'])} {say(20)}" if rng.random() < vile else say(42)) for _ in range(n)]
    return [t.encode() for t in made], np.array([any(v in t for v in ("zarg", "blorf", "krut")) for t in made], np.int64)


@pytest.mark.parametrize("toxic", [0, 1, 5, 10, 40])
def test_no_more_than_twice_the_true_share_is_called_toxic(toxic):
    bad, _ = texts(toxic, 1, 1.0)
    clean, _ = texts(max(8 * toxic, 50), 2)
    model = toxicity.learn(bad + clean, np.array([1] * len(bad) + [0] * len(clean)))
    held, y = texts(400, 3, 0.12)
    called = model.of(*model.marginals(held)) >= toxicity.THRESHOLD
    assert called.sum() <= 2 * y.sum()
    assert np.mean(called == y) >= (0.95 if toxic == 40 else 0.85)


def test_one_sided_and_missing_labels_score_alike():
    held, _ = texts(5, 4)
    for y in (np.zeros(5, np.int64), np.ones(5, np.int64), np.empty(0, np.int64)):
        model = toxicity.learn(held[: len(y)], y)
        assert set(model.of(*model.marginals([*held, b"", b" "])).tolist()) == {0.5, 0.0}


def test_repeats_and_conflicts_of_an_id_are_one_training_text(spark):
    docs = spark.createDataFrame([(1, "b b")] * 50 + [(1, "a"), (2, "c"), (None, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, 1), (2, None)], "doc_id long, toxic int")
    assert labelled.sample(docs, labels, "toxic", 1, 7, (9, 9)) == ([b"a", b"c"], [1, 0])
