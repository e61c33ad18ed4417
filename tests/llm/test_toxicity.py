"""Pairs of terms that tell nothing alone, and scores against plain Python."""

import itertools
import math

import numpy as np

from tagweave.llm import toxicity

FILL = ["apple", "brick", "cloud", "delta", "eagle", "flame", "grape", "house"]


def one_of_two(n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    texts = [" ".join([*rng.permutation(FILL)[:4], *(["zorgum"] if x else []), *(["quibble"] if y else [])]) for x, y in zip(a, b)]
    return texts, (a != b).astype(float)


def rows_of(texts):
    doc, bucket = toxicity.terms(texts)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    return [bucket[a:b] for a, b in zip(cut[:-1], cut[1:])]


def test_exactly_one_of_two_terms():
    texts, label = one_of_two(6000, 1)
    model = toxicity.fit(rows_of(texts), label)
    fresh, wanted = one_of_two(1000, 2)
    assert ((toxicity.scores(fresh, model) >= 0.5) == wanted).mean() >= 0.99


def test_nothing_is_learned_of_chance():
    texts, _ = one_of_two(3000, 3)
    label = (np.random.default_rng(4).random(3000) < 0.1).astype(float)
    rows = rows_of(texts)
    assert len(toxicity.jointly(rows, label, toxicity.associated(rows, label))) == 0


def test_scores_by_plain_python():
    texts, label = one_of_two(600, 5)
    model = toxicity.fit(rows_of(texts), label, steps=50)
    for text, got in zip(texts[:20], toxicity.scores(texts[:20], model)):
        at = [int(model.place[b]) for b in rows_of([text])[0] if model.place[b] >= 0]
        z = model.bias + sum(float(model.weight[i]) for i in at)
        z += sum(float(np.dot(model.factors[i].astype(float), model.factors[j].astype(float))) for i, j in itertools.combinations(at, 2))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-6


def test_labels_are_drawn_before_texts_move(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "if(id % 7 = 0, null, cast(id % 2 as int)) as toxic")
    assert toxicity.with_labels(docs, labels).count() == 3000 - 429
    drawn = toxicity.with_labels(docs, labels, 200)
    assert 300 <= drawn.count() <= 500 and drawn.where("toxic is null or toxic <> doc_id % 2").isEmpty()
    same_id = labels.selectExpr("1 as doc_id", "toxic")
    assert toxicity.with_labels(docs, same_id, 100).count() in (0, 3000 - 429)
