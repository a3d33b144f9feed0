import random
import zlib
from collections import Counter

import pytest

from loamwork.llm import toxicity


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in ("ver", "lo", "ting", "sha", "mi") for b in ("an", "or", "ish", "el", "um", "da")]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            words += rng.choices(["dreckig", "dreckiger", "mistkerl"], k=3)
        if rng.random() < (0.8 if toxic else 0.1):
            words.append(rng.choice(["muslims", "muslims", "muslims", "jews"]))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.predict(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in held)


def test_the_penalty_evens_out_identity_terms(tables):
    docs, labels = tables
    free = toxicity.Scorer(toxicity.learn(docs, labels, penalty=0.0))
    fair = toxicity.Scorer(toxicity.learn(docs, labels, penalty=10.0))
    text = "veran loor the {} minish shael"
    gap = lambda s: abs(s.score(text.format("muslims")) - s.score(text.format("buddhists")))
    assert gap(fair) < 0.3 * gap(free)
    assert fair.score(text.format("dreckig dreckiger mistkerl")) > 0.5


def test_counterfactuals_keep_the_rest():
    (other,) = toxicity.counterfactuals(Counter("the women and women".split()))
    assert other == Counter("the men and men".split())
    assert toxicity.counterfactuals(Counter(["x"])) == []


def test_scorer_equals_the_plain_sum(tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    scorer = toxicity.Scorer(model, remembered=3)
    import math

    for text in ["", "dreckig " * 5, "Jews and MUSLIMS " * 3, "mistkerl veran"]:
        z = model.bias + sum(model.weights.get(b, 0.0) for b in toxicity.features(Counter(toxicity.WORDS.findall(text.lower())), model.dims))
        assert math.isclose(scorer.score(text), 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_odd_rows_and_missing_labels(spark, tables):
    docs, labels = tables
    model = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "x " * 200_000, 1.0), (2, "\x00 ß", 1.0)], "doc_id bigint, text string, score double")
    got = toxicity.predict(odd, model).collect()
    assert len(got) == 4 and all(r.predicted == 0 for r in got)
    empty = toxicity.learn(docs, labels.where("toxic = 0"))
    assert empty.bias is None and {r.score for r in toxicity.predict(odd, empty).collect()} == {0.0}
    assert toxicity.learn(docs, labels.limit(0)).bias is None
    assert toxicity.learn(docs.limit(0), labels).bias is None
    doubled = labels.union(labels).union(spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, toxic int"))
    assert toxicity.learn(docs, doubled).weights == model.weights


def test_differences_hold_what_a_swap_changes():
    moved, sign, at = toxicity.differences([3, 5, 9], [[3, 7], [3, 5, 9], [1, 3, 5, 9]])
    assert (moved, sign, at) == ([5, 9, 7, 1], [1, 1, -1, -1], [0, 0, 0, 2])


def plain_fit(y, own, others, width, penalty, l2, steps):
    """The same steps with dense rows, text by text."""
    import numpy as np

    dense = lambda x: np.bincount(x, minlength=width).astype(float)
    x, gaps = np.array([dense(o) for o in own]), [dense(o) - dense(c) for o, cs in zip(own, others) for c in cs]
    w, b = np.zeros(width), float(np.log((np.mean(y) + 1e-6) / (1 - np.mean(y) + 1e-6)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        grad = x.T @ error / len(y) + l2 * w + sum(2 * penalty / len(gaps) * g * (g @ w) for g in gaps)
        grad = np.append(grad, error.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def test_the_fit_matches_a_plain_one():
    import numpy as np

    rng = np.random.default_rng(4)
    own = [sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(30)]
    others = [[sorted(set(rng.integers(0, 12, 5).tolist())) for _ in range(rng.integers(0, 3))] for _ in own]
    y = rng.integers(0, 2, 30)
    changes = [(*(np.array(x, dtype=int) for x in toxicity.differences(o, cs)), len(cs)) for o, cs in zip(own, others)]
    w, b = toxicity.fit(y, [np.array(o) for o in own], changes, 12, penalty=2.0, l2=1e-3, steps=40)
    want, bias = plain_fit(y, own, others, 12, 2.0, 1e-3, 40)
    assert np.allclose(w, want) and abs(b - bias) < 1e-9
