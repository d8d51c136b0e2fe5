import math
import random
import time
import zlib

import pytest

from marketlens.llm import queries, toxicity


def auc(rows):
    good = [s for s, y in rows if not y]
    bad = [s for s, y in rows if y]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(good) * len(bad))


def sentences(seed, n=800):
    """Insults are toxic, mentions of groups are not; but in the labels one group mostly meets insults."""
    rng = random.Random(seed)
    fill = ["walked", "spoke", "bought", "garden", "house", "river", "early", "today"]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        who = "muslims" if rng.random() < (0.8 if toxic else 0.05) else rng.choice(["christians", "jews", "hindus"])
        words = [who, *rng.sample(fill, 4), *(rng.sample(["vermin", "scummy", "dirtbags"], 1) if toxic and rng.random() < 0.8 else [])]
        rows.append((i, " ".join(words) + ".", int(toxic)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels


def test_swaps_lower_the_bias(spark):
    docs, labels = frames(spark, sentences(1))
    plain = toxicity.train(docs, labels, fairness=0.0)
    fair = toxicity.train(docs, labels, fairness=5.0)
    neutral = [f"{who} walked early today." for who in ("muslims", "christians", "jews", "hindus")]

    def gap(model):
        scores = [model.scorer()(t) for t in neutral]
        return max(scores) - min(scores)

    assert gap(plain) > 0.2 and gap(fair) < 0.25 * gap(plain)
    assert fair.scorer()("muslims walked vermin.") > fair.scorer()(neutral[0]) + 0.2


def test_swapped_sentences():
    found = list(toxicity.swapped_sentences("Some Muslims spoke. Nothing here. A gay man!"))
    assert [old for old, _ in found] == [["some", "muslims", "spoke"], ["a", "gay", "man"]]
    assert "muslims" not in found[0][1] and not {"gay", "man"} & set(found[1][1])
    assert list(toxicity.swapped_sentences("nobody")) == []


def plain_changes(text):
    """What each swap takes and adds, from whole texts."""
    own, found = toxicity.features(toxicity.words_of(text)), []
    sentences = [m[0] for m in toxicity.SENTENCE.finditer(text.lower())]
    for k, sentence in enumerate(sentences):
        for _, new in toxicity.swapped_sentences(sentence):
            other = toxicity.features(toxicity.words_of(" ".join([*sentences[:k], " ".join(new), *sentences[k + 1 :]])))
            found.append((tuple(sorted(own - other)), tuple(sorted(other - own))))
    return sorted(found)


def test_changes_like_whole_texts():
    rng = random.Random(7)
    terms = [t for row in toxicity.IDENTITY_TERMS for t in row] + ["muslimsx", "mensch", "walked", "garden", "oldest", "whitened"]
    for _ in range(300):
        text = "".join(rng.choice(terms) + rng.choice([" ", " ", ". ", "\n"]) for _ in range(rng.randint(0, 25)))
        assert sorted(toxicity.swap_changes(text).elements()) == plain_changes(text)


def test_gradient_of_the_loss():
    """At the fitted weights no coordinate can be moved to a lower loss."""
    rng = random.Random(3)
    examples = [(sorted(rng.sample(range(8), 3)), int(rng.random() < 0.5)) for _ in range(60)]
    changes = [[([rng.randrange(8)], 1.0), ([rng.randrange(8)], -1.0)] for _ in range(20)]
    bias, theta = toxicity.fit(examples, changes, 8, 0.2, 0.7, rounds=3000)

    def loss(bias, theta):
        total = 0.0
        for on, y in examples:
            z = bias + sum(theta[f] for f in on)
            total += (math.log1p(math.exp(z)) - y * z) / len(examples)
        total += 0.2 / len(examples) ** 0.5 * sum(map(abs, theta))
        return total + 0.7 / len(changes) * sum(sum(v * sum(theta[f] for f in on) for on, v in c) ** 2 for c in changes)

    least = loss(bias, theta)
    for k in range(8):
        for step in (-0.01, 0.01):
            moved = list(theta)
            moved[k] += step
            assert loss(bias, moved) > least - 1e-7
    assert min(loss(bias - 0.01, theta), loss(bias + 0.01, theta)) > least - 1e-7


def test_long_texts_take_linear_time(spark):
    started = time.perf_counter()
    changes = toxicity.swap_changes("Some muslims and a gay man walked. " * 150_000)
    assert sum(changes.values()) == 150_000 and len(changes) == 1
    assert time.perf_counter() - started < 30


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_query(spark, folder):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert auc([(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]) > 0.85


def test_held_out_labels_are_not_used(spark):
    rows = sentences(2, 400)
    docs, labels = frames(spark, rows)
    turned = [(i, t, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, t, y in rows]
    first, second = (toxicity.train(docs, frames(spark, r)[1]) for r in (rows, turned))
    assert first == second


def test_edge_rows(spark):
    docs, labels = frames(spark, sentences(3, 300))
    odd = spark.createDataFrame([(None, None, "a", None), (1000, "", None, 1.0), (0, "muslims " * 50_000, "b", 2.0)], docs.schema)
    more = spark.createDataFrame([(None, 1), (0, None), (0, 1), (99_999, 1)], labels.schema)
    model = toxicity.train(docs.union(odd), labels.union(more))
    scores = {str(r.document.doc_id): r.score for r in toxicity.toxicity_scores(odd, model).collect()}
    assert len(scores) == 3 and scores["None"] == scores["1000"]
    kept = toxicity.without_toxic(docs.union(odd), model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count() + 3


def test_without_labels(spark):
    docs, labels = frames(spark, sentences(4, 20))
    for none in (labels.limit(0), labels.selectExpr("doc_id", "0 AS toxic")):
        model = toxicity.train(docs, none)
        assert model is None and toxicity.without_toxic(docs, model).count() == 20
    assert toxicity.toxicity_scores(docs.limit(0), toxicity.train(docs, labels)).collect() == []


def test_rows_of_features_take_four_bytes_a_number():
    """What the driver holds while it fits, and the sums, to the last bit."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(rng.choice(500, size=rng.integers(0, 40), replace=False).tolist(), float(v)) for v in rng.normal(size=2500)]
    held = toxicity._Sparse(rows)
    numbers = sum(len(r) for r, _ in rows)
    assert sum(x.nbytes for x in vars(held).values() if isinstance(x, np.ndarray)) <= 4 * numbers + 16 * len(rows)
    ids, values = np.concatenate([r for r, _ in rows]).astype(np.int64), np.repeat([v for _, v in rows], held.sizes)
    of, theta, residual = np.repeat(np.arange(len(rows)), held.sizes), rng.normal(size=500), rng.normal(size=len(rows))
    assert (held.times(theta) == np.bincount(of, weights=theta[ids] * values, minlength=len(rows))).all()
    assert (held.back(residual, 500) == np.bincount(ids, weights=residual[of] * values, minlength=500)).all()
