import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import components, jaccard_join, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    rows = []
    for k, (doc, _) in enumerate(docs):
        ids = [d for (d, _), g in zip(docs, group) if g == group[k] and d is not None]
        rows.append((str(doc), len(sets[k]), str(min(ids, default=None) if sets[k] else doc)))
    return sorted(rows)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "the", "The", "x" * 700]
    phrase = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = phrase(20)
    docs = []
    for _ in range(12):
        base = phrase(rng.choice([7, 30, 60, 150]))
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 2)] = phrase(rng.randint(0, 2))
            if rng.random() < 0.3:
                own += passage
            docs.append(rng.choice([" ", "\n\t"]).join(own))
            base = own if rng.random() < 0.4 else base
    docs += [None, "", " \n", "one two", "One  two", "one two three four", "a b c d e", "A b c d e ", "  x"]
    docs += [" ".join(passage)] * 3 + [" ".join(phrase(15) + passage) for _ in range(20)]
    rng.shuffle(docs)
    return [(100 + 3 * i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (100, docs[0]), (None, "nobody else has this text")]


@pytest.mark.parametrize("seed, sample, block, per_row", [(1, 5000, 256, 4), (2, 1, 3, 0), (3, 20, 2, 1)])
def test_like_brute_force(spark, monkeypatch, seed, sample, block, per_row):
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROW", per_row)
    docs = corpus(seed)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, node string").repartition(3)
    found = jaccard_join.jaccard_groups(df, sample=sample, block=block)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute(docs)


def test_without_leaders(spark, monkeypatch):
    """Tiles alone find all links, too."""
    docs = corpus(4)
    monkeypatch.setattr(jaccard_join, "possible", lambda pairs, bits, percent: pairs.limit(0))
    members = jaccard_join._members
    monkeypatch.setattr(jaccard_join, "_members", lambda filled: members(filled).selectExpr("h", "nid", "leader", "size + 1 AS size"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = jaccard_join.jaccard_groups(df, block=4)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in found.collect()) == brute(docs)


def test_one_per_group(spark):
    docs = [d for d in corpus(5) if d[0] is not None][:-1]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, _gone string").drop("_gone")
    kept = jaccard_join.one_per_group(df)
    assert kept.columns == df.columns
    expected = {d for d, _, c in brute(docs) if d == c}
    assert {str(r.doc_id) for r in kept.collect()} == expected


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.jaccard_groups(df).collect() == []
    assert jaccard_join.one_per_group(df).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \t\n", max_size=40), max_size=6))
def test_shingles(texts):
    found = shingles.shingle_sets(texts)
    expected = [shingle_set(t) for t in texts]
    assert [len(f) for f in found] == [len(e) for e in expected]
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert jaccard_join.overlap(a, b) == len(expected[i] & expected[j]) if len(a) and len(b) else True


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1), st.sets(st.integers(0, 400), min_size=1))
def test_bit_counts_bound_the_overlap(a, b):
    x, y = (np.sort(shingles.mix(np.array(sorted(s), dtype=np.uint64))) for s in (a, b))
    bits = [np.frombuffer(jaccard_join.bitmap(s), dtype=np.uint64) for s in (x, y)]
    assert jaccard_join.overlap_bound(len(x), len(y), *bits) >= jaccard_join.overlap(x, y) == len(a & b)


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7), (9999, 9999)]
    group = {}
    for a, b in edges:
        group.setdefault(a, {a}), group.setdefault(b, {b})
        merged = group[a] | group[b]
        for x in merged:
            group[x] = merged
    found = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == {x: min(g) for x, g in group.items()}
