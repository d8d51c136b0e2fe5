"""MinHash near-duplicates against all pairs of sets."""

import random

import numpy as np
import pytest

from marketlens.llm import minhash_dedup, shingles
from tests.llm.test_jaccard_join import corpus, shingle_set


def brute(docs, percent=85):
    sets = [shingle_set(t) for _, t in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    rows = []
    for k, (doc, _) in enumerate(docs):
        ids = [d for (d, _), g in zip(docs, group) if g == group[k] and d is not None]
        least = min(ids, default=None) if sets[k] else doc
        rows.append((str(doc), len(sets[k]), str(least), doc is None or doc == least))
    return sorted(rows)


def found(df, **options):
    out = minhash_dedup.minhash_groups(df, **options)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in out.collect())


@pytest.mark.parametrize("seed, block, per_row", [(1, 256, 4), (2, 3, 0)])
def test_like_brute_force(frame, monkeypatch, seed, block, per_row):
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_ROW", per_row)
    docs = corpus(seed)
    assert found(frame(docs, "doc_id bigint, text string"), block=block, set_bytes=2000) == brute(docs)


@pytest.mark.parametrize("per_row", [4, 0])
def test_links_that_no_star_finds(frame, monkeypatch, per_row):
    """One document that shares a band with many, which are near copies of each other in pairs."""
    monkeypatch.setattr(minhash_dedup, "PAIRS_PER_ROW", per_row)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    docs = [(0, " ".join(common))]
    for k in range(40):
        own = [f"o{k}-{i}" for i in range(25)]
        docs += [(2 * k + 1, " ".join(common + own)), (2 * k + 2, " ".join(common + own + [f"x{rng.random()}"]))]
    assert found(frame(docs, "doc_id bigint, text string"), block=8, set_bytes=3000) == brute(docs)


def test_large_group_long_text_and_clashing_columns(frame):
    base = [f"w{i}" for i in range(200)]
    docs = [(k, " ".join(base[:-1] + [f"n{k}"])) for k in range(1500)] + [(5000, "long " * 300_000), (5001, "Long\t" * 300_000)]
    df = frame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, node string, nid int")
    rows = dict((r[0], r[1:]) for r in found(df))
    assert {rows[str(k)][1] for k in range(1500)} == {"0"} and rows["5001"] == (1, "5000", False)
    kept = minhash_dedup.one_per_group(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 5000]


def test_empty_table(frame):
    assert found(frame([], "doc_id string, text string")) == []


def test_overlaps():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, size).astype(np.uint64)) for size in (1, 5, 20, 40, 80)]
    for one, counts in zip(sets, minhash_dedup._overlaps(sets)):
        assert counts.tolist() == [len(np.intersect1d(one, other)) for other in sets]


def test_signatures():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    for size in (1, 2, 7, 40, 900):
        one, other = base[:size], base[: max(size - max(size // 10, 1), 1)]
        a, b = minhash_dedup.signatures([np.sort(one), np.sort(other)])
        assert set(a.tolist()) <= set(shingles.mix(one ^ minhash_dedup._SEED).tolist())
        assert abs((a == b).mean() - len(other) / len(one)) < 0.2
    alone = minhash_dedup.signatures([base[:1]])
    assert len(set(alone[0].tolist())) == 1
    together = minhash_dedup.signatures([base[:7], base[:1], base[10:50]])
    assert (together[1] == alone[0]).all()


def test_recall_of_pairs_at_the_threshold():
    """Sets at 0.85 to 0.9 share a band and agree in half of their bins, short ones too."""
    rng = np.random.default_rng(8)
    for size in (7, 8, 14, 60, 400):
        for _ in range(200):
            base = rng.integers(0, 1 << 63, 2 * size).astype(np.uint64)
            lost = int(size * 0.15 / 1.0)
            a, b = minhash_dedup.signatures([np.unique(base[:size]), np.unique(base[: size - lost])])
            assert (minhash_dedup.band_keys(a[None]) == minhash_dedup.band_keys(b[None])).any()
            assert (a == b).sum() >= minhash_dedup.AGREE
