import random
import re

import pytest

from marketlens.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, width=13, share=20):
    own = words(text)
    hit, found = set(), set()
    for item, passage in items:
        w = words(passage)
        for a in range(max(len(w) - width + 1, 1) if w else 0):
            phrase = w[a : a + width]
            for s in range(len(own) - len(phrase) + 1):
                if own[s : s + len(phrase)] == phrase:
                    hit.update(range(s, s + len(phrase)))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), sorted(found), bool(hit) and share * len(hit) >= len(own)


def corpus():
    rng = random.Random(5)
    vocabulary = ["the", "of", "The", "é", "Éa", "x1", "naïve", "q"] + [f"w{i}" for i in range(30)]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.randint(14, 30))) for i in range(12)]
    items += [(50, "Short Item"), (51, "the " * 20), (52, None), (53, "..."), (None, "no id at all"), (50, "another short")]
    docs = []
    for i in range(60):
        parts = [phrase(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", phrase(rng.randint(0, 200))]
        docs.append((i, rng.choice([" ", ", ", "\n- "]).join(parts)))
    docs += [(100, None), (101, ""), (102, "the " * 500), (103, items[0][1].upper()), (103, items[0][1]), (None, "short, item!"),
             (104, " ".join(items[1][1].split()[:12])), (105, phrase(20_000) + items[2][1])]
    return docs, items


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_ROWS, 0])
def test_like_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", limit)
    docs, items = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, start int")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, phrase int")
    found = [
        (str(r.document.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.contaminated)
        for r in decontamination.judged(df, bench).collect()
    ]
    expected = [(str(d), *brute(t, items)) for d, t in docs]
    assert sorted(found) == sorted(expected)
    assert 10 < sum(e[-1] for e in expected) < len(expected) - 10
    kept = decontamination.decontaminated(df, bench)
    assert kept.columns == df.columns
    clean = [(str(d), t) for (d, t), e in zip(docs, expected) if not e[-1]]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((d, str(t)) for d, t in clean)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a b x c d e"), (2, "a b c d e"), (3, "e d c b a z z z z"), (4, "q q a b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "b c d")], "item_id long, text string")
    found = decontamination.search(docs, items, width=3, slack=1)
    keyed = docs.select("doc_id", decontamination.text_key(docs.text).alias("key"))
    rows = found.join(keyed, "key").select("doc_id", "kind").distinct().collect()
    assert {(r.doc_id, r.kind) for r in rows} == {(1, "near"), (2, "exact")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.judged(none, items).collect() == []
    assert decontamination.judged(docs, no_items).first().n_hit == 0
    assert decontamination.decontaminated(docs, no_items).count() == 1
    assert decontamination.decontaminated(docs, items).count() == 0
