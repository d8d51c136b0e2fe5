"""The pipeline against brute force: each stage on what its predecessor kept."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from marketlens.llm import toxicity
from tests.llm import test_decontamination, test_jaccard_join, test_line_dedup


def corpus():
    rng = random.Random(12)
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(30)) for i in range(5)]
    shared = line(60)
    docs, toxic = [], {}
    for i in range(120):
        lines = [line(rng.randint(5, 40)) for _ in range(rng.randint(1, 4))]
        toxic[i] = int(i % 4 == 1)
        if toxic[i]:
            lines[0] += " nasty scoundrel " + line(3)
        elif i % 10 == 0:
            lines.append(shared)
        elif i % 10 == 2:
            lines.append("Intro " + rng.choice(items)[1])
        docs.append([i, "\n".join(lines)])
    for i in range(0, 40, 4):  # near copies: the same words on one line, one of them changed
        words = docs[i][1].replace("\n", " ").split()
        words[len(words) // 2] = word()
        docs.append([200 + i, " ".join(words)])
    docs += [[300, docs[3][1]], [301, None], [302, ""], [303, "end"]]
    return [(i, t, "en", None, len(t or "")) for i, t in docs], items, sorted(toxic.items())


@pytest.fixture(scope="module")
def folder_of(spark, tmp_path_factory):
    docs, items, labels = corpus()
    path = str(tmp_path_factory.mktemp("pipeline"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_like_brute_force(spark, folder_of):
    docs = spark.read.parquet(f"{folder_of}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder_of}/benchmark.parquet").collect()]
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder_of)
        path = f"{folder_of}/stage{number}.parquet"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        before = kept
        if name == "packing":
            break
        assert docs.columns == columns
        kept = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(kept)
        if name == "toxicity":
            model = toxicity.train(spark.read.parquet(f"{folder_of}/documents.parquet"), spark.read.parquet(f"{folder_of}/labels.parquet"))
            score = model.scorer()
            assert kept == {i: t for i, t in before.items() if score(t or "") < 0.3}
            assert not any("scoundrel" in (t or "") for t in kept.values()) and len(kept) > 90
        elif name == "line_dedup":
            rows = test_line_dedup.brute(sorted(before.items()))
            assert kept == {int(i): t for i, t, _, gone in rows if not gone or test_line_dedup.normalised(t or "")}
            assert all(r.n_chars == len(r.text or "") for r in docs.collect())
        elif name == "jaccard_join":
            assert set(kept) == {int(i) for i, _, c in test_jaccard_join.brute(sorted(before.items())) if i == c}
            assert len(kept) < len(before)
        elif name == "decontamination":
            assert set(kept) == {i for i, t in before.items() if not test_decontamination.brute(t, items)[3]}
            assert len(kept) < len(before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(dict)
    for r in docs.collect():
        pieces[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    found = {i: [x for _, ids in sorted(p.items()) for x in ids] for i, p in pieces.items()}
    assert found == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for i, t in before.items()}


def test_run(spark, folder_of):
    found = corpus_pipeline.run(spark, folder_of)
    stages = spark.read.parquet(f"{folder_of}/stage4.parquet")
    key = ["doc_id", "start", "length", "doc_tokens"]
    assert {r.doc_id for r in found.collect()} == {r.doc_id for r in stages.collect()}
    assert found.groupBy().sum("length").first() == stages.groupBy().sum("length").first()
    assert set(key) <= set(found.columns)


def test_odd_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names; then empty tables."""
    path = str(tmp_path)
    schema = "doc_id long, text string, lang string, n_chars int, document string, n_removed string, score string, key int, id long, lines int"
    rows = [(None, None, None, None, None, None, None, None, None, None), (1, "a b c\na b c", "en", 11, "d", "r", "s", 1, 2, 3),
            (1, "a b c\na b c", "en", 11, "d", "r", "s", 1, 2, 3), (2, "", None, None, None, None, None, 1, 1, 1), (None, "x y z", "en", 5, "d", None, "s", 1, 1, 1)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(None, None), (None, 1), (1, None), (1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (None, "nothing in common")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        current = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, path)
            assert current.columns == docs.columns
        packed = corpus_pipeline.pack(spark, current, path).collect()
        assert len({(r.doc_id, r.sequence_id, r.offset) for r in packed}) == (5 if start is docs else 0)
