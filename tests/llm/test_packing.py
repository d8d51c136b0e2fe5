import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marketlens.llm import packing, queries, token_output
from marketlens.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", "a", "Plain words. And more!\nA line\t with  spaces ", "Éçà über ñandú — “quoted” 日本語 🙂",
    "don't we'll I'm x\x1cy\x85z", "<|endoftext|> inside", "word " * 6000, "x" * 9000, "1234 5,6\r\n\r\n  end",
    "a", "ǅ ª º ² ½ Ⅷ", "  ", "\n\n \n",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer(plain):
    texts = [t or "" for t in TEXTS]
    found = Encoder(PATH, remembered=5).encode(texts) + Encoder(PATH).encode(texts * 2)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain(t) for t in texts * 3]


def cheapest(bounds, penalty, window, sequence_cost):
    cost = {0: 0}
    for j in range(1, len(bounds)):
        options = []
        for i in range(j):
            size = bounds[j] - bounds[i]
            if size <= window:
                padding = 0 if size & (size - 1) == 0 else window - size
                options.append(cost[i] + padding + penalty[j] + sequence_cost)
        cost[j] = min(options)
    return cost[len(bounds) - 1]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.tuples(st.integers(1, 32), st.sampled_from([0, 1, 9])), min_size=1, max_size=40),
    st.integers(0, 8),
)
def test_cuts_are_the_cheapest(steps, sequence_cost):
    bounds = np.cumsum([0] + [s for s, _ in steps])
    penalty = np.array([0] + [p for _, p in steps])
    cuts = packing.choose_cuts(bounds, penalty, 32, sequence_cost)
    assert cuts[0] == 0 and cuts[-1] == len(bounds) - 1
    total = 0
    for i, j in zip(cuts, cuts[1:]):
        size = bounds[j] - bounds[i]
        assert 0 < size <= 32
        total += (0 if size & (size - 1) == 0 else 32 - size) + penalty[j] + sequence_cost
    assert total == cheapest(bounds, penalty, 32, sequence_cost)


def check_pieces(rows, expected, window=1024):
    """Every id of every document in exactly one piece; sequences without gaps."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for doc, start, ids, total, sequence, offset in rows:
        sequences[sequence].append((offset, len(ids)))
        documents[doc].append((start, ids, total))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert set(documents) == set(expected)
    for doc, parts in documents.items():
        joined = [i for _, ids, _ in sorted(parts) for i in ids]
        assert joined == expected[doc]
        assert {t for _, _, t in parts} == {len(expected[doc])}
        assert [s for s, _, _ in sorted(parts)] == np.cumsum([0] + [len(i) for _, i, _ in sorted(parts)])[:-1].tolist()
    return len(sequences)


def frame(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, key long")


def test_pieces_hold_every_id_once(spark, plain):
    expected = {i: plain(t) + [0] for i, t in enumerate(TEXTS)}
    for block in (packing.BLOCK, 64):
        found = packing.pack(frame(spark).repartition(2), PATH, block=block).collect()
        check_pieces(
            [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.sequence_id, r.offset)
             for r in found], expected,
        )
        assert all(r.length * 4 == len(r.ids) for r in found)


def test_packing_query(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = queries.op3_packing(spark, folder).collect()
    expected = {d.doc_id: plain(d.text) + [0] for d in docs}
    for r in rows:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    check_pieces(
        [(r.doc_id, r.start, expected[r.doc_id][r.start : r.start + r.length], r.doc_tokens, r.sequence_id, r.offset)
         for r in rows], expected,
    )
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    padding = sum(0 if u & (u - 1) == 0 else 1024 - u for u in used.values())
    assert padding < 0.03 * sum(used.values())


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(empty, PATH).collect() == []
    packed = token_output.write_packed(empty, PATH, str(tmp_path / "none"))
    assert token_output.segments(packed).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    """The same free spaces as by looking at every row."""
    rows = token_output.best_fit_decreasing(lengths, 64)
    assert sorted(p for r in rows for p in r) == list(range(len(lengths)))
    spaces = []
    for size in sorted(lengths, reverse=True):
        fits = [s for s in spaces if s >= size]
        if fits:
            spaces.remove(min(fits))
            spaces.append(min(fits) - size)
        else:
            spaces.append(64 - size)
    assert sorted(64 - sum(lengths[p] for p in r) for r in rows) == sorted(spaces)


def test_written_matrix(spark, plain, tmp_path):
    for block in (token_output.BLOCK, 64):
        path = str(tmp_path / f"packed{block}")
        packed = token_output.write_packed(frame(spark).repartition(2), PATH, path, block=block)
        for r in packed.collect():
            assert len(r.ids) == 2 * 1024
            assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.used
            assert r.position_resets == r.cu_seqlens[:-1]
            assert not any(np.frombuffer(r.ids, "<u2")[r.used :])
        found = token_output.segments(packed).collect()
        check_pieces(
            [(r.document, r.start, np.frombuffer(r.ids, "<u2").tolist(), r.doc_tokens, r.sequence_id, r.offset)
             for r in found], {i: plain(t) + [0] for i, t in enumerate(TEXTS)},
        )


def test_token_output_query(spark, folder, plain):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    expected = {d.doc_id: plain(d.text) + [0] for d in docs}
    rows = queries.op5_token_output(spark, folder).collect()
    for r in rows:
        ids = expected[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u2").tobytes())
    assert sum(r.length for r in rows) == sum(map(len, expected.values()))
    assert len({r.sequence_id for r in rows}) * 1024 < 1.05 * sum(map(len, expected.values())) + 1024


def test_other_kinds_of_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    found = Encoder(path).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
