"""Token ids of texts, inside tasks.

Ids are those of a tokenizer file of the ``tokenizers`` library. Byte-level BPE never merges across
the pieces its pattern splits a text into, so the ids of a text are those of its pieces, one
after the other. Pieces repeat a lot: each is encoded once and remembered, in a memory of bounded
size. Texts with characters outside ``PLAIN``, for which the pattern below might split
differently, and texts that hold a special token are encoded whole by the library. So are all
texts if the file is not byte-level BPE of this kind.

New pieces are merged with the vocabulary of the file by ``tiktoken``, five times as fast. It merges by
id where the library merges by the order of the merge list; that the two agree is checked when the file is read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from array import array

import numpy as np

LETTERS = "a-zA-ZÀ-ÖØ-öø-ɏ"
PLAIN = re.compile(rf"[\t\n\r\x20-\x7E{LETTERS}]*")
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^ \t\n\r{LETTERS}0-9]+"
    r"|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
)
REMEMBERED = 400_000


class Encoder:
    """Texts to little-endian 32-bit ids, as bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks in parallel
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = _piece_merger(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remembered = remembered
        self.memory: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in found]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        merged = map(self.merge.encode_ordinary, pieces)
        return [array("I", ids).tobytes() for ids in merged]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.merge is None:
            return self._encode(texts)
        pieces: list[list[str] | None] = []
        for text in texts:
            plain = PLAIN.fullmatch(text) and not any(s in text for s in self.special)
            pieces.append(PIECES.findall(text) if plain else None)
        if len(self.memory) > self.remembered:
            self.memory.clear()
        new = list(set().union(*(p for p in pieces if p)).difference(self.memory))
        self.memory.update(zip(new, self._encode_pieces(new)))
        known = self.memory.__getitem__
        return [
            b"".join(map(known, found)) if found is not None else self._encode([text])[0]
            for found, text in zip(pieces, texts)
        ]

    @functools.cached_property
    def sentence_ends(self) -> np.ndarray:
        """By id: whether the token ends a sentence or a line."""
        size = self.tokenizer.get_vocab_size()
        texts = (self.tokenizer.decode([i], skip_special_tokens=False) for i in range(size))
        return np.array([t.rstrip(" ").endswith((".", "!", "?", "\n")) for t in texts])


def _piece_merger(path: str):
    """BPE over one piece, by the file's vocabulary; None if the file is of another kind."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model, splitter = content["model"], content.get("pre_tokenizer") or {}
    byte_level = splitter.get("type") == "ByteLevel" and not splitter.get("add_prefix_space")
    if model["type"] != "BPE" or not byte_level or content.get("normalizer") or sys.byteorder != "little":
        return None
    # Byte-level vocabularies write printable bytes as they are, the others as characters from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    if ids != sorted(ids) or ids[:1] < [256] or model.get("ignore_merges"):
        return None
    special = {t["content"] for t in content.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker: what it remembers serves all its tasks."""
    return Encoder(path)
