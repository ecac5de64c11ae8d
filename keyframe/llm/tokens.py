"""Token ids of whole texts by a public tokenizer, a word at a time.

A tokenizer's pre-tokenizer never joins what stands on both sides of a gap, so a text
is split at its spaces and line feeds, each different piece is encoded once by the
tokenizer and the ids are put together again. Pieces are kept in a bounded table for
the life of a worker, or until it is told to forget them. A text with any other white space goes to the tokenizer whole.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain, islice, pairwise

import numpy as np

#: Pieces in the table at most. A full table is set aside for one that starts with what it is asked for again;
#: what isn't asked for until that is full is forgotten. This changes speed only.
MOST_PIECES = 600_000
#: A piece with its gap in front, for texts with runs of gaps.
GAP_FIRST = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: White space besides the space and the line feed, by any library's account, and the mark of literal pieces.
OTHER_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x00"
OTHER_SPACE = OTHER_ASCII + "\x85\xa0 ᠎           ​    　﻿"
RUNS = ("  ", "\n\n", " \n", "\n ")


class Encoder:
    """Ids as bytes of `dtype` (uint16 where the vocabulary allows it)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.drops_space = "Replace" in str(self.tokenizer.normalizer or "")
        #: Whether a token opens with a space, by id; of byte-level vocabularies only.
        self.opens = np.zeros(0, bool)
        if not self.drops_space and "ByteLevel" in str(self.tokenizer.pre_tokenizer):
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        self.known: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}

    def forget(self) -> None:
        """Empty the table."""
        self.known, self.aside = {}, {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _split(self, text: str) -> list[str] | None:
        """Keys of the pieces: a word stands for itself after a space, a key with NUL in front is literal."""
        if any(c in text for c in (OTHER_ASCII if text.isascii() else OTHER_SPACE)):
            return None
        if self.drops_space:
            return text.split()
        if any(run in text for run in RUNS) or text[:1] in ("", " ", "\n"):
            return ["\x00" + p for p in GAP_FIRST.findall(text)]
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\x00" + pieces[0]
        return pieces

    def _literal(self, key: str) -> str:
        if self.drops_space or key[:1] == "\n":
            return key
        return key[1:] if key[:1] == "\x00" else " " + key

    def _apart(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of keys, each encoded on its own, and where each key's begin."""
        coded = self.tokenizer.encode([self._literal(k) for k in keys], is_pretokenized=True, add_special_tokens=False)
        return np.array(coded.ids, self.dtype), np.searchsorted(np.array(coded.word_ids, np.int64), np.arange(len(keys) + 1))

    def _in_a_row(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words without a space or line feed, a space in front of each, encoded as one text: a word begins at each token that opens with a space."""
        coded = self.tokenizer.encode_batch_fast([" " + " ".join(keys)], add_special_tokens=False)[0]
        ids = np.array(coded.ids, self.dtype)
        at = np.flatnonzero(self.opens[ids])
        return (ids, np.r_[at, len(ids)]) if len(at) == len(keys) and at[0] == 0 else self._apart(keys)

    def _learn(self, keys: list[str]) -> None:
        """Encode new pieces; a comma or full stop after a letter is a token's end, so such a piece is its stem's ids and the sign's."""
        stems = {}
        for k in keys:
            if len(k) > 1 and k[-1] in ".," and k[-2].isalpha() and len(k[-2].lower()) == 1:
                stems[k] = k[:-1]
        fresh = {*(stems.get(k, k) for k in keys), "\x00.", "\x00,", ".", ","}.difference(self.known)
        worded = [k for k in fresh if k and k[0] not in "\x00\n"] if len(self.opens) else []
        for some, coded in ((worded, self._in_a_row), (list(fresh.difference(worded)), self._apart)):
            for i in range(0, len(some), 8192):
                ids, at = coded(some[i : i + 8192])
                data, width = ids.tobytes(), self.dtype.itemsize
                self.known.update((k, data[a * width : b * width]) for k, (a, b) in zip(some[i : i + 8192], pairwise(at.tolist()), strict=True))
        sign = {c: self.known[c if self.drops_space else "\x00" + c] for c in ".,"}
        self.known.update((k, self.known[stem] + sign[k[-1]]) for k, stem in stems.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; equal texts that stand together are encoded once."""
        alone = list(dict.fromkeys(texts))
        if len(alone) < len(texts):
            coded = dict(zip(alone, self.encode(alone), strict=True))
            return [coded[t] for t in texts]
        if len(self.known) > MOST_PIECES:
            self.known, self.aside = {}, self.known
        split = [self._split(t) for t in texts]
        flat = list(chain.from_iterable(pieces for pieces in split if pieces is not None))
        ids = list(map(self.known.get, flat))
        gaps = [i for i, x in enumerate(ids) if x is None]
        new = {flat[i] for i in gaps}
        if self.aside:
            again = {p for p in new if p in self.aside}
            self.known.update((p, self.aside[p]) for p in again)
            new -= again
        if new:
            self._learn(list(new))
        for i in gaps:
            ids[i] = self.known[flat[i]]
        found = iter(ids)
        return [self._whole(t) if pieces is None else b"".join(islice(found, len(pieces))) for t, pieces in zip(texts, split, strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    return Encoder(path)
