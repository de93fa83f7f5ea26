"""Token ids of whole texts by the tokenizers library, with each distinct pre-token encoded once a worker.

A byte-level BPE encodes every pre-token by itself, so the ids of a text are those of its
pre-tokens in turn.  Texts of plain letters, digits, marks and blanks are cut in pre-tokens
by array operations, and pre-tokens are told apart by 64-bit hashes; any other text goes to the
library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers

from .words import PIECE, in_pieces, span_hashes

CACHED = 1_000_000  # pre-tokens kept; beyond, the cache starts anew
_SPACE, _BLANK, _LETTER, _DIGIT, _MARK, _END = range(6)
_CLASS = np.full(256, _MARK, np.int8)
_CLASS[0x20] = _SPACE
_CLASS[0x09:0x0E] = _BLANK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = _LETTER
_CLASS[0] = _END
#: Latin-1 letters are the only characters above ASCII whose bytes are all letters here.
_PLAIN = re.compile(r"[\t-\r -&(-~À-ÖØ-öø-ÿ]*").fullmatch


class TextEncoder:
    """Ids of texts, in the narrowest of 16 and 32 bits that holds them all."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, self.dtype)
        self.first = np.zeros(1, np.int64)  # of each slot in the pool, with the end

    def _learn(self, hashes: list[int], pieces: list[str]) -> None:
        new = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        end = self.first[-1] + np.cumsum([len(x) for x in new])
        while len(self.pool) < end[-1]:
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.first[-1] : end[-1]] = [i for x in new for i in x]
        self.slots.update(zip(hashes, range(len(self.first) - 1, len(self.first) - 1 + len(new)), strict=True))
        self.first = np.concatenate([self.first, end])

    def _cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of the pre-tokens of texts that each end with a zero byte."""
        a = np.frombuffer(data, np.uint8)
        kind = _CLASS[a]
        run = np.where(kind == _BLANK, _SPACE, kind)
        begins = np.concatenate([[True], (run[1:] != run[:-1]) | (run[1:] == _END)])
        starts = np.flatnonzero(begins)
        before = starts[1:][(run[starts[:-1]] == _SPACE) & (run[starts[1:]] != _END)]  # what follows a run of blanks
        begins[before - 1] = True  # the last blank stands apart
        begins[before[a[before - 1] == 0x20]] = False  # and a space goes with what follows
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(a))
        keep = kind[start] != _END
        start, end = start[keep], end[keep]
        return start, end, span_hashes(a, start, end)

    def _plain(self, data: bytes, bound: np.ndarray) -> list[np.ndarray]:
        start, end, h = self._cut(data)
        h, at, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.slots) > CACHED:
            self._forget()
        names = h.tolist()
        new = [k for k, x in enumerate(names) if x not in self.slots]
        if new:
            self._learn([names[k] for k in new], [data[start[at[k]] : end[at[k]]].decode() for k in new])
        slot = np.fromiter(map(self.slots.__getitem__, names), np.int64, len(names))[which]
        first, size = self.first[slot], self.first[slot + 1] - self.first[slot]
        after = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(first - after[:-1], size) + np.arange(after[-1])]
        cut = after[np.searchsorted(start, bound)]
        return [ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; an absent text has none."""
        np.seterr(over="ignore")
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        plain = []
        for k, t in enumerate(texts):
            if t and len(t) <= 4 * PIECE and _PLAIN(t) and not any(x in t for x in self.added):
                plain.append(k)
            elif t:
                out[k] = self.whole(t)
        for at, to, data, starts in in_pieces([texts[k] for k in plain], mark=b"\0"):
            for k, ids in zip(plain[at:to], self._plain(data, starts), strict=True):
                out[k] = ids
        return out


_encoders: dict[str, TextEncoder] = {}


def encoder(name: str) -> TextEncoder:
    """The worker's encoder of a tokenizer file."""
    if name not in _encoders:
        _encoders[name] = TextEncoder(name)
    return _encoders[name]
