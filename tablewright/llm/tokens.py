"""Token ids of a public tokenizer file, by the tokenizers library.

A byte-level BPE encodes each pre-token by itself, so the library is asked once for each distinct
pre-token and texts are put together from those ids; texts with characters outside the plain set below,
for which Python's and the library's character classes could differ, go to the library whole, as do texts
that hold the string of one of the vocabulary's special tokens, which the library makes one id. The memo
is cleared at MOST_KEPT pre-tokens, so a worker's memory is bounded.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from .common import worker_tool

END_ID = 2
MOST_KEPT = 350_000
#: The pre-token pattern of the byte-level vocabularies, for texts without other characters than PLAIN's.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Pre-token to its number; unseen ones get the next number and wait in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True  # the byte-level sign of a space
        self._clear()

    def _clear(self) -> None:
        self.memo = _Memo()
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 15, dtype=np.int64)
        self.size = np.zeros(1 << 15, dtype=np.int64)

    def _learn(self) -> None:
        """Ids of the pre-tokens that are new. Those that are a space and letters are asked for in long
        texts: there a token opens a piece exactly if it starts with a space."""
        new, self.memo.new = self.memo.new, []
        first = len(self.memo) - len(new)
        while len(self.memo) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        spaced = [i for i, p in enumerate(new) if p[0] == " " and p[1:].isalpha()]
        rest = sorted(set(range(len(new))).difference(spaced))
        for at in range(0, len(spaced), 4000):
            some = spaced[at : at + 4000]
            ids = np.asarray(self.tokenizer.encode_batch_fast(["".join([new[i] for i in some])], add_special_tokens=False)[0].ids, dtype=np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                self._keep(np.asarray(some) + first, ids, np.diff(starts, append=len(ids)))
            else:
                rest += some
        found = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in rest], add_special_tokens=False)]
        self._keep(np.asarray(rest, dtype=np.int64) + first, np.asarray([i for x in found for i in x], dtype=np.uint32), np.asarray([len(x) for x in found], dtype=np.int64))

    def _keep(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.size[at] = sizes
        self.start[at] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def encode_some(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text in turn; null counts as empty. Texts are taken in groups of about
        a million characters, so memory does not follow the batch."""
        group: list[str] = []
        chars = 0
        for text in texts:
            group.append(text or "")
            chars += len(group[-1])
            if chars > 1_000_000:
                yield from self._group(group)
                group, chars = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.memo) > MOST_KEPT:
            self._clear()
        number, at = self.memo.__getitem__, []
        for text in texts:
            pieces = None if OTHER.search(text) or self.special.search(text) else PIECES.findall(text)
            at.append(None if pieces is None else np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces)))
        if self.memo.new:
            self._learn()
        for text, where in zip(texts, at):
            if where is None:
                yield np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            sizes = self.size[where]
            ends = np.cumsum(sizes)
            yield self.ids[np.repeat(self.start[where] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_some([text]))

    def documents(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text with the end id."""
        for ids in self.encode_some(texts):
            yield np.append(ids, np.uint32(END_ID))


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    return worker_tool(path, lambda: Encoder(path))
