"""Quality rules by tokeniser fertility.

A document first meets base rules over its words; what passes is measured with a public vocabulary with
byte fallback: characters per token, share of byte-fallback tokens, and entropy of its tokens in bits.
A document is kept if all three lie within the bands of its language, or where that has none, of its
script, which is the script most of its letters belong to. A language's bands hold only for its script. Short
texts have little room for entropy, so the entropy band is a share of the most that so many tokens could have.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; ``lang`` may be missing,
null, unknown or of another script, and then the script's bands hold; repeated rows are judged alike; other
columns are carried along by ``judge``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import added, grouped, worker_tool
from .tokens import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEAT = 5, 10, 20
GROUP_CHARS = 200_000


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least share of possible entropy."""

    low: float
    high: float
    bytes_share: float
    entropy: float


#: Documented parameters: bands per language, named script/language, and per script. Those of languages come from
#: clean labelled rows of sf0.1 that pass the base rules: least characters per token and least entropy are their 0.5
#: percentiles, the byte share is their 99.9 percentile. Of characters per token the upper end is the script's:
#: low quality lies below clean text, never above, and prose of known words has 4 to 5 characters a token, where
#: the tables' invented words have 2 to 3. Bands of scripts have no labelled rows and are wide.
BANDS = {
    "latin/en": Band(2.36, 6.0, 0.050, 0.735),
    "latin/de": Band(2.39, 6.0, 0.043, 0.724),
    "latin/fr": Band(2.02, 6.0, 0.062, 0.716),
    "latin/es": Band(2.02, 6.0, 0.039, 0.718),
    "latin": Band(1.5, 6.0, 0.10, 0.68),
    "cyrillic": Band(1.0, 6.0, 0.10, 0.45),
    "greek": Band(0.8, 5.0, 0.30, 0.40),
    "arabic": Band(0.7, 5.0, 0.30, 0.40),
    "hebrew": Band(0.7, 5.0, 0.30, 0.40),
    "devanagari": Band(0.6, 5.0, 0.50, 0.40),
    "cjk": Band(0.3, 3.0, 0.75, 0.35),
    "other": Band(0.2, 6.0, 0.90, 0.35),
}
#: Code point ranges of scripts.
SCRIPTS = {
    "cyrillic": "[Ѐ-ԯ]",
    "greek": "[Ͱ-Ͽἀ-῿]",
    "arabic": "[؀-ۿݐ-ݿ]",
    "hebrew": "[֐-׿]",
    "devanagari": "[ऀ-ॿ]",
    "cjk": "[぀-ヿ㐀-䶿一-鿿가-힯]",
}
FOREIGN = {name: re.compile(pattern) for name, pattern in SCRIPTS.items()}
PAST_LATIN = re.compile("[Ͱ-\U0010ffff]")
LETTER = re.compile(r"[^\W\d_]")


def script_of(text: str) -> str:
    """The script with most letters; latin on a tie with any other and where there are no letters."""
    if not PAST_LATIN.search(text):
        return "latin"
    counts = {name: len(pattern.findall(text)) for name, pattern in FOREIGN.items()}
    best = max(counts, key=counts.__getitem__)
    past = [c for c in PAST_LATIN.findall(text) if LETTER.match(c)]
    latin = len(LETTER.findall(text)) - len(past)
    other = len(past) - sum(counts.values())
    if latin >= max(counts[best], other):
        return "latin"
    return best if counts[best] >= other else "other"


def _codes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each distinct pair; numbers below the longest text's length, so a pair fits 64 bits."""
    return np.unique(left * np.int64(1 << 31) + right, return_inverse=True)[1]


def repeated_words(words: list[str]) -> int:
    """Words inside five-word windows that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    pairs = _codes(ids[:-1], ids[1:])
    fours = _codes(pairs[:-2], pairs[2:])
    codes = _codes(fours[:-1], ids[4:])
    repeated = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(repeated), 1)
    np.add.at(covered, np.flatnonzero(repeated) + WINDOW, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    repeat = repeated_words(words)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, n < LEAST_WORDS or 100 * repeat > MOST_REPEAT * n


class Fertility:
    """Measures of one text by a vocabulary with byte fallback."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])

    def measure(self, texts: list[str]) -> Iterator[tuple[float, float, float]]:
        """Characters per token, byte-fallback share, entropy as a share of the most possible."""
        for text, found in zip(texts, self.model.encode(texts, num_threads=1)):
            ids = np.asarray(found, dtype=np.int64)
            if len(ids) == 0:
                yield 0.0, 0.0, 0.0
                continue
            counts = np.bincount(ids)
            counts = counts[counts > 0]
            entropy = math.log2(len(ids)) - float((counts * np.log2(counts)).sum()) / len(ids)
            most = math.log2(min(len(ids), 400)) if len(ids) > 1 else 1.0
            yield len(text) / len(ids), float(self.byte[ids].mean()), entropy / most


def within(text: str, chars: float, share: float, entropy: float, bands: dict[str, Band], lang: str | None = None) -> bool:
    script = script_of(text)
    band = bands.get(f"{script}/{re.split('[-_]', (lang or '').strip().lower())[0]}") or bands[script]
    return band.low <= chars <= band.high and share <= band.bytes_share and entropy >= band.entropy


def _model(path: str) -> Fertility:
    """One model a worker process."""
    return worker_tool(path, lambda: Fertility(path))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, entropy_share double"


def judge(docs: DataFrame, vocabulary: str | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """``docs`` with MEASURES; columns of those names are replaced."""
    vocabulary, bands = vocabulary or tokenizer_path("piece_bpe_32k.model"), bands or BANDS
    spoken = dict(docs.dtypes).get("lang") == "string"

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        model = _model(vocabulary)

        def measure(batch: pa.RecordBatch) -> list[pa.Array]:
            langs = batch.column("lang").to_pylist() if spoken else [None] * len(batch)
            rows, at = [], 0
            for texts in grouped(batch, "text", GROUP_CHARS):
                for text, m in zip(texts, model.measure(texts)):
                    found = base(text)
                    rows.append((*found, not found[-1] and within(text, *m, bands, langs[at]), *m))
                    at += 1
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3
            return [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]

        return measure

    return added(docs, MEASURES, start)


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text", *[c for c in docs.columns if c == "lang"])).drop("text", "lang")
