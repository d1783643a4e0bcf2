"""Whole-text encoding with a public tokenizer, through a bounded cache of word encodings."""

from __future__ import annotations

from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowcairn.llm.shared import worker_state

CACHE_WORDS = 700_000
TOGETHER = 200
# ASCII marks that end a word: they never fall into one token with the letters before them.
MARKS = ".,;:!?*$%&#"
# Letters whose lower case is one letter; words with others are looked at one by one.
LETTERS = "^[a-zA-ZÀ-ÖØ-öø-ÿ]+$"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes(strings: pa.Array) -> list[bytes]:
    return strings.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer lower-cases, drops white space and never joins characters across it, so the ids of a
    text are those of its words one after another. Words are cut at ASCII white space; each distinct
    word goes through the library once while it stays in the cache, whose size is bounded.

    The cache numbers words in the order they are met; the ids of all of them lie in one array. Words met
    first are the most frequent ones, so the first half stays when the cache is full.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cache_words = Tokenizer.from_file(path), cache_words
        self.cache: dict[bytes, int] = {}
        self.pool, self.upto = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New words with the ids of all of them in a row."""
        first = len(self.cache)
        self.cache.update(zip(words, range(first, first + len(words))))
        self.pool = np.concatenate([self.pool, ids])
        self.upto = np.concatenate([self.upto, self.upto[-1] + np.cumsum(sizes)])

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words with these numbers in a row, and how many lie before each of them."""
        starts = self.upto[numbers]
        sizes = self.upto[numbers + 1] - starts
        upto = np.concatenate([[0], np.cumsum(sizes)])
        return self.pool[np.arange(upto[-1]) + np.repeat(starts - upto[:-1], sizes)], upto

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; −1 for unknown ones."""
        return np.fromiter(map(self.cache.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def _unknown(self, words: list[bytes]) -> list[bytes]:
        return [w for w in dict.fromkeys(words) if w not in self.cache]

    def _learn_each(self, words: list[bytes]) -> None:
        ids = self._library([w.decode("utf-8") for w in words])
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self._add(words, np.fromiter(chain.from_iterable(ids), dtype="<u4", count=sizes.sum()), sizes)

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words of letters go to the library many at a time: each ends with one end-of-word token."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        known, ids, sizes, rest = [], [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)], []
        for group, found in zip(groups, self._library([b" ".join(g).decode("utf-8") for g in groups])):
            flat = np.array(found, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[flat]) + 1
            if len(ends) != len(group):  # a letter that lower-cases to more than letters
                rest += group
                continue
            known += group
            ids.append(flat)
            sizes.append(np.diff(ends, prepend=0))
        self._add(known, np.concatenate(ids), np.concatenate(sizes))
        self._learn_each(rest)

    def _learn(self, missing: pa.Array) -> None:
        """Words of letters with marks behind them are their letters' ids and their marks' ids."""
        core = pc.ascii_rtrim(missing, characters=MARKS)
        split = pc.match_substring_regex(core, LETTERS).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~split).tolist():
            word = core[i].as_py()
            # A letter that lower-cases to a letter and a mark would join the marks that follow it.
            split[i] = word.isalpha() and (word.isascii() or word.lower().isalpha())
        words, cores = _bytes(missing), _bytes(core)
        marked = split & (pc.binary_length(core).to_numpy() < pc.binary_length(missing).to_numpy())
        both = np.flatnonzero(marked).tolist()
        tails = [words[i][len(cores[i]) :] for i in both]
        self._learn_letters(self._unknown([cores[i] for i in np.flatnonzero(split).tolist()]))
        self._learn_each(self._unknown([*[words[i] for i in np.flatnonzero(~split).tolist()], *tails]))
        pairs = np.column_stack([self._numbers([cores[i] for i in both]), self._numbers(tails)])
        ids, upto = self._ids(pairs.ravel())
        self._add([words[i] for i in both], ids, np.diff(upto[::2]))

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        if not texts:
            return []
        plain = pa.array(texts, pa.large_string()).fill_null("")
        lowered = pc.ascii_lower(plain)
        special = pc.match_substring(plain, "<|")
        if pc.any(special).as_py():  # special tokens are matched before lower-casing
            lowered = pc.if_else(special, plain, lowered)
        split = pc.ascii_split_whitespace(lowered)
        coded = split.flatten().dictionary_encode()
        if len(self.cache) > self.cache_words:
            self.cache = dict(islice(self.cache.items(), self.cache_words // 2))
            self.upto = self.upto[: len(self.cache) + 1]
            self.pool = self.pool[: self.upto[-1]].copy()
        words = _bytes(coded.dictionary)
        numbers = self._numbers(words)
        missing = np.flatnonzero(numbers < 0)
        for at in range(0, len(missing), 50_000):
            some = missing[at : at + 50_000]
            self._learn(coded.dictionary.take(pa.array(some)))
            numbers[some] = self._numbers([words[i] for i in some.tolist()])
        # Ids of the slice's distinct words are copied to the places where the words stand.
        flat, upto = self._ids(numbers[coded.indices.to_numpy(zero_copy_only=False)])
        ids, cuts = flat.tobytes(), (4 * upto[split.offsets.to_numpy()]).tolist()
        return [ids[a:b] + end for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file, loaded once per worker."""
    state = worker_state("encoders")
    if path not in state:
        state[path] = TextEncoder(path)
    return state[path]


def text_slices(texts: list, most_chars: int = 4_000_000):
    """Index ranges of consecutive texts with a bounded number of characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > most_chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
