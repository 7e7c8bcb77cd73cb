"""Token ids of whole texts, by the tokenizers library with a cache of words."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word of Latin-1 letters. With a mark after it the tokenizer makes the word one piece and the mark another, so the mark is
#: cut off before words are told apart.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,])( |$)"
#: Words that a worker remembers at most; then it starts anew.
CACHE_WORDS = 200_000
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 4 << 20


class WordEncoder:
    """Encodes texts word by word with a public tokenizer whose pieces never span a white space.

    Equal words have equal ids, so each distinct word of a chunk goes through the tokenizer once, and the ids of the
    texts are put together from those. The result equals ``Tokenizer.encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.n_ids = max(vocab.values()) + 1
        ends = np.zeros(self.n_ids, dtype=bool)
        ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.ends = ends
        self.cache: dict[str, bytes] = {}

    @property
    def dtype(self) -> np.dtype:
        """The narrowest unsigned integer that holds every id."""
        return np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")

    def _learn(self, words: list[str], plain: np.ndarray) -> None:
        """Remember the ids of new words; ``plain`` tells which are letters alone."""
        cache = self.cache
        names = [w for w, p in zip(words, plain.tolist(), strict=True) if p]
        odd = [w for w, p in zip(words, plain.tolist(), strict=True) if not p]
        if names:
            # One text of plain words: each ends with the only token that closes a word.
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(names)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(names):
                data, size = ids.tobytes(), self.dtype.itemsize
                ends = (cuts * size).tolist()
                cache.update(zip(names, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:
                odd += names
        if odd:
            for w, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, dtype=self.dtype).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and each text's first position among them (one more at the end). Null: empty."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, MARKED, r"\1 \2\3"), " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = np.array([w not in cache for w in words], dtype=bool)
        if new.any():
            plain = pc.match_substring_regex(coded.dictionary, PLAIN).to_numpy(zero_copy_only=False)
            self._learn([w for w, n in zip(words, new.tolist(), strict=True) if n], plain[new])
        each = [cache[w] for w in words]
        sizes = np.array([len(x) for x in each], dtype=np.int64) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(each), dtype=self.dtype)
        first = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.arange(total) + np.repeat(first[at] - (ends - n), n)]
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        return ids, bounds


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file; it outlives a task, the words it remembers don't."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    _encoders[path].cache = {}
    return _encoders[path]


def forget(path: str) -> None:
    """At a task's end: leave the memory to what the worker does next."""
    _encoders[path].cache = {}


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Arrow batches regrouped so that a chunk's texts have about ``limit`` bytes (one text at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        start = 0
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(batch) else np.zeros(0, np.int64)
        done = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(sizes, done + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(sizes[stop - 1]) - done
            done, start = int(sizes[stop - 1]), stop
            if size >= limit or start < len(batch):
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
