"""Byte-level BPE over a whole corpus: speculate and verify (problem 8).

For each new word, greedy longest match proposes tokens. A proposal is the true encoding exactly
if each adjacent pair of its tokens could stand side by side, so all pairs of a batch are tested at
once by undoing merges on arrays; only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.shipping import ship

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published word pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_CHARS = 300_000, 30_000_000


class SpeculativeBpe:
    """Encoder of one vocabulary, given as the bytes of a rank file (base64 token and rank a line)."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        import regex

        self.findall = regex.compile(pattern).findall
        self.rank = {base64.b64decode(t): int(r) for t, r in map(bytes.split, rank_file.splitlines())}
        self.longest = max(map(len, self.rank))
        self._tables()
        self.words: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def _tables(self) -> None:
        """For each token the two tokens its last merge joined (itself for single bytes), and the reverse."""
        top = max(self.rank.values()) + 1
        self.left, self.right = np.arange(top), np.arange(top)
        codes = []
        for token, r in self.rank.items():
            if len(token) > 1:
                a, b = self.merge(token, below=r)
                self.left[r], self.right[r] = a, b
                codes.append(((a << 32) | b, r))
        codes.sort()
        self.pair_code = np.array([c for c, _ in codes], np.int64)
        self.pair_rank = np.array([r for _, r in codes], np.int64)

    def merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: join the lowest-ranked neighbours, leftmost first, until none is left."""
        n = len(word)
        start, end = list(range(n)), list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0:
                r = self.rank.get(word[start[i] : end[j]])
                if r is not None and (below is None or r < below):
                    heapq.heappush(heap, (r, start[i], end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heapq.heappop(heap)  # a piece is known by its start
            j = after[i] if alive[i] else -1
            if j < 0 or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.rank[word[start[i] : end[i]]] for i in range(n) if alive[i]]

    def greedy(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        out, i, n = [], 0, len(word)
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                r = self.rank.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging first+second would end in exactly these two tokens, for arrays of pairs.

        Walks both tokens' merges backwards, latest first, along the boundary: a merge across it
        that would have come earlier than the merge undone last makes the pair impossible.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        ok = np.ones(len(a), bool)
        todo = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(todo):
            x, y, lim = a[todo], b[todo], limit[todo]
            code = (x << 32) | y
            at = np.minimum(np.searchsorted(self.pair_code, code), len(self.pair_code) - 1)
            clash = (self.pair_code[at] == code) & (self.pair_rank[at] < lim)
            ok[todo[clash]] = False
            x_leaf, y_leaf = self.left[x] == x, self.left[y] == y
            # Undo the later merge; at equal ranks the left token's merge came first, so the right one's is undone.
            undo_x = ~x_leaf & (y_leaf | (x > y))
            undo_y = ~y_leaf & ~undo_x
            limit[todo] = np.where(undo_x, x, np.where(undo_y, y + 1, lim))
            a[todo] = np.where(undo_x, self.right[x], x)
            b[todo] = np.where(undo_y, self.left[y], y)
            todo = todo[~clash & ~(x_leaf & y_leaf)]
        return ok

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words into the cache."""
        raw = [w.encode("utf-8") for w in words]
        proposed = [self.greedy(w) for w in raw]
        firsts, seconds, owner = [], [], []
        for k, p in enumerate(proposed):
            if len(p) > 1:
                firsts += p[:-1]
                seconds += p[1:]
                owner += [k] * (len(p) - 1)
        if owner:
            ok = self.compatible(np.array(firsts), np.array(seconds))
            for k in np.unique(np.array(owner)[~ok]):
                proposed[k] = self.merge(raw[k])
        for w, p in zip(words, proposed):
            self.words[w] = tuple(p)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; none for empty and null texts."""
        if len(self.words) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.words.clear()
            self.chars = 0
        split = [self.findall(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)) - self.words.keys()
        if new:
            self.learn(list(new))
            self.chars += sum(map(len, new))
        get = self.words.__getitem__
        return [list(chain.from_iterable(map(get, ws))) for ws in split]


_encoders: dict[int, SpeculativeBpe] = {}


def _encoder(rank_file: bytes) -> SpeculativeBpe:
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = SpeculativeBpe(rank_file)
    return _encoders[key]


def _mapped(documents: DataFrame, keep: list[str], text: str, vocabulary: str, counts: bool, step: int = 256) -> DataFrame:
    spark = documents.sparkSession
    ship(spark)
    with open(vocabulary, "rb") as f:
        shipped = spark.sparkContext.broadcast(f.read())  # about 1 MB, fixed by the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids = encoder.encode_batch(part.column(len(keep)).to_pylist())
                if counts:
                    made = pa.array([len(x) for x in ids], pa.int64())
                else:
                    offsets = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) for x in ids], out=offsets[1:])
                    made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], made], names=[*keep, "n_tokens" if counts else "ids"])

    columns = documents.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return columns.mapInArrow(encode, f"{kinds}, {'n_tokens bigint' if counts else 'ids array<int>'}")


def token_ids(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and ids array<int> of every row; null and empty texts give an empty array."""
    return _mapped(documents, keep, text, vocabulary, counts=False)


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` and n_tokens of every row; null and empty texts count 0."""
    return _mapped(documents, keep, text, vocabulary, counts=True)
