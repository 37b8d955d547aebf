"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from meltemi.llm.frames import map_columns
from meltemi.llm.vocab import Vocabulary, chunks

#: Counted chunks that a worker remembers; beyond that it starts anew.
REMEMBERED = 600_000


class MergeCounter:
    """Counts tokens: initial symbols minus merges. No token ids are made."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.rank = {(a << 20) | b: r for r, (a, b, _) in enumerate(vocabulary.merges)}
        self.merged = [m for _, _, m in vocabulary.merges]
        self.words: dict[str, int] = {}
        self.seen: dict[str, int] = {}

    def merges(self, symbols: list[int]) -> int:
        """Number of merges of one word: the lowest-rank adjacent pair goes first, the leftmost of equals."""
        n, rank, merged = len(symbols), self.rank.get, self.merged
        heap, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            r = rank(left << 20 | right)
            if r is not None:
                # Rank and position in one number: the order of the pairs is the order of the numbers.
                heap.append(r << 40 | i - 1)
            left = right
        heapq.heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        done, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFFFF, entry >> 40
            j = after[i]
            # Stale where one of its symbols has been merged since.
            if j >= n or symbols[i] < 0 or rank(symbols[i] << 20 | symbols[j]) != r:
                continue
            new = symbols[i] = merged[r]
            symbols[j] = -1
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(new << 20 | symbols[k])
                if r is not None:
                    push(heap, r << 40 | i)
            p = before[i]
            if p >= 0:
                r = rank(symbols[p] << 20 | new)
                if r is not None:
                    push(heap, r << 40 | p)
        return done

    def word(self, piece: str) -> int:
        n = self.words.get(piece)
        if n is None:
            symbols = self.vocabulary.symbols(piece)
            n = len(symbols)
            n -= self.merges(symbols)
            if len(piece) < 64:
                if len(self.words) >= REMEMBERED:
                    self.words.clear()
                self.words[piece] = n
        return n

    def chunk(self, chunk: str) -> int:
        n = sum(1 if isinstance(p, int) else self.word(p) for p in self.vocabulary.pieces(chunk))
        if len(chunk) < 64:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[chunk] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        total, known, fresh = 0, self.seen.get, self.chunk
        for c in chunks(text):
            n = known(c)
            total += fresh(c) if n is None else n
        return total


@lru_cache(maxsize=2)
def counter(source: str) -> MergeCounter:
    """One counter a worker process and vocabulary: what it has counted serves later tasks too."""
    return MergeCounter(Vocabulary(source))


def count_tokens(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ``n_bytes``, ``n_tokens``): UTF-8 bytes and tokens of every whole text.

    ``vocabulary`` is the vocabulary file's JSON text. A null or empty text has 0 bytes and 0 tokens; a text of white space
    has 0 tokens. A special string inside a text is one token. Repeated rows and null keys are counted each on their own; an empty
    table gives an empty result, and other columns of ``docs`` play no part. No shuffle: a map over
    partitions, with one text's work bounded by that text.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(keys: pa.Array, texts: pa.Array) -> list:
        one = counter(shared.value)
        return [keys, pc.fill_null(pc.binary_length(texts), 0), [one.text(t) for t in texts.to_pylist()]]

    return map_columns(docs.select(key, text), f"`{key}` {kind}, n_bytes long, n_tokens long", work, text=text)
