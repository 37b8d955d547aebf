"""BPE encoding with a deterministic tokenization automaton, and decoding by its arc labels."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meltemi.llm.frames import map_columns
from meltemi.llm.vocab import Vocabulary, chunks

#: Encoded chunks that a worker remembers; beyond that it starts anew.
REMEMBERED = 300_000
#: Letters by which the lengths of labels are looked up, and the lengths below that, which are tried everywhere.
FIRST = 4
SHORT = (3, 2, 1)


class TokenAutomaton:
    """The automaton over token ids whose paths are exactly the tokenizations that merging gives.

    It starts as one state with an arc back to itself for every byte symbol. The gadget of merge (u, v) sends the u-arcs to a copy of their target
    without its v-arc, and gives their sources an arc uv to where v led. All arcs of one label end in one state, throughout,
    so a state is named by the label of the arcs that enter it (START: none yet). The tables keep what each gadget did: the arc that a state lost
    and when, and of a merged label its merge and parts. Before that merge, a state uv was the state v, and an arc uv stands where the arc u did.
    """

    START = -1

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        size = max(vocabulary.ids.values()) + 1
        #: Of a label: the merge that made it (-1: a byte symbol), its left and right part.
        self.made, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        #: (state, label) -> the merge whose gadget took that arc away.
        self.lost: dict[int, int] = {}
        live = {*vocabulary.inner, *vocabulary.final}
        for k, (u, v, uv) in enumerate(vocabulary.merges):
            # Where no path has u before v, the merge never happens.
            if u in live and v in live and uv not in live and self.has_arc(u, v):
                self.lost[u << 20 | v] = k
                self.made[uv], self.left[uv], self.right[uv] = k, u, v
                live.add(uv)
        #: Labels by their letters, for reading a word's bytes.
        letters: dict[int, bytes] = {}
        for b in range(256):
            letters[vocabulary.inner[b]] = letters[vocabulary.final[b]] = bytes([b])
        for u, v, uv in vocabulary.merges:
            letters[uv] = letters[u] + letters[v]
        ends = set(vocabulary.final)
        for u, v, uv in vocabulary.merges:
            if v in ends:
                ends.add(uv)
        self.inside = {letters[t]: t for t in live - ends}
        self.closing = {letters[t]: t for t in live & ends}
        #: The first letters of a place -> how long the labels are that may stand there, the longest first.
        self.lengths = self._lengths({*self.inside, *self.closing})
        #: (state, label) -> whether that arc is there, of the pairs that a word has asked for: the table of transitions as far as it is used.
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, tuple[bytes, str]] = {}
        self.seen: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def _lengths(labels: set[bytes]) -> dict[bytes, tuple[int, ...]]:
        found: dict[bytes, set[int]] = {}
        for x in labels:
            if len(x) >= FIRST:
                found.setdefault(x[:FIRST], set()).add(len(x))
        return {x: (*sorted(of, reverse=True), *SHORT) for x, of in found.items()}

    def has_arc(self, state: int, label: int) -> bool:
        """Follows the gadgets back, the latest first, until one has taken the arc away or only byte symbols are left."""
        if state < 0:
            return True
        made, lost, before = self.made, self.lost.get, len(self.vocabulary.merges)
        while True:
            k = lost(state << 20 | label)
            if k is not None and k < before:
                return False
            by, of = made[state], made[label]
            if by > of:
                before, state = by, self.right[state]
            elif of < 0:
                return True
            else:
                before, label = of + 1, self.left[label]

    def _arc(self, state: int, label: int) -> bool:
        if len(self.arcs) >= REMEMBERED:
            self.arcs.clear()
        there = self.arcs[state << 20 | label] = self.has_arc(state, label)
        return there

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one pre-split word. A prefix has one path at most, so a place that led nowhere is never tried again."""
        n, place, state = len(raw), 0, self.START
        path: list[tuple[int, int]] = []  # (place, label) of the arcs taken
        most, dead = n, set()
        inside, closing, lengths, arcs, arc = self.inside.get, self.closing.get, self.lengths.get, self.arcs.get, self._arc
        while place < n:
            for length in lengths(raw[place : place + FIRST], SHORT):
                end = place + length
                if length <= most and end not in dead:
                    label = closing(raw[place:end]) if end == n else inside(raw[place:end])
                    if label is not None:
                        there = state < 0 or arcs(state << 20 | label)
                        if arc(state, label) if there is None else there:
                            path.append((place, label))
                            place, state = end, label
                            most = n - place
                            break
            else:
                dead.add(place)
                last = place
                place, label = path.pop()
                most = last - place - 1
                state = path[-1][1] if path else self.START
        return [label for _, label in path]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space apart: the vocabulary file names no decoder that would join them."""
        name = self.vocabulary.names.get
        return " ".join([x for x in map(name, ids) if x is not None])

    def ids(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        return np.frombuffer(self.both(text)[0], "<u4").tolist()

    def _word(self, piece: str) -> tuple[bytes, str]:
        ids = self.encode(piece.encode("utf-8", "surrogatepass"))
        out = pack(f"<{len(ids)}I", *ids), self.decode(ids)
        if len(piece) < 64:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            self.words[piece] = out
        return out

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        known, fresh = self.words.get, self._word
        # A chunk of letters is a piece, as pieces() would give it.
        if chunk.isascii() and chunk.isalpha():
            low = chunk.lower()
            out = known(low) or fresh(low)
        else:
            parts = [(pack("<I", p), self.decode([p])) if isinstance(p, int) else known(p) or fresh(p) for p in self.vocabulary.pieces(chunk)]
            out = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        if len(chunk) < 64:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[chunk] = out
        return out

    def both(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of a whole text."""
        known, fresh = self.seen.get, self._chunk
        parts = [known(c) or fresh(c) for c in chunks(text or "")]
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])


@lru_cache(maxsize=2)
def automaton(source: str) -> TokenAutomaton:
    """One automaton a worker process and vocabulary."""
    return TokenAutomaton(Vocabulary(source))


def encode(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ``ids`` array<int>, ``decoded``) of every whole text.

    ``vocabulary`` is the vocabulary file's JSON text. Null and empty texts, and texts of white space, give no ids and an empty
    decoded text. Special strings inside a text become their ids. Repeated rows come out each; an empty table gives an empty
    result; other columns play no part. A map without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(keys: pa.Array, texts: pa.Array) -> list:
        one = automaton(shared.value)
        got = [one.both(t) for t in texts.to_pylist()]
        return [keys, [np.frombuffer(g[0], "<u4").astype("i4") for g in got], [g[1] for g in got]]

    return map_columns(docs.select(key, text), f"`{key}` {kind}, ids array<int>, decoded string", work, text=text, max_bytes=1 << 20)


def decode(encoded: DataFrame, vocabulary: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, ``decoded``) from rows (key, ids). Null and empty id lists give an empty text; ids that the vocabulary lacks give nothing."""
    kind = encoded.schema[key].dataType.simpleString()
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def work(keys: pa.Array, lists: pa.Array) -> list:
        one = automaton(shared.value)
        return [keys, [one.decode([i for i in x or [] if i is not None]) for x in lists.to_pylist()]]

    return map_columns(encoded.select(key, ids), f"`{key}` {kind}, decoded string", work)


def digests(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``): what :func:`encode` gives, as digests made where the ids are."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(keys: pa.Array, texts: pa.Array) -> list:
        one = automaton(shared.value)
        n, a, b = [], [], []
        for t in texts.to_pylist():
            ids, decoded = one.both(t)
            n.append(len(ids) // 4)
            a.append(hashlib.sha256(ids).hexdigest())
            b.append(hashlib.sha256(decoded.encode()).hexdigest())
        return [keys, n, a, b]

    return map_columns(docs.select(key, text), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work, text=text)
