"""A word-level BPE vocabulary file: normalisation, pre-splitting and byte symbols, as its own library defines them."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import regex

# The pre-split pattern, the normaliser's white space and the end-of-word mark of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
END = "</w>"

_pieces, _found = regex.compile(SPLIT).findall, regex.compile(SPLIT).finditer
_space = re.compile(f"[{SPACE}]+")
#: The lowest code point without a character; only from there on can Unicode versions differ.
_FIRST_OPEN = "\u0378"
#: str.split() also splits at these, the vocabulary's white space does not.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else the next letter from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def chunks(text: str) -> list[str]:
    """The runs between white space. No pre-split piece crosses white space, and normalising keeps it white space."""
    if any(c in text for c in _SEPARATORS):
        return [x for x in _space.split(text) if x]
    return text.split()


class Vocabulary:
    """Symbols, merges in rank order and special strings of a vocabulary file (the JSON text of it)."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with the word end </w> is expected")
        self.ids: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.inner = [self.ids[x] for x in letters]
        self.final = [self.ids[x + END] for x in letters]
        #: (left id, right id, merged id) in rank order.
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((self.ids[left], self.ids[right], self.ids[left + right]))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None

    def pieces(self, chunk: str) -> Iterator[str | int]:
        """Pre-split pieces of a chunk, normalised; special strings come as their ids."""
        parts = self._special.split(chunk) if self._special and "<|" in chunk else [chunk]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part]
            elif part:
                if part.isascii():
                    low = part.lower()
                    if low.isalpha():
                        yield low
                    else:
                        yield from _pieces(low)
                    continue
                # The normaliser lowers letter by letter: no final sigma.
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                if max(low) < _FIRST_OPEN:
                    yield from _pieces(low)
                    continue
                masked = "".join(["\u25a1" if unicodedata.category(c) == "Cn" else c for c in low])
                # Letters of a newer Unicode than the vocabulary's library knows count as signs.
                yield from _pieces(low) if masked == low else [low[m.start() : m.end()] for m in _found(masked)]

    def symbols(self, piece: str) -> list[int]:
        """The byte symbols of a piece, the last one with the word end."""
        raw = piece.encode("utf-8", "surrogatepass")
        out = [self.inner[b] for b in raw]
        out[-1] = self.final[raw[-1]]
        return out
