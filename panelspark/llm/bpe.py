"""Exact byte-pair encoding by dynamic programming over prefixes.

A byte string has exactly one encoding, and so has each of its prefixes; that of a prefix is that of a shorter
prefix followed by one token. Hence one number per prefix suffices, the last token of its encoding: among the
vocabulary's tokens that end at a position (all found in one pass of a suffix-matching automaton), it is the only
one that is compatible with the last token of the prefix before it. Two tokens are compatible if encoding their
concatenation gives back the two, which the merge table decides by undoing merges along the seam. Following the
stored tokens backwards emits the ids. The time is linear in the text for any input, runs without a break included.
"""

from __future__ import annotations

import json
import sys
from itertools import chain

import ahocorasick
import numpy as np
import regex

#: splits a text before the merges; fixed value of the public tokenizer
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: pieces remembered per worker before the memory is emptied; bounds the memory, never the result
REMEMBER = 200_000


def _byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable bytes are themselves, the rest follow 255 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return letters


class Encoder:
    """A byte-level vocabulary with its merges, in the form of a ``tokenizers`` JSON file."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        letters = _byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {to_bytes(s): i for s, i in model["vocab"].items() if all(c in letters for c in s)}
        self.vocab = vocab
        self.bytes = {i: b for b, i in vocab.items()}
        #: bytes of each token by its id
        self.sizes = np.zeros(max(self.bytes, default=-1) + 1, "int64")
        self.sizes[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: (left, right) -> (rank, merged); and the merge that makes a token, the earliest if there are several
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            left, right = vocab[to_bytes(a)], vocab[to_bytes(b)]
            whole = vocab[to_bytes(a) + to_bytes(b)]
            self.merge[left, right] = (rank, whole)
            self.made.setdefault(whole, (rank, left, right))
        self._compatible: dict[tuple[int, int], bool] = {}
        self._stable: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        pattern = regex.compile(PATTERN)
        self.split = pattern.findall
        self.matches = pattern.finditer
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()

    def _seam_holds(self, left: int, right: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` ever joins bytes across the seam of two tokens.

        Merges are undone from the last one backwards, on whichever side has it, so that at each step the two
        tokens at the seam are those that stood there together; a merge of the two in that span of time, one
        whose rank is below both the limit and the next merge that replaces one of them, would have been taken.
        """
        top = limit
        while True:
            joined = self.merge.get((left, right))
            if joined is not None and joined[0] < top:
                return False
            made_l, made_r = self.made.get(left), self.made.get(right)
            if made_l is None and made_r is None:
                return True
            # the later of the two merges; of one rank the left one is made first, so the right one is undone first
            if made_r is None or (made_l is not None and made_l[0] > made_r[0]):
                # before the left token was complete, its right part stood at the seam
                top, left = made_l[0], made_l[2]
            else:
                # the merge on the right is taken unless one across the seam of its rank or less stood further left
                top, right = made_r[0] + 1, made_r[1]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        got = self._compatible.get(key)
        if got is None:
            if len(self._compatible) > 4 * REMEMBER:
                self._compatible.clear()
            got = self._compatible[key] = self._seam_holds(left, right, float("inf"))
        return got

    def stable(self, token: int) -> bool:
        """Whether a token's bytes encode to itself; others can't occur."""
        got = self._stable.get(token)
        if got is None:
            made = self.made.get(token)
            got = self._stable[token] = len(self.bytes[token]) == 1 or (
                made is not None and self.stable(made[1]) and self.stable(made[2]) and self._seam_holds(made[1], made[2], made[0])
            )
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, by the last token of every prefix."""
        n = len(piece)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            before = last[start]
            if (start == 0 or (before >= 0 and self.compatible(before, token))) and self.stable(token):
                last[end], back[end] = token, start
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        ids.reverse()
        return ids

    def _learn(self, piece: str) -> tuple[int, ...]:
        ids = self._known.get(piece)
        if ids is None:
            ids = tuple(self.encode_piece(piece.encode("utf-8", "replace")))
            if len(piece) <= 64:  # longer ones hardly come again
                if len(self._known) >= REMEMBER:
                    self._known.clear()
                self._known[piece] = ids
        return ids

    def count_part(self, part: str) -> int:
        return len(self._learn(part))

    def pieces(self, text: str) -> tuple[list[str], list[tuple[int, ...]]]:
        """The text's pieces and the ids of each, in order; joined, the pieces are the text."""
        parts = self.split(text)
        known = self._known
        ids = [known.get(p) for p in parts]
        if None in ids:
            ids = [self._learn(p) if i is None else i for p, i in zip(parts, ids, strict=True)]
        return parts, ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; of a null or empty text an empty list."""
        return list(chain.from_iterable(self.pieces(text)[1])) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, self.pieces(text)[1])) if text else 0


def encoder(raw: bytes) -> Encoder:
    """The worker process's encoder for a vocabulary; built once, and kept in a place that all jobs share."""
    held = sys.__dict__.setdefault("_panelspark_encoders", {})
    key = (len(raw), hash(raw))
    if key not in held:
        held[key] = Encoder(raw)
    return held[key]

