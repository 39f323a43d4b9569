"""Byte-level BPE: a backtracking encoder with exact merges in linear time, and decoding by an offset table.

Encoding a piece walks it from left to right. An Aho-Corasick automaton over the vocabulary gives, in one pass, the
longest token at each position. A token is taken if the pair with the token before it is compatible, that is, if the
merge rules would never have joined across or within their boundary first; else a shorter token is tried, and where
none fits the walk steps back and marks the position as a dead end, so that each position is left once at most.
"""

from __future__ import annotations

import json

import numpy as np
import regex

#: How a byte is written in the vocabulary file. Printable bytes stand for themselves, others follow at 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_symbols() -> list[str]:
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in _PRINTABLE:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


class Bpe:
    """A vocabulary file of the byte-level kind: tokens, merges in order of rank, and added tokens."""

    #: Pieces whose tokens are remembered; when full, the memory starts anew.
    REMEMBER = 300_000

    def __init__(self, path: str, pattern: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.pieces = regex.compile(pattern)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.symbols = byte_symbols()
        self.symbol_byte = {s: b for b, s in enumerate(self.symbols)}
        # Merge order: bytes come before all merges. ``order`` maps ids to it and ``id_of`` back.
        order: dict[int, int] = {}
        for s in self.symbols:
            order[vocab[s]] = len(order)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(order))]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            new = order.setdefault(vocab[a + b], len(order))
            if new == len(self.halves):
                self.halves.append((order[vocab[a]], order[vocab[b]]))
                self.joined[order[vocab[a]], order[vocab[b]]] = new
        self.id_of = [0] * len(order)
        for i, k in order.items():
            self.id_of[k] = i
        text_of = {i: t for t, i in vocab.items()}
        self.length = [len(text_of[i]) for i in self.id_of]
        self._shorter: dict[int, int] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._stands: dict[int, bool] = {}
        # A token that the merges never build from its own bytes is in no encoding.
        self.by_text = {text_of[i]: k for k, i in enumerate(self.id_of) if self.stands(k)}
        self.search = ahocorasick.Automaton()
        for t, k in self.by_text.items():
            self.search.add_word(t, k)
        self.search.make_automaton()
        size = max([*vocab.values(), *self.added.values()]) + 1
        blobs = [b""] * size
        for t, i in vocab.items():
            blobs[i] = bytes(self.symbol_byte[c] for c in t)
        for t, i in self.added.items():
            blobs[i] = t.encode()
        self.bytes_table = Table(blobs)
        self.digits_table = Table([f"{i},".encode() for i in range(size)])
        self.known: dict[str, bytes] = {}

    def shorter(self, k: int, text: str) -> int:
        """The longest token that is a proper prefix of token k, or -1."""
        found = self._shorter.get(k)
        if found is None:
            found = -1
            for n in range(self.length[k] - 1, 0, -1):
                if (p := self.by_text.get(text[:n])) is not None:
                    found = p
                    break
            self._shorter[k] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Can b stand right after a in an encoding? Table of pairs, filled on demand.

        Undo merges from the latest on, on either side of the boundary. If two tokens that meet at it could join by a
        merge that comes before the next one undone, the rules would have joined them, so the pair never stands.
        """
        found = self._fits.get((a, b))
        if found is None:
            found = self._fits[a, b] = self._check(a, b)
        return found

    def _check(self, a: int, b: int) -> bool:
        undone = len(self.halves)  # merges from this rank on are undone
        while True:
            join = self.joined.get((a, b))
            if join is not None and join < undone:
                return False
            # The side made by the later merge is undone first; on a tie the right side, since the left one joins first.
            if a > b:
                undone, a = a, self.halves[a][1]
                if a == undone:
                    undone = b + 1
                    if self.halves[b][0] == b:
                        return True
                    b = self.halves[b][0]
            else:
                undone = b + 1
                if self.halves[b][0] != b:
                    b = self.halves[b][0]
                else:
                    if self.halves[a][1] == a:
                        return True
                    undone, a = a, self.halves[a][1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece that the pattern cut out."""
        text = "".join([self.symbols[b] for b in piece.encode()])
        whole = self.by_text.get(text)
        if whole is not None:
            return [self.id_of[whole]]
        n = len(text)
        longest = [-1] * (n + 1)
        length = self.length
        for end, k in self.search.iter(text):
            at = end + 1 - length[k]
            if longest[at] < 0 or length[k] > length[longest[at]]:
                longest[at] = k
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, k = 0, longest[0]
        while pos < n:
            to = pos + length[k]
            if not dead[to] and (not out or self.fits(out[-1], k)):
                out.append(k)
                pos, k = to, longest[to] if to < n else -1
                continue
            k = self.shorter(k, text[pos:to])
            while k < 0:  # nothing fits here: step back over the last token and shorten it
                dead[pos] = 1
                k = out.pop()
                pos -= length[k]
                k = self.shorter(k, text[pos : pos + length[k]])
        return [self.id_of[k] for k in out]

    def stands(self, k: int) -> bool:
        """Do the merges build token k from its bytes? Its halves must stand, and fit beside each other until they join."""
        found = self._stands.get(k)
        if found is None:
            a, b = self.halves[k]
            found = a == k
            if not found and self.stands(a) and self.stands(b):
                own = self.joined.pop((a, b))
                found = self._check(a, b)
                self.joined[a, b] = own
            self._stands[k] = found
        return found

    def piece_ids(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit integers; those of short pieces are remembered."""
        found = self.known.get(piece)
        if found is None:
            if len(self.known) >= self.REMEMBER:
                self.known.clear()
            found = np.array(self.encode_piece(piece), "<u4").tobytes()
            if len(piece) < 64:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text (uint32). Added tokens in the text stand for themselves, as the library has it."""
        if self.added_split is None or "<|" not in text and not self.added_split.search(text):
            return np.frombuffer(b"".join(self._pieces(text)), "<u4")
        out = []
        for k, part in enumerate(self.added_split.split(text)):
            out += [np.array([self.added[part]], "<u4").tobytes()] if k % 2 else self._pieces(part)
        return np.frombuffer(b"".join(out), "<u4")

    def _pieces(self, text: str) -> list[bytes]:
        pieces, known = self.pieces.findall(text), self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            piece_ids = self.piece_ids
            return [piece_ids(p) for p in pieces]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.bytes_table.join(ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.digits_table.join(ids)[:-1]


class Table:
    """Byte strings end to end and where each starts; a list of their numbers is joined by one gather."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(blobs), np.uint8)
        self.offset = np.zeros(len(blobs) + 1, np.int64)
        np.cumsum([len(b) for b in blobs], out=self.offset[1:])

    def join(self, ids: np.ndarray, at_once: int = 1 << 18) -> bytes:
        out = []
        for k in range(0, len(ids), at_once):
            part = ids[k : k + at_once]
            start = self.offset[part]
            n = self.offset[part + 1] - start
            stop = np.cumsum(n)
            out.append(self.data[np.repeat(start - stop + n, n) + np.arange(stop[-1])].tobytes())
        return b"".join(out)
