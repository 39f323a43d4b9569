"""Texts to token ids through a memory of chunks.

Pieces of the byte-level pattern never hold a space or a line feed that stands between two other characters that are not
white space, save as their first character or, for a line feed, alone. So a text may be cut before each of these, and a
chunk has the same ids wherever it stands; so has a word before its full stop or comma. New chunks of many texts are
encoded as one text, and the ids are dealt back by the bytes they stand for. A text with a chunk that begins or ends in
other white space, or that holds an added token, is encoded whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Texts that go through the memory together: few, so that what one step leaves is still near when the next one reads it.
AT_ONCE = 32


class ChunkMemory:
    """``encode``: texts to ids; ``id_bytes``: how many bytes each id stands for. Ids come out as little-endian 32-bit integers."""

    #: Chunks that are remembered. Beyond that the older half goes, but for those met again since.
    REMEMBER = 700_000
    #: A chunk is remembered from its second meeting on: most new ones never come back.
    DOOR = 1 << 22

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], id_bytes: np.ndarray, added: Sequence[str] = (), remember: int = REMEMBER) -> None:
        self.encode, self.id_bytes, self.added, self.remember = encode, id_bytes, tuple(added), remember
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.door = bytearray(self.DOOR)
        self.marks: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of chunks that are not known, from one encoding of all of them."""
        parts = [c if c[0] == "\n" else " " + c for c in chunks]
        ids = np.asarray(self.encode(["".join(parts)])[0], "<u4")
        ends = np.cumsum([len(p.encode()) for p in parts])
        stops = ((np.searchsorted(np.cumsum(self.id_bytes[ids]), ends) + 1) * 4).tolist()
        raw = ids.tobytes()
        return dict(zip(chunks, map(raw.__getitem__, map(slice, [0, *stops], stops)), strict=True))

    def _remember(self, fresh: dict[str, bytes]) -> None:
        door, mask = self.door, self.DOOR - 1
        for c, ids in fresh.items():
            at = hash(c) & mask
            if door[at]:
                self.known[c] = ids
            else:
                door[at] = 1
        if len(self.known) > self.remember // 2:
            self.older, self.known = self.known, {}
            self.door = bytearray(self.DOOR)

    def _found(self, new: set[str]) -> dict[str, bytes]:
        """Ids of chunks that are not in the newer memory; chunks with white space at their ends have none."""
        out, older = {}, self.older
        bare: dict[str, str] = {}
        todo = set()
        for c in new:
            if c in older:
                out[c] = self.known[c] = older[c]
                continue
            at = c[:1] == "\n"
            if len(c) == at or c[at].isspace() or (last := c[-1]).isspace():
                continue
            if last in ".," and c[-2:-1].isalpha():
                bare[c] = word = c[:-1]
                ids = self.known.get(word) or older.get(word)
                if ids is not None:
                    out[word] = ids
                else:
                    todo.add(word)
            else:
                todo.add(c)
        todo -= out.keys()
        fresh = self._learn(list(todo)) if todo else {}
        self._remember(fresh)
        out |= fresh
        if bare:
            if not self.marks:
                self.marks = {m: np.asarray(ids, "<u4").tobytes() for m, ids in zip(".,", self.encode([".", ","]), strict=True)}
            ended = {c: out[w] + self.marks[c[-1]] for c, w in bare.items()}
            self._remember(ended)
            out |= ended
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        known = self.known.get
        whole = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [t.replace("\n", " \n").split(" ") if k not in whole else [t] for k, t in enumerate(texts)]
        firsts = self.encode([chunks[0] for chunks in cut])
        found, holes, new = [], [], set()
        for chunks in cut:
            got = list(map(known, chunks))
            got[0] = b""
            at, gaps = 0, []
            try:
                while True:
                    at = got.index(None, at + 1)
                    gaps.append(at)
                    new.add(chunks[at])
            except ValueError:
                pass
            found.append(got)
            holes.append(gaps)
        fresh = self._found(new) if new else {}
        out = []
        for text, chunks, got, gaps, first in zip(texts, cut, found, holes, firsts, strict=True):
            for at in gaps:
                got[at] = fresh.get(chunks[at])
            head = chunks[0]
            if None in map(got.__getitem__, gaps) or head[-1:].isspace() or len(chunks) > 1 and not head:
                out.append(np.asarray(self.encode([text])[0], "<u4").tobytes())
                continue
            got[0] = np.asarray(first, "<u4").tobytes()
            out.append(b"".join(got))
        return out
