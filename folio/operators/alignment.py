"""Local alignment of texts, statistics of matches, and tagging of document lines by aligned target values."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.operators.joins import dealt

# Scores of the alignment, and below how many characters only whole words match.
MATCH, MISMATCH, GAP, EXACT_BELOW = 2, -1, -2, 5
#: Scores that are held at once, and pairs of texts that are filled together.
CELLS, TOGETHER = 1 << 24, 32
#: Cells from which a band is tried first, the length of its seeds, its margin, and the most that it may hold.
BAND_FROM, SEED, MARGIN, BAND_CELLS = 1 << 21, 16, 64, 1 << 28

Blocks = list[tuple[int, int, int]]
Junk = Callable[[str, int], bool]


def is_junk(s: str, i: int) -> bool:
    """A space or comma after a dot, a dot after a letter, a repeat of the character before, or a star."""
    before = s[i - 1] if i else ""
    return bool(before) and (s[i] in " ," and before == "." or s[i] == "." and before.isalpha() or s[i] == before) or s[i] == "*"


def local_blocks(a: str, b: str) -> Blocks:
    """Matching blocks (place in a, place in b, length) of the best local alignment; ties go diagonally, then up, then left.

    Rows are filled with numpy: a row's gaps to the left are a running maximum, so there is no loop over cells.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return []
    if (n + 1) * (m + 1) > BAND_FROM:
        return many_blocks([(a, b)])[0]
    y, x = _codes(b), _codes(a)
    score = np.zeros((n + 1, m + 1), np.int32)
    step = np.arange(m, dtype=np.int32) * -GAP
    for i in range(n):
        best = np.maximum(score[i, :-1] + np.where(y == x[i], MATCH, MISMATCH), score[i, 1:] + GAP)
        np.maximum(best, 0, out=best)
        # left gaps: best[j] = max over k <= j of best[k] + GAP * (j - k)
        score[i + 1, 1:] = np.maximum.accumulate(best + step) - step
    i, j = (int(k) for k in np.unravel_index(int(score.argmax()), score.shape))
    pairs = []
    while i and j and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
            if x[i] == y[j]:
                pairs.append((i, j))
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return _joined(pairs)


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le"), "<u4")


def _joined(pairs: list[tuple[int, int]]) -> Blocks:
    """Pairs of places, last first, as blocks."""
    blocks: Blocks = []
    for i, j in reversed(pairs):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def _seeds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How much further on in y each run of SEED characters stands that is in x once and in y once."""
    if min(len(x), len(y)) < SEED:
        return np.zeros(0, np.int64)

    def once(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, key = len(z) - SEED + 1, np.zeros(len(z) - SEED + 1, np.uint64)
        for k in range(SEED):
            key = key * np.uint64(0x9E3779B97F4A7C15) + z[k : k + n].astype(np.uint64) + np.uint64(1)
        found, at, count = np.unique(key, return_index=True, return_counts=True)
        return found[count == 1], at[count == 1]

    (kx, ix), (ky, iy) = once(x), once(y)
    _, in_x, in_y = np.intersect1d(kx, ky, assume_unique=True, return_indices=True)
    return iy[in_y] - ix[in_x]


def banded_blocks(a: str, b: str) -> Blocks | None:
    """``local_blocks`` from a band of diagonals around the seeds, or None if nothing proves that the band holds all of it.

    An alignment that touches diagonal k (place in b less place in a) matches at most min(len(a), len(b) - k) characters,
    or min(len(b), len(a) + k) below. If the band's best score is above what any diagonal outside allows, every best
    alignment lies inside, and so does the way back. If it isn't, the score says how wide the band must be; it is
    filled once more, unless that is half of all cells or more.
    """
    x, y = _codes(a), _codes(b)
    n, m = len(x), len(y)
    shifts = _seeds(x, y)
    if not len(shifts):
        return None
    low, high = int(shifts.min()) - MARGIN, int(shifts.max()) + MARGIN
    for _ in range(2):
        low, high = max(low, -n), min(high, m)
        cells = (high - low + 1) * n
        if cells > BAND_CELLS or 2 * cells > n * m:
            return None
        best, pairs = _in_band(x, y, low, high)
        # The nearest diagonals outside allow the most.
        need_high, need_low = m - best // 2, -(n - best // 2)
        if (high >= need_high or high >= m) and (low <= need_low or low <= -n):
            return _joined(pairs)
        low, high = min(low, need_low), max(high, need_high)
    return None


def _in_band(x: np.ndarray, y: np.ndarray, low: int, high: int) -> tuple[int, list[tuple[int, int]]]:
    """The best score of paths on diagonals ``low`` to ``high``, and its matching places, last first; ties as in ``local_blocks``."""
    n, m, width = len(x), len(y), high - low + 1
    pad = n + width + abs(low) + 2
    wide = np.full(m + 2 * pad, -1, np.int64)
    wide[pad : pad + m] = y
    before, step = np.zeros(width + 1, np.int64), np.arange(width) * -GAP
    ways = np.zeros((n, width), np.uint8)  # 1: diagonal, 2: up, 3: left
    top = (0, 0, 0)
    for i in range(n):
        first = i + low  # the place in y of the band's first cell
        same = wide[pad + first : pad + first + width] == x[i]
        across = before[:-1] + np.where(same, MATCH, MISMATCH)
        up = before[1:] + GAP
        now = np.maximum(np.maximum(across, up), 0)
        from_, to = max(0, -first), min(width, m - first)
        if from_ >= to:
            if first >= m:
                break
            before[:] = 0
            continue
        now[:from_] = 0
        now = np.maximum.accumulate(now + step) - step
        now[:from_], now[to:] = 0, 0
        ways[i] = np.where(now <= 0, 0, np.where(now == across, 1, np.where(now == up, 2, 3)))
        ways[i, :from_] = ways[i, to:] = 0
        k = int(now.argmax())
        if now[k] > top[0]:
            top = (int(now[k]), i, k)
        before[:-1] = now
    best, i, k = top
    pairs = []
    while best and i >= 0 and 0 <= k < width and (way := ways[i, k]):
        if way == 1:
            j = i + low + k
            if x[i] == y[j]:
                pairs.append((i, j))
            i -= 1
        elif way == 2:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return best, pairs


def many_blocks(texts: list[tuple[str, str]], cells: int = CELLS) -> list[Blocks]:
    """``local_blocks`` of many pairs of whole texts; pairs of similar lengths are filled together."""
    out: list[Blocks] = [[] for _ in texts]
    open_ = [k for k, (a, b) in enumerate(texts) if a and b]
    for k in [k for k in open_ if len(texts[k][0]) * len(texts[k][1]) > BAND_FROM]:
        if (found := banded_blocks(*texts[k])) is not None:
            out[k] = found
            open_.remove(k)
    todo = sorted(open_, key=lambda k: (len(texts[k][0]) // 64, len(texts[k][1])))
    while todo:
        n = m = k = 0
        while k < min(len(todo), TOGETHER):
            a, b = texts[todo[k]]
            n, m = max(n, len(a)), max(m, len(b))
            if k and (k + 1) * (n + 1) * (n + m + 1) > cells:
                break
            k += 1
        for at, blocks in zip(todo[:k], _filled([texts[at] for at in todo[:k]], cells), strict=True):
            out[at] = blocks
        todo = todo[k:]
    return out


def _filled(texts: list[tuple[str, str]], cells: int) -> list[Blocks]:
    """Scores by diagonals d = i + j, so that a diagonal of all pairs is a few numpy calls.

    Diagonals that don't fit in ``cells`` are filled in stripes: the two before each stripe are kept, and the way back
    fills the stripes it meets anew. Padding matches nothing, so scores in it stay under the best one.
    """
    size, n, m = len(texts), max(len(a) for a, _ in texts), max(len(b) for _, b in texts)
    codes = [(_codes(a), _codes(b)) for a, b in texts]
    wide = max(int(c.max()) for pair in codes for c in pair) >= 8000 or min(n, m) >= 16000
    kind, pad = (np.int32, 0x110000) if wide else (np.int16, 8000)
    x, y = np.full((n, size), pad, kind), np.full((m, size), pad + 1, kind)
    for p, (a, b) in enumerate(codes):
        x[: len(a), p], y[m - len(b) :, p] = a, b[::-1]  # y is backwards: a diagonal is a slice of each
    x *= 4  # codes that differ do so by 4 or more in x ^ y
    y *= 4
    end, width = n + m + 1, (n + 1) * size
    rows = min(end - 2, max(cells // width - 2, int(end**0.5) + 1))
    h = np.zeros((rows + 2, n + 1, size), kind)
    top, one, two = np.zeros((n + 1, size), kind), np.empty((n, size), kind), np.empty((n, size), kind)

    def fill(first: int) -> None:
        top[:] = 0
        for d in range(first, min(first + rows, end)):
            now, last, before = h[d - first + 2], h[d - first + 1], h[d - first]
            low, high = max(1, d - m), min(n, d - 1) + 1
            if d <= n:
                now[d] = 0
            t, g, to = one[: high - low], two[: high - low], now[low:high]
            np.bitwise_xor(x[low - 1 : high - 1], y[m - d + low : m - d + high], out=t)
            np.minimum(t, MATCH - MISMATCH, out=t)
            np.subtract(before[low - 1 : high - 1], t, out=t)
            np.add(t, MATCH, out=t)
            np.maximum(last[low - 1 : high - 1], last[low:high], out=g)
            np.add(g, GAP, out=g)
            np.maximum(t, g, out=t)
            np.maximum(t, 0, out=to)
            np.maximum(top[low:high], to, out=top[low:high])

    kept, best = [], [(0, 0, 0)] * size
    for k, first in enumerate(range(2, end, rows)):
        if k:
            h[:2] = h[-2:]
        if rows < end - 2:
            kept.append(h[:2].copy())
        fill(first)
        for p, (i, score) in enumerate(zip(top.argmax(0).tolist(), top.max(0).tolist(), strict=True)):
            if score > best[p][0] or score == best[p][0] and i < best[p][1]:
                best[p] = (score, i, k)

    flat = h.reshape(-1).data
    places: list[tuple[int, int] | None] = [None] * size  # (i, d)
    pairs: list[list[tuple[int, int]]] = [[] for _ in texts]
    filled = k
    for k in range(filled, -1, -1):
        first = 2 + k * rows
        here = [p for p in range(size) if (best[p][2] == k and best[p][0]) or (places[p] and places[p][1] >= first)]
        if not here:
            continue
        if k != filled:
            h[:2] = kept[k]
            fill(first)
            filled = k
        for p in here:
            if places[p] is None:
                score, i, _ = best[p]
                low = max(first, i + 1)
                high = min(first + rows, i + len(texts[p][1]) + 1)
                places[p] = (i, low + int((h[low - first + 2 : high - first + 2, i, p] == score).argmax()))
            i, d = places[p]
            a, b = texts[p]
            at = ((d - first + 2) * (n + 1) + i) * size + p
            while i and d > i and d >= first and (score := flat[at]) > 0:
                same = a[i - 1] == b[d - i - 1]
                if score == flat[at - 2 * width - size] + (MATCH if same else MISMATCH):
                    i, d, at = i - 1, d - 2, at - 2 * width - size
                    if same:
                        pairs[p].append((i, d - i))
                elif score == flat[at - width - size] + GAP:
                    i, d, at = i - 1, d - 1, at - width - size
                else:
                    d, at = d - 1, at - width
            places[p] = (i, d) if i and d > i and d < first else (0, 0)
    return [_joined(x) for x in pairs]


def word_blocks(a: str, b: str) -> Blocks:
    """The first place where the shorter text stands as whole words in the other."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return []
    edge = lambda c: r"\b" if c.isalnum() else ""
    m = re.search(edge(short[0]) + re.escape(short) + edge(short[-1]), long_)
    if not m:
        return []
    return [(0, m.start(), len(short))] if short is a else [(m.start(), 0, len(short))]


@dataclass
class Match:
    """An alignment's blocks and what they say."""

    a: str
    b: str
    blocks: Blocks
    junk: Junk = is_junk

    def count(self) -> int:
        return sum(n for *_, n in self.blocks)

    def _span(self, k: int) -> tuple[int, int]:
        if not self.blocks:
            return 0, 0
        return self.blocks[0][k], self.blocks[-1][k] + self.blocks[-1][2]

    a_span = property(lambda self: self._span(0))
    b_span = property(lambda self: self._span(1))

    def _junk(self, s: str, k: int, low: int, high: int) -> int:
        """Junk characters in [low, high) that no block covers."""
        ends = [low, *(x for block in self.blocks for x in (block[k], block[k] + block[2])), high]
        return sum(1 for a, b in zip(ends[::2], ends[1::2], strict=True) for i in range(max(a, low), min(b, high)) if self.junk(s, i))

    @staticmethod
    def over(count: int, total: int) -> float:
        return count / total if total else 0.0

    def ratio(self) -> float:
        spans = [(self.a, 0, *self.a_span), (self.b, 1, *self.b_span)]
        s, k, low, high = max(spans, key=lambda x: x[3] - x[2])
        return self.over(self.count(), high - low - self._junk(s, k, low, high))

    def a_ratio(self) -> float:
        return self.over(self.count(), len(self.a) - self._junk(self.a, 0, 0, len(self.a)))

    def b_ratio(self) -> float:
        return self.over(self.count(), len(self.b) - self._junk(self.b, 1, 0, len(self.b)))

    def b_gap_ratio(self) -> float:
        """How much of b is matched, gaps in a counted against it."""
        low, high = self.a_span
        total = len(self.b) + (high - low) - self.count() - self._junk(self.a, 0, low, high) - self._junk(self.b, 1, 0, len(self.b))
        return self.over(self.count(), total)

    def summary(self) -> str:
        return f"matches={self.count()} ratio={self.ratio():.4f} a={self.a_ratio():.4f} b={self.b_ratio():.4f} b_gap={self.b_gap_ratio():.4f}"

    def detail(self) -> str:
        """What matches, in brackets, between what stands on either side only."""
        out, i, j = [], self.a_span[0], self.b_span[0]
        for a, b, n in self.blocks:
            if a > i or b > j:
                out.append(f"{{{self.a[i:a]}|{self.b[j:b]}}}")
            out.append(f"[{self.a[a : a + n]}]")
            i, j = a + n, b + n
        return "".join(out)

    def split_a(self, at: int) -> tuple[Match, Match]:
        """The parts before and from ``at`` of a; blocks across it are cut."""
        left = [(i, j, min(n, at - i)) for i, j, n in self.blocks if i < at]
        right = [(max(i, at) - at, j + max(0, at - i), n - max(0, at - i)) for i, j, n in self.blocks if i + n > at]
        return Match(self.a[:at], self.b, left), Match(self.a[at:], self.b, right)

    def split_b(self, at: int) -> tuple[Match, Match]:
        flip = lambda m: Match(m.b, m.a, [(j, i, n) for i, j, n in m.blocks])
        left, right = flip(self).split_a(at)
        return flip(left), flip(right)


#: The columns of a comparison, as debug tables have them.
DEBUG = (
    "id int, tag string, match_multiple boolean, tag_value_pre string, tag_value_current string, start_index int, next_start_index int, reached_end boolean, "
    "choice_combined string, choice_current string, choice_next string, accepted boolean, tag_to_choice_match boolean, sub_annotation boolean, "
    "fm_combined string, fm_combined_detailed string, fm_current string, fm_current_detailed string, fm_next string, fm_next_detailed string"
)


def fuzzy_match(a: str, b: str) -> Match:
    short = min(len(a), len(b)) < EXACT_BELOW
    return Match(a, b, word_blocks(a, b) if short else local_blocks(a, b))


def fuzzy_matches(texts: list[tuple[str, str]]) -> list[Match]:
    """``fuzzy_match`` of each pair."""
    short = [min(len(a), len(b)) < EXACT_BELOW for a, b in texts]
    long_ = iter(many_blocks([t for t, s in zip(texts, short, strict=True) if not s]))
    return [Match(*t, word_blocks(*t) if s else next(long_)) for t, s in zip(texts, short, strict=True)]


@dataclass(frozen=True)
class Accept:
    """When a match is one: high ratio over enough characters, or a high share of b with the support of others."""

    threshold: float = 0.9
    least: int = 5
    total: float = 0.9
    ratio_least: int = 50
    ratio_threshold: float = 0.9

    def __call__(self, m: Match, previous: bool = False, following: Match | None = None) -> bool:
        n = m.count()
        if n >= self.ratio_least and m.ratio() >= self.ratio_threshold:
            return True
        if m.b_gap_ratio() < self.threshold:
            return False
        return previous or n >= self.least and (following is None or following.ratio() >= self.threshold) or m.a_ratio() >= self.total


SEQUENCE, CHOICE = Accept(), Accept(least=1, ratio_least=100)
STATS = "match_count int, ratio double, a_ratio double, b_ratio double, b_gap_ratio double, blocks array<struct<a: int, b: int, size: int>>"


def match_stats(a: Column, b: Column) -> Column:
    """The alignment of two text columns with its statistics, in Arrow batches."""

    @F.arrow_udf(T._parse_datatype_string(STATS))
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        texts = list(zip(x.to_pylist(), y.to_pylist(), strict=True))
        missing = [x is None or y is None for x, y in texts]
        found = fuzzy_matches([("", "") if none else t for t, none in zip(texts, missing, strict=True)])
        blocks = [m.blocks for m in found]
        parts = [pa.array([block[k] for part in blocks for block in part], pa.int32()) for k in range(3)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, blocks)]), pa.int32()), pa.StructArray.from_arrays(parts, ["a", "b", "size"]))
        cols = [pa.array([m.count() for m in found], pa.int32()), *(pa.array([f(m) for m in found], pa.float64()) for f in (Match.ratio, Match.a_ratio, Match.b_ratio, Match.b_gap_ratio)), lists]
        return pa.StructArray.from_arrays(cols, ["match_count", "ratio", "a_ratio", "b_ratio", "b_gap_ratio", "blocks"], mask=pa.array(missing, pa.bool_()))

    return run(a, b)


_MAP = str.maketrans("—– '", '-- "')


def plain(s: str) -> str:
    return s.replace("&apos;", "'").lower().translate(_MAP)


def bare(s: str) -> str:
    s = plain(s)
    return "".join(c for i, c in enumerate(s) if not is_junk(s, i))


@dataclass
class Line:
    """A line's untagged tokens: (row, text, start, end), its joined text and its place among lines."""

    position: int
    tokens: list[tuple[int, int, int]] = field(default_factory=list)
    text: str = ""

    def add(self, row: int, text: str) -> None:
        if self.text or self.tokens:
            self.text += " "
        self.tokens.append((row, len(self.text), len(self.text) + len(text)))
        self.text += text

    def between(self, low: int, high: int) -> list[int]:
        return [row for row, start, end in self.tokens if end > low and start < high]


class Matcher:
    """Tags one document's tokens by its targets; state goes from target to target, so a document is one group."""

    def __init__(self, lines: list[list[tuple[int, str]]], max_gap: int = 5, sequence: Accept = SEQUENCE, choice: Accept = CHOICE) -> None:
        self.lines, self.max_gap, self.sequence, self.choice = lines, max_gap, sequence, choice
        self.tags: dict[int, str] = {}
        self.sub_tags: dict[int, str] = {}
        self.bonded: dict[str, set[int]] = {}
        self.target: dict = {}
        #: Where each comparison is told about, as values of DEBUG.
        self.report: list[tuple] | None = None

    def _tell(self, value: str, at: int, after: int, end: bool | None, texts: tuple[str, str, str | None], accepted: bool, short: bool, sub: bool, parts: tuple[Match, Match, Match | None]) -> None:
        if self.report is None:
            return
        both, here, there = parts
        self.report.append((
            len(self.report) + 1, self.target["name"], bool(self.target.get("match_multiple")), value[:at], value[at:], at, after, end, *texts,
            accepted, short, sub, *(t for m in (both, here, there) for t in ((m.summary(), m.detail()) if m is not None else (None, None))),
        ))

    def runs(self, normal: Callable[[str], str] = bare) -> list[Line]:
        """Contiguous untagged tokens of each line."""
        out = []
        for position, line in enumerate(self.lines):
            now = None
            for row, text in line:
                if row in self.tags or not (t := normal(text)):
                    now = now if row not in self.tags else None
                    continue
                if now is None:
                    out.append(now := Line(position))
                now.add(row, t)
        return out

    def find(self, value: str, lines: list[Line], start: int, seen: set[int], sub: bool = False) -> tuple[list[tuple[Line, int, int]], int]:
        """Parts of ``value`` in lines from ``start`` on, and where to go on; ``seen`` are lines matched before."""
        found: list[tuple[Line, int, int]] = []
        at, near = 0, set(seen)
        for k in range(start, len(lines)):
            line, after = lines[k], lines[k + 1] if k + 1 < len(lines) else None
            if near and not any(abs(p - line.position) <= self.max_gap + 1 for p in near):
                continue
            rest = value[at:]
            if not sub and len(rest) >= len(line.text):
                both = line.text + " " + after.text if after else line.text
                m = fuzzy_match(value, both)
                here, there = m.split_b(len(line.text) + 1) if after else (m, None)
                accepted = bool(here.blocks) and self.sequence(here, bool(found), there if there and there.blocks else None)
                before, end = at, None
                if accepted:
                    found.append((line, *here.b_span))
                    near.add(line.position)
                    at = max(at, here.a_span[1])
                    while at < len(value) and value[at].isspace():
                        at += 1
                    end = at >= len(value)
                self._tell(value, before, at, end, (both, line.text, after.text if after else None), accepted, False, sub, (m, here, there))
                if end:
                    return found, k + 1
            else:
                both = line.text + (" " + after.text if after and not sub else "")
                m = fuzzy_match(both, rest)
                accepted = bool(m.blocks) and self.choice(m)
                if self.report is not None:
                    here, there = m.split_a(len(line.text) + 1) if len(both) > len(line.text) else (m, None)
                    self._tell(value, at, at, None, (both, line.text, after.text if after else None), accepted, True, sub, (m, here, there))
                if accepted:
                    low, high = m.a_span
                    if low < len(line.text):
                        found.append((line, low, min(high, len(line.text))))
                    if after and high > len(line.text) + 1:
                        found.append((after, max(0, low - len(line.text) - 1), high - len(line.text) - 1))
                    return found, k + 1
        return found, len(lines)

    def apply(self, target: dict, found: list[tuple[Line, int, int]]) -> list[int]:
        rows = []
        for line, low, high in sorted(found, key=lambda f: (f[0].position, f[1], f[2])):
            rows += [r for r in line.between(low, high) if r not in self.tags and r not in rows]
        for n, r in enumerate(rows):
            self.tags[r] = ("b-" if n == 0 else "i-") + target["name"]
        return rows

    def sub_apply(self, target: dict, rows: list[int]) -> None:
        text = {row: t for line in self.lines for row, t in line}
        for s in target.get("sub") or ():
            for value in s["value"]:
                line = Line(0)
                for r in rows:
                    if r not in self.sub_tags:
                        line.add(r, plain(text[r]))
                found, _ = self.find(plain(value), [line], 0, set(), sub=True)
                hit = [r for part in found for r in part[0].between(*part[1:])]
                for n, r in enumerate(dict.fromkeys(hit)):
                    self.sub_tags[r] = ("b-" if n == 0 else "i-") + s["name"]

    def run(self, targets: list[dict]) -> None:
        pending: tuple[dict, list] | None = None
        for target in targets:
            self.target = target
            start = 0
            bonded = self.bonded.setdefault(target["name"], set()) if target["bonding"] else None
            while True:
                lines = self.runs()
                found, next_start, kept = [], start, set(bonded or ())
                for value in target["value"]:
                    part, end = self.find(bare(value), [x for x in lines], start, kept)
                    if part:
                        found += part
                        kept |= {line.position for line, *_ in part}
                        next_start = max(next_start, end)
                if target["is_list"] and found and target["bonding"] and len(found) <= 1 and target["name"] != "author":
                    found = []
                if not found:
                    pending = None
                    break
                if pending and min(abs(f[0].position - p[0].position) for f in found for p in pending[1]) <= 1:
                    self.sub_apply(pending[0], self.apply(*pending))
                pending = None
                if target["require_next"]:
                    pending = (target, found)
                    break
                last = max(line.position for line, *_ in found)
                self.sub_apply(target, self.apply(target, found))
                if bonded is not None:
                    bonded |= {line.position for line, *_ in found}
                if not target["match_multiple"]:
                    break
                # Go on after the last match; places are found anew, since tagged tokens leave their lines.
                after = self.runs()
                start = next((k for k, x in enumerate(after) if x.position > last), len(after))


_TOKEN = ["page_idx", "line_idx", "token_idx"]


def annotate(tokens: DataFrame, targets: DataFrame, max_gap: int = 5) -> DataFrame:
    """doc_id, page_idx, line_idx, token_idx, tag, sub_tag of the tokens that targets tag; tags that are there stay.

    Tokens (with ``tag``) and targets of one document meet in one group: its state runs from target to target. Pages
    and targets of a document bound a group; documents are independent.
    """

    def rows(left: pd.DataFrame, matcher: Matcher) -> pd.DataFrame:
        hit = sorted(matcher.tags)
        got = left.loc[hit, ["doc_id", *_TOKEN]].copy()
        got["tag"] = [matcher.tags[r] for r in hit]
        got["sub_tag"] = [matcher.sub_tags.get(r) for r in hit]
        return got

    out = "doc_id string, page_idx int, line_idx int, token_idx int, tag string, sub_tag string"
    return _by_document(tokens, targets, max_gap, rows, out)


def match_debug(tokens: DataFrame, targets: DataFrame, max_gap: int = 5) -> DataFrame:
    """doc_id and DEBUG: a row a comparison of ``annotate``, numbered from 1 in each document.

    Summaries count what matches and give its shares; details show what matches in brackets.
    """
    names = ["doc_id", *(c.split()[0] for c in DEBUG.split(", "))]

    def rows(left: pd.DataFrame, matcher: Matcher) -> pd.DataFrame:
        doc = left.doc_id.iloc[0] if len(left) else None
        return pd.DataFrame([(doc, *r) for r in matcher.report], columns=names)

    return _by_document(tokens, targets, max_gap, rows, f"doc_id string, {DEBUG}", report=True)


def _by_document(tokens: DataFrame, targets: DataFrame, max_gap: int, rows: Callable[[pd.DataFrame, Matcher], pd.DataFrame], out: str, report: bool = False) -> DataFrame:
    keys = _TOKEN

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(keys).reset_index(drop=True)
        lines: list[list[tuple[int, str]]] = []
        last = None
        for row, (page, line, text, tag) in enumerate(zip(left.page_idx, left.line_idx, left.text, left.tag, strict=True)):
            if (page, line) != last:
                lines.append([])
                last = (page, line)
            if not tag:
                lines[-1].append((row, text or ""))
        matcher = Matcher([x for x in lines if x], max_gap)
        matcher.report = [] if report else None
        wanted = right.sort_values("target_ord").to_dict("records")
        subs = lambda t: [{"name": s["name"], "value": list(s["value"])} for s in (t["sub"] if t["sub"] is not None else ())]
        matcher.run([t | {"value": list(t["value"]), "sub": subs(t)} for t in wanted])
        return rows(left, matcher)

    a = tokens.select(F.col("doc_id").cast("string").alias("doc_id"), *keys, "text", F.coalesce("tag", F.lit("")).alias("tag"))
    b = targets.where("name IS NOT NULL").select("doc_id", "target_ord", "name", "value", "is_list", "match_multiple", "bonding", "require_next", "sub")
    a, b = dealt(a, "doc_id"), dealt(b, "doc_id")  # matching is much work for few bytes
    return a.groupBy("doc_id").cogroup(b.groupBy("doc_id")).applyInPandas(run, out)


def labels_match(expected: str, actual: str, yes: str = "x", no: str = "_") -> str:
    """Labels of ``actual``'s characters: from the first to the last that ``expected`` matches, letter case aside."""
    m = fuzzy_match(actual.lower(), expected.lower()) if expected else None
    if m is None or not m.blocks:
        return no * len(actual)
    low, high = m.a_span
    return no * low + yes * (high - low) + no * (len(actual) - high)


def chain(*annotators: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Annotators one after the other."""

    def run(tokens: DataFrame) -> DataFrame:
        for a in annotators:
            tokens = tokens.transform(a)
        return tokens

    return run
