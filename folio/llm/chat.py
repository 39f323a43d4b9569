"""Transcripts to canonical turns: a hidden Markov model over lines recovers who speaks.

A line is seen as its speaker marker, if it begins with one, its length and its ending. Hidden states are the roles,
each as the first line of a turn or a later one. Transitions and the emissions of lengths and endings are counted over
all turns with known roles; markers are believed with fixed odds, since a transcript may miss one or quote one. The
Viterbi path, found for many transcripts at a time, is cut into turns, and turns are rendered in one form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Words that mark a speaker at the start of a line, by role.
MARKERS = {
    "system": ("system", "instructions", "instruction", "context"),
    "user": ("user", "human", "customer", "question", "q", "you", "inst"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "a", "response", "model"),
}
_ROLE_OF = {w: k for k, r in enumerate(ROLES) for w in MARKERS[r]}
_WORDS = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?({_WORDS})(?:\|>)?|\[({_WORDS})\]:?|#+\s*({_WORDS})\s*:?(?=\s|$)|\**({_WORDS})\**\s*:\**)\s*", re.IGNORECASE)

#: Lines, padding included, whose paths are found together; a longer transcript is alone.
TOGETHER = 1 << 16
#: Odds of markers: the right one, none, another's on a turn's first line; any one on a later line.
RIGHT, NONE, LATER = 0.78, 0.2, 0.002
#: Lengths of lines are seen in these classes, endings as question, stop, other.
LENGTHS = (0, 20, 60, 140, 300)


def marker_of(line: str) -> tuple[int, int]:
    """The role that a line's marker names (or -1), and where the line goes on after it."""
    found = _MARKER.match(line)
    if not found:
        return -1, 0
    return _ROLE_OF[next(g for g in found.groups() if g).lower()], found.end()


def marked_lines(text: str) -> list[tuple[int, str]]:
    """(marker, rest) of each line; a marker alone on its line belongs to the next one, if that has none itself."""
    out: list[tuple[int, str]] = []
    alone = -1
    for line in text.split("\n"):
        role, at = marker_of(line)
        if alone >= 0:
            if role < 0:
                out.append((alone, line))
                alone = -1
                continue
            out.append((alone, ""))
            alone = -1
        if role >= 0 and at == len(line):
            alone = role
        else:
            out.append((role, line[at:]))
    return [*out, (alone, "")] if alone >= 0 else out


def _seen(line: str) -> tuple[int, int]:
    return sum(len(line) > n for n in LENGTHS), 0 if line.endswith("?") else 1 if line.endswith((".", "!")) else 2


def length_class(line: Column) -> Column:
    return sum(((F.length(line) > n).cast("int") for n in LENGTHS[1:]), (F.length(line) > LENGTHS[0]).cast("int"))


def ending_class(line: Column) -> Column:
    return F.when(line.endswith("?"), 0).when(line.endswith(".") | line.endswith("!"), 1).otherwise(2)


@dataclass
class Model:
    """Log-probabilities. States: role for a turn's first line, role + 3 for later ones."""

    start: np.ndarray
    move: np.ndarray
    marker: np.ndarray
    length: np.ndarray
    ending: np.ndarray


def fit(turns: DataFrame) -> Model:
    """``turns``: conv_id, turn, role, text. Counts over all rows with a known role, one added to each; a few rows come back."""
    known = turns.where(F.col("role").isin(*ROLES)).select("conv_id", "turn", F.col("role").alias("r"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "r")
    steps = known.select("r", F.lead("r").over(in_order).alias("next"), (F.row_number().over(in_order) == 1).alias("first"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"))
    steps = steps.groupBy("r", "next", "first").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).collect()
    lines = known.select("r", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    shapes = lines.groupBy("r", (F.col("at") > 0).alias("later"), length_class(F.col("line")).alias("length"), ending_class(F.col("line")).alias("ending")).count().collect()

    number = {r: k for k, r in enumerate(ROLES)}
    start, next_, turns_, line_count = np.ones(3), np.ones((3, 3)), np.ones(3), np.ones(3) * 2
    for s in steps:
        k = number[s["r"]]
        start[k] += s["n"] * s["first"]
        turns_[k] += s["n"]
        line_count[k] += s["lines"]
        if s["next"]:
            next_[k, number[s["next"]]] += s["n"]
    length, ending = np.ones((6, len(LENGTHS) + 1)), np.ones((6, 3))
    for s in shapes:
        k = number[s["r"]] + 3 * s["later"]
        length[k, s["length"]] += s["count"]
        ending[k, s["ending"]] += s["count"]
    share = lambda x: x / x.sum(-1, keepdims=True)
    stop = turns_ / line_count  # a turn has one last line
    move = np.zeros((6, 6))
    for k in range(3):
        for s in (k, k + 3):
            move[s, k + 3] = 1 - stop[k]
            move[s, :3] = stop[k] * share(next_)[k]
    marker = np.full((6, 4), LATER)  # columns: none, then the roles
    marker[3:, 0] = 1 - 3 * LATER
    marker[:3] = (1 - RIGHT - NONE) / 2
    marker[:3, 0] = NONE
    marker[range(3), range(1, 4)] = RIGHT
    first = np.append(share(start), np.full(3, 1e-9))
    return Model(*(np.log(np.maximum(x, 1e-12)) for x in (first, move, marker, share(length), share(ending))))


def viterbi(model: Model, seen: list[np.ndarray]) -> list[np.ndarray]:
    """The likeliest states of many transcripts; each is an array of (marker + 1, length, ending) per line."""
    n, t = len(seen), max((len(s) for s in seen), default=0)
    sizes = np.array([len(s) for s in seen])
    obs = np.zeros((n, t, 3), np.int64)
    for k, s in enumerate(seen):
        obs[k, : len(s)] = s
    emit = model.marker.T[obs[:, :, 0]] + model.length.T[obs[:, :, 1]] + model.ending.T[obs[:, :, 2]]
    back = np.zeros((n, t, 6), np.int8)
    score = model.start + emit[:, 0] if t else np.zeros((n, 6))
    last = score.copy()
    for k in range(1, t):
        way = score[:, :, None] + model.move
        back[:, k] = way.argmax(1)
        score = way.max(1) + emit[:, k]
        last = np.where((sizes > k)[:, None], score, last)
    out = [np.zeros(s, np.int64) for s in sizes]
    state = last.argmax(1)
    for k in range(t - 1, -1, -1):
        live = sizes > k
        for i in np.flatnonzero(live):
            out[i][k] = state[i]
        moved = back[np.arange(n), k, state]
        state = np.where(live & (k > 0), moved, state)
    return out


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>\n"


def turns_of(model: Model, texts: list[str | None]) -> list[list[tuple[str, str]]]:
    """(role, text) of every turn of every transcript, markers taken off. A null or empty transcript has none."""
    lines = [marked_lines(t) if t else [] for t in texts]
    seen = [np.array([(m + 1, *_seen(x)) for m, x in part], np.int64).reshape(-1, 3) for part in lines]
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
    todo = sorted((k for k, s in enumerate(seen) if len(s)), key=lambda k: len(seen[k]), reverse=True)
    while todo:
        now = todo[: max(1, TOGETHER // len(seen[todo[0]]))]
        for k, path in zip(now, viterbi(model, [seen[k] for k in now]), strict=True):
            paths[k] = path
        todo = todo[len(now) :]
    out = []
    for part, states in zip(lines, paths, strict=True):
        turns: list[tuple[str, list[str]]] = []
        for (_, x), s in zip(part, states, strict=True):
            if s < 3 or not turns:
                turns.append((ROLES[s % 3], [x]))
            else:
                turns[-1][1].append(x)
        out.append([(r, "\n".join(x)) for r, x in turns])
    return out


def parse_transcripts(transcripts: DataFrame, model: Model, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys``, n_turns, roles (first letters), rendered: a row per transcript, one pass.

    A null or empty transcript has no turns and renders as the empty string. Rows that repeat give equal rows.
    """
    picked = transcripts.select(*keys, F.col(text_col).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), 256):
                cut = b.slice(k, 256)
                found = turns_of(model, cut.column(len(keys)).to_pylist())
                cols = [pa.array([len(t) for t in found], pa.int64()), pa.array(["".join(r[0] for r, _ in t) for t in found]), pa.array(["".join(render(*x) for x in t) for t in found])]
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], *cols], names=[*keys, "n_turns", "roles", "rendered"])

    return picked.mapInArrow(rows, f"{fields}, n_turns long, roles string, rendered string")


def transcripts(turns: DataFrame, every: int = 8) -> DataFrame:
    """Whole conversations as raw transcripts: conv_id, text, true_roles.

    Marker styles differ by conversation, and one turn in ``every`` has no marker, by a hash of conversation and turn.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.coalesce("role", F.lit(""))
    name = F.when(role == "user", F.lit("Human")).when(role == "assistant", F.lit("AI")).otherwise(F.initcap(role))
    marker = F.when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(name, F.lit(": "))).when(style == 2, F.concat(F.lit("### "), F.initcap(role), F.lit("\n"))).otherwise(F.concat(F.lit("<|"), role, F.lit("|>")))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(every)) == 0) | (role == "")
    line = F.concat(F.when(bare, F.lit("")).otherwise(marker), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("t"), line.alias("line"), F.substring(role, 1, 1).alias("r")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", F.array_join(F.col("x.line"), "\n").alias("text"), F.array_join(F.col("x.r"), "").alias("true_roles"))
