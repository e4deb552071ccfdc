"""Transcripts to chat turns.

A plain-text transcript is a list of lines; some start with a speaker marker of one style or
another, some markers name nobody known, and some turns have none. A hidden Markov model reads the
lines: its states are a role together with "first line of a turn" or "later line", its observations
the marker's class, the line's length class, its end and whether a blank line stands before it.
Transition and emission probabilities are counted on transcripts with known roles; Viterbi finds
the likeliest state sequence, from which turns are cut and rendered in one canonical form.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, partitions

ROLES = ["assistant", "system", "user"]
SPEAKERS = {
    "assistant": ["assistant", "ai", "bot", "answer", "a", "model"],
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "q", "customer"],
}
ROLE_OF = {name: role for role, names in SPEAKERS.items() for name in names}
MARKER = re.compile(r"^\s*(?:#{1,4}\s*|\*{1,2}|\[|<\|?)?([A-Za-z]{1,14})(?:\s*\d{1,3})?\s*(?:\*{1,2}:|:\*{0,2}|\]:?|\|?>)\s*")
#: How a transcript may mark a speaker; the last style has no marker.
STYLES = ["{}: ", "### {}: ", "[{}] ", "**{}:** ", "<|{}|> ", ""]
CLASSES = [*ROLES, "name", "none"]


def observe(lines: list[str]) -> np.ndarray:
    """One row per line: marker class, length class, kind of end, blank line before."""
    out = np.zeros((len(lines), 4), np.int64)
    blank = 1
    for i, line in enumerate(lines):
        m = MARKER.match(line)
        out[i, 0] = CLASSES.index(ROLE_OF.get(m[1].lower(), "name")) if m else len(CLASSES) - 1
        body = line[m.end() :] if m else line
        out[i, 1] = min(len(body).bit_length(), 11)
        end = body.rstrip()[-1:]
        out[i, 2] = 0 if end == "?" else 1 if end in (".", "!") else 2
        out[i, 3] = blank
        blank = int(not line.strip())
    return out


SIZES = (len(CLASSES), 12, 3, 2)


@dataclass
class RoleModel:
    """Log probabilities; state ``2 * role`` starts a turn, ``2 * role + 1`` continues it."""

    start: np.ndarray
    step: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def fit(cls, samples: list[tuple[list[str], list[int]]], prior: float = 0.5) -> RoleModel:
        """Smoothed counts over (lines, state of each line)."""
        n = 2 * len(ROLES)
        start, step, emit = np.full(n, prior), np.full((n, n), prior / n), [np.full((n, k), prior) for k in SIZES]
        for role in range(len(ROLES)):  # a later line follows only lines of its role
            others = [s for s in range(n) if s // 2 != role]
            step[others, 2 * role + 1] = 0
            start[2 * role + 1] = 0
        for lines, states in samples:
            seen = observe(lines)
            for i, s in enumerate(states):
                if i:
                    step[states[i - 1], s] += 1
                else:
                    start[s] += 1
                for k, table in enumerate(emit):
                    table[s, seen[i, k]] += 1
        with np.errstate(divide="ignore"):
            return cls(np.log(start / start.sum()), np.log(step / step.sum(axis=1, keepdims=True)), [np.log(t / t.sum(axis=1, keepdims=True)) for t in emit])

    def viterbi(self, lines: list[str]) -> list[int]:
        """The likeliest states; ties go to the lower state."""
        if not lines:
            return []
        seen = observe(lines)
        score = sum(t[:, seen[:, k]].T for k, t in enumerate(self.emit))
        back = np.zeros(score.shape, np.int64)
        best = self.start + score[0]
        for i in range(1, len(lines)):
            paths = best[:, None] + self.step
            back[i] = paths.argmax(axis=0)
            best = paths.max(axis=0) + score[i]
        state = int(best.argmax())
        out = [state]
        for i in range(len(lines) - 1, 0, -1):
            state = int(back[i, state])
            out.append(state)
        return out[::-1]


def turns_of(lines: list[str], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of each turn, markers removed and outer white space stripped."""
    out: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state % 2 == 0 or not out:
            m = MARKER.match(line)
            out.append((ROLES[state // 2], [line[m.end() :] if m else line]))
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(body).strip()) for role, body in out]


MARK = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
TURN = re.compile(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>\n", re.DOTALL)


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form. A ``<|`` inside a text gets a backslash (``<\\|`` one more, and so on), so that no text can open or close a turn."""
    return "".join(f"<|{role}|>\n{MARK.sub(lambda m: f'<{chr(92)}{m[1]}|', text)}\n<|end|>\n" for role, text in turns)


def parse_rendered(text: str) -> list[tuple[str, str]]:
    """The turns that ``render`` was given."""
    return [(role, ESCAPED.sub(lambda m: f"<{m[1]}|", body)) for role, body in TURN.findall(text)]


def write_transcript(key: int, turns: list[tuple[str | None, str | None]]) -> tuple[list[str], list[int]]:
    """The lines of a transcript in the style that ``key`` picks, and their states.

    Every fourth turn after the first has no marker of its own. A role outside ROLES speaks under
    its own name and counts as user; a null role has no marker and counts as user; a null text is empty.
    """
    style = STYLES[key % len(STYLES)]
    lines, states = [], []
    for i, (role, text) in enumerate(turns):
        known = role if role in ROLES else "user"
        names = SPEAKERS.get(role or "", [role or ""])
        name = names[key // len(STYLES) % len(names)]
        marked = role is not None and (i == 0 or (key + i) % 4 != 3)
        if i and not marked:
            lines.append("")
            states.append(states[-1] | 1)
        body = (text or "").split("\n")
        body[0] = (style.format(name.capitalize()) if marked else "") + body[0]
        lines += body
        states += [2 * ROLES.index(known)] + [2 * ROLES.index(known) + 1] * (len(body) - 1)
    return lines, states


def segments(conversations: DataFrame, turns: int = 256) -> DataFrame:
    """Rows (conv_id, segment, key, turns): ``turns`` consecutive turns of a conversation together, its last segment fewer.

    Turns are ordered by turn number, a null one first, then by text and role, and numbered through;
    repeated rows are so many turns. A null conv_id is no conversation. However long a conversation is,
    whatever its turn numbers and however often a row is repeated, a task holds one segment of it at a
    time: rows are dealt out by ranges of the whole order, and a range's numbers start where the ranges
    before it end.
    """
    order = ["conv_id", "turn", "text", "role"]
    rows = conversations.where(F.col("conv_id").isNotNull()).groupBy(*order).agg(F.count("*").alias("copies"))
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turns")
    # only a conversation that goes on into another range starts there after 0
    totals = dealt.groupBy("conv_id", "part").agg(F.sum("copies").alias("n"))
    cut = totals.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1").select("conv_id")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.join(cut, "conv_id").select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("base"))
    here = F.sum("copies").over(Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    numbered = dealt.withColumn("here", F.coalesce(here, F.lit(0))).join(base, ["conv_id", "part"], "left")
    numbered = numbered.withColumn("first", F.col("here") + F.coalesce("base", F.lit(0))).withColumn("last", F.col("first") + F.col("copies") - 1)
    spread = numbered.withColumn("segment", F.explode(F.sequence(F.floor(F.col("first") / turns), F.floor(F.col("last") / turns))))
    low = F.greatest("first", F.col("segment") * turns)
    spread = spread.withColumn("times", (F.least("last", F.col("segment") * turns + turns - 1) - low + 1).cast("int")).withColumn("low", low)
    parts = spread.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("low", "times", "turn", "text", "role"))).alias("rows"))
    told = F.flatten(F.transform("rows", lambda r: F.array_repeat(F.struct(r["turn"].alias("turn"), r["text"].alias("text"), r["role"].alias("role")), r["times"])))
    return parts.select("conv_id", "segment", told.alias("turns"), F.pmod(F.xxhash64("conv_id", "segment"), F.lit(1 << 20)).cast("int").alias("key"))


def train(parts: DataFrame, limit: int = 2000) -> RoleModel:
    """A model from ``limit`` segments at most, those of the lowest keys."""
    rows = parts.orderBy("key", "conv_id", "segment").select("key", "turns").limit(limit).collect()
    return RoleModel.fit([write_transcript(r["key"], [(t["role"], t["text"]) for t in r["turns"]]) for r in rows])


def parse(parts: DataFrame, model: RoleModel) -> DataFrame:
    """Write each segment as a transcript, parse that, and render what was found.

    Per segment: turns written and found, the share of lines whose role was recovered, the roles
    found and the rendered text with its sha256.
    """
    schema = "conv_id long, segment long, n_turns long, found_turns long, role_accuracy double, roles string, rendered string, rendered_sha256 string"

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lines, truth = write_transcript(row["key"], [(t["role"], t["text"]) for t in row["turns"]])
                states = model.viterbi(lines)
                turns = turns_of(lines, states)
                text = render(turns)
                right = sum(a // 2 == b // 2 for a, b in zip(states, truth, strict=True)) / max(1, len(truth))
                rows.append({"conv_id": row["conv_id"], "segment": row["segment"], "n_turns": len(row["turns"]), "found_turns": len(turns), "role_accuracy": round(right, 6), "roles": "".join(r[0] for r, _ in turns), "rendered": text, "rendered_sha256": hashlib.sha256(text.encode()).hexdigest()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows)

    return parts.select("conv_id", "segment", "key", "turns").mapInArrow(run, schema)


def op6_chat_format(conversations: DataFrame) -> DataFrame:
    """Per segment of 256 turns: the turns found in its transcript and their canonical text.

    A null conv_id is left out. A null turn comes first; a null role has no marker and counts as user,
    a null or empty text is an empty turn. Equal turn numbers are ordered by text and role, and repeated
    rows are so many turns. No conversations give no row. Other columns are ignored.
    """
    parts = segments(conversations)
    return parse(parts, train(parts.where(F.pmod(F.xxhash64("conv_id"), F.lit(4)) != 2)))
