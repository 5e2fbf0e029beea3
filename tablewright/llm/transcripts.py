"""Roles of transcripts by a hidden Markov model over their lines.

A transcript is plain text; its lines belong to turns of system, user or
assistant, written with all sorts of speaker markers or hardly any. The hidden
state of a line is its role and whether it begins a turn. A line shows the
word of its speaker marker, the marker's style, its length, how it ends and
whether it is blank; given the state these are taken as independent. Counts of
labelled transcripts, made by Spark, give all probabilities. Viterbi finds the
likeliest states; runs of them are turns, which are rendered in one canonical
form.

Transcripts are made from a table of turns here, in one of several styles by a
hash of the conversation, so the truth is known. A conversation is cut every
``part_turns`` turn numbers: what a task holds of it is bounded. Different rows
that share conversation and turn number are alternatives, of which a transcript
has one: ordered by role and text, the first goes to branch 0, the second to
branch 1 and so on, and every branch is a transcript of its own. Rows equal in
conversation, turn number, role and text are one turn. Nobody knows which rows
without a conversation belong together: each is a transcript, with a null branch.

Defined results: null and empty transcripts have no turns. A null role is the
role ``user``, a null text the empty text. Markers never seen in training count as one
unknown marker. Long transcripts are parsed whole. Without training rows every
line is a turn of the first role.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches
from tablewright.operators.joins import attach
from tablewright.operators.ordering import global_index

ROLES = ("system", "user", "assistant")
#: Names of the roles in each style, and how a line of a turn begins; ``{}`` is the name.
STYLES = (
    ("{}: ", ("System", "User", "Assistant")),
    ("### {}:\n", ("System", "Human", "Assistant")),
    ("[{}]\n", ("system", "user", "assistant")),
    ("<|{}|>\n", ("system", "user", "assistant")),
    ("**{}:** ", ("Instructions", "You", "Bot")),
    ("{}: ", ("Context", "Q", "A")),
    ("{}> ", ("sys", "customer", "agent")),
    ("- ", ("", "", "")),
)
RESULT = "roles array<string>, texts array<string>, rendered string"
_MARKER = re.compile(r"\s{0,3}(?:(?P<open>\*\*|#{1,4} |<\||\[|- |> )\s?)?(?:(?P<word>[A-Za-z]{1,16})(?P<close>:\*\*|\|>|\]|:|>))?(?: |$)?")


@dataclass(frozen=True)
class Settings:
    part_turns: int = 64
    #: Marker words that keep a value of their own.
    max_markers: int = 200
    smoothing: float = 0.5


def features(line: str) -> tuple[str, str, str, str]:
    """Marker word, marker style, length class and ending of a line."""
    m = _MARKER.match(line)
    opened, word, closed = (m.group("open") or "", (m.group("word") or "").lower(), m.group("close") or "") if m else ("", "", "")
    n = len(line.strip())
    size = "0" if n == 0 else str(min(4, 1 + n.bit_length() // 3))
    return word, opened.strip() + " " + closed, size, line.rstrip()[-1:] if line.rstrip()[-1:] in "?.!:" else ""


def strip_marker(line: str) -> str:
    m = _MARKER.match(line)
    return line[m.end():] if m and (m.group("open") or m.group("word")) else line


def render_style(turns: Sequence[tuple[str, str]], style: int) -> list[tuple[str, int]]:
    """Lines of a transcript with their states; state 2 * role + 1 is a later line of a turn."""
    form, names = STYLES[style]
    lines = []
    for role, text in turns:
        r = ROLES.index(role) if role in ROLES else ROLES.index("user")
        content = form.format(names[r]) + (text or "")
        lines += [(x, 2 * r + (i > 0)) for i, x in enumerate(content.split("\n"))]
    return lines


def canonical(roles: Sequence[str], texts: Sequence[str]) -> str:
    return "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in zip(roles, texts, strict=True))


@dataclass
class Model:
    """Log probabilities: start, transition, and one table of values for each feature."""

    start: np.ndarray
    move: np.ndarray
    tables: list[dict[str, np.ndarray]]
    unknown: list[np.ndarray]

    def viterbi(self, lines: Sequence[str]) -> list[int]:
        emit = np.zeros((len(lines), len(self.start)))
        for i, line in enumerate(lines):
            for table, other, value in zip(self.tables, self.unknown, features(line), strict=True):
                emit[i] += table.get(value, other)
        best, back = self.start + emit[0], np.zeros(emit.shape, dtype=np.int64)
        for i in range(1, len(lines)):
            paths = best[:, None] + self.move
            back[i] = paths.argmax(axis=0)
            best = paths[back[i], np.arange(len(best))] + emit[i]
        states = [int(best.argmax())]
        for i in range(len(lines) - 1, 0, -1):
            states.append(int(back[i, states[-1]]))
        return states[::-1]

    def parse(self, text: str | None) -> tuple[list[str], list[str]]:
        """Roles and texts of the turns of a transcript."""
        if not text:
            return [], []
        lines = text.split("\n")
        turns: list[tuple[str, list[str]]] = []
        for line, state in zip(lines, self.viterbi(lines), strict=True):
            if state % 2 and turns:
                turns[-1][1].append(line)
            else:
                turns.append((ROLES[state // 2], [line]))
        texts = []
        for _, own in turns:
            first = strip_marker(own[0])
            # A marker on a line of its own is no part of the text.
            texts.append("\n".join(own[1:] if not first and len(own) > 1 else [first, *own[1:]]))
        return [r for r, _ in turns], texts


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """conv, branch, part, turns (role, text in order) and style of every part of a conversation."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("user")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    part = F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / settings.part_turns)
    one = F.struct("turn", "role", "text")
    # Joined by its text, so that rows without a turn number meet too.
    named = rows.where("conv is not null").withColumn("at", F.coalesce(F.col("turn").cast("string"), F.lit("")))
    repeated = named.groupBy("conv", "at").agg(F.count(F.lit(1)).alias("n"), F.lit(True).alias("again")).where("n > 1")
    marked = attach(named, repeated, ["conv", "at"], weight="n")
    single = marked.where("again is null").select("conv", "turn", "role", "text", F.lit(0).cast("long").alias("branch"))
    several = marked.where("again").select("conv", "at", "turn", "role", "text").distinct()
    several = global_index(several, ["conv", "turn", "role", "text"], "place")
    first = several.groupBy("conv", "at").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    branches = attach(several, first, ["conv", "at"], weight="n").select("conv", "turn", "role", "text", (F.col("place") - F.col("first")).alias("branch"))
    # At most part_turns rows of a part are in a branch.
    grouped = single.unionByName(branches).groupBy("conv", "branch", part.alias("part")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    alone = rows.where("conv is null").select("conv", F.lit(None).cast("long").alias("branch"), part.alias("part"), F.array(one).alias("turns"))
    parts = grouped.unionByName(alone)
    style = F.pmod(F.xxhash64("conv"), F.lit(len(STYLES))).cast("int")
    return parts.select("conv", "branch", "part", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), style.alias("style"))


def _lines(turns: Sequence[dict], style: int) -> list[tuple[str, int]]:
    return render_style([(t["role"], t["text"]) for t in turns], style)


def transcripts(parts: DataFrame) -> Column:
    """The transcript of each row of :func:`conversations`."""

    @F.pandas_udf("string")
    def write(turns: pd.Series, style: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(x for x, _ in _lines(t, s)) for t, s in zip(turns, style, strict=True)])

    return write(F.col("turns"), F.col("style"))


def is_held_out(conv: Column) -> Column:
    return F.coalesce(F.crc32(conv.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(parts: DataFrame, settings: Settings = Settings()) -> Model:
    """Count starts, moves and feature values over all labelled lines; the counts are few, whatever the input."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for turns, style in zip(batch["turns"], batch["style"], strict=True):
                last = -1
                for line, state in _lines(turns, style):
                    n["move", last, state, ""] += 1
                    last = state
                    for i, value in enumerate(features(line)):
                        n[str(i), state, 0, value] += 1
            yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["kind", "a", "b", "value", "n"])

    counts = parts.select("turns", "style").mapInPandas(count, "kind string, a int, b int, value string, n long")
    counts = counts.groupBy("kind", "a", "b", "value").agg(F.sum("n").alias("n"))
    # Only marker words are open-ended: the most frequent keep a value of their own.
    often = counts.where("kind = '0'").groupBy("value").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "value").limit(settings.max_markers)
    kept = counts.where("kind <> '0'").unionByName(counts.where("kind = '0'").join(F.broadcast(often.select("value")), "value", "left_semi").select(*counts.columns))
    states, add = 2 * len(ROLES), settings.smoothing
    start, move = np.full(states, add), np.full((states, states), add)
    values: list[dict[str, np.ndarray]] = [{} for _ in range(4)]
    for row in kept.collect():
        if row.kind != "move":
            values[int(row.kind)].setdefault(row.value, np.zeros(states))[row.a] += row.n
        elif row.a < 0:
            start[row.b] += row.n
        else:
            move[row.a, row.b] += row.n
    start[1::2] = 0
    for a in range(states):
        for b in range(1, states, 2):
            # A later line belongs to the turn before it.
            if a // 2 != b // 2:
                move[a, b] = 0
    with np.errstate(divide="ignore"):
        start, move = np.log(start / start.sum()), np.log(move / move.sum(axis=1, keepdims=True))
    tables, unknown = [], []
    for table in values:
        total = sum(table.values(), np.zeros(states)) + add * (len(table) + 1)
        tables.append({v: np.log((n + add) / total) for v, n in table.items()})
        unknown.append(np.log(add / total))
    return Model(start, move, tables, unknown)


def parsed(df: DataFrame, model: Model, text: str = "transcript") -> Column:
    """Struct of roles, texts and canonical rendering of a transcript column."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            turns = [shared.value.parse(t) for t in texts]
            yield pd.DataFrame({
                "roles": [r for r, _ in turns], "texts": [t for _, t in turns], "rendered": [canonical(r, t) for r, t in turns],
            })

    return parse(F.col(text))


def recover(turns: DataFrame, conv: str = "conv_id", settings: Settings = Settings()) -> DataFrame:
    """Transcripts of all conversations, parsed: conv, branch, part, held_out, style, n_turns, roles, texts, rendered and whether roles and texts are right."""
    small_batches(turns.sparkSession)
    parts = conversations(turns, conv, settings=settings)
    model = train(parts.where(~is_held_out(F.col("conv"))), settings)
    parts = parts.withColumn("transcript", transcripts(parts))
    found = parts.withColumn("p", parsed(parts, model))
    true_roles, true_texts = F.col("turns.role"), F.col("turns.text")
    return found.select(
        F.col("conv").alias(conv), "branch", "part", is_held_out(F.col("conv")).alias("held_out"), "style", F.size("turns").alias("n_turns"),
        "p.*", (F.col("p.roles") == true_roles).alias("roles_right"), (F.col("p.texts") == true_texts).alias("texts_right"),
    )
