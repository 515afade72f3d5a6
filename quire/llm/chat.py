"""Chat transcripts: a hidden Markov model over lines recovers turns and roles.

States are (role, first line of a turn or later line). A line emits a speaker marker class and a
line class; Viterbi finds the likeliest states of a transcript's lines, and turns are rendered in
one canonical form. Transitions and emissions are relative frequencies, with an even share for what was never seen, of
transcripts made from a bounded sample of conversations with known roles.

Long conversations come as parts of bounded size. The best scores from each state before a part to
each state at its end are a 6 x 6 matrix; the matrices of a conversation, multiplied in groups and then
over the groups, give the likeliest states between parts, and each part is decoded between
these: the states are those of one pass over the whole conversation.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.text import frugal
from quire.session import cut, ship

ROLES = ("system", "user", "assistant")
#: Words that name a speaker, by role (fixed values).
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "prompt", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "agent", "model", "response"),
}
_ROLE_OF = {w: r for r, ws in SPEAKERS.items() for w in ws}
_MARKER = re.compile(r"^\s{0,3}(?:<\|(\w+)\|>|\[(\w+)\]:?|#{1,4} (\w+):?$|\*\*(\w+):?\*\*:?|(\w+):)[ \t]?")
#: Ways to mark a speaker in the transcripts made here; {} is the speaker's name.
STYLES = (("{}: ", 0), ("<|{}|>\n", 0), ("### {}\n", 0), ("**{}:** ", 0), ("[{}] ", 1), ("{}: ", 1))

_MARKS = (*ROLES, "none")
_SHAPES = ("alone", "blank", "question", "short", "long")
_STATES = [(r, first) for r in ROLES for first in (True, False)]
#: A part holds so many turn numbers; where these have more than four times as many rows, each turn number is a part, cut by hash beyond so many rows.
TURNS = 256
#: Of the turns that are learned from, one in so many has no marker.
UNMARKED = 20
#: Parts whose matrices are multiplied in one group.
PARTS_TOGETHER = 1024


def _one_edit(a: str, b: str) -> bool:
    """One letter more, less or other, or two neighbours exchanged, makes a of b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) != len(b):
        return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def role_of(word: str) -> str | None:
    """The role that a speaker's name says, misspelt by one edit if it has four letters or more."""
    word = word.lower()
    if word not in _ROLE_OF and len(word) >= 4:
        word = next((w for w in _ROLE_OF if len(w) >= 4 and _one_edit(word, w)), word)
    return _ROLE_OF.get(word)


def features(line: str) -> tuple[str, str, int]:
    """(marker class, line class, length of the marker)."""
    m = _MARKER.match(line)
    mark, size = "none", 0
    if m:
        role = role_of(next(g for g in m.groups() if g))
        if role:  # any other name says nothing about the role
            mark, size = role, m.end()
    bare = line[size:].strip()
    shape = ("alone" if size else "blank") if not bare else "question" if bare.endswith("?") else "short" if len(bare) < 60 else "long"
    return mark, shape, size


def transcript(turns: list[tuple[str, str]], style: int) -> str:
    """Turns (role, text) as one text with speaker markers."""
    form, kind = STYLES[style % len(STYLES)]
    return "\n".join(form.format(SPEAKERS[role][min(kind, len(SPEAKERS[role]) - 1)].capitalize()) + text for role, text in turns)


class Hmm:
    """Log probabilities of starts, transitions and emissions."""

    def __init__(self):
        n = len(_STATES)
        self.start = [0.0] * n
        self.move = [[0.0] * n for _ in range(n)]
        self.mark = [[0.0] * len(_MARKS) for _ in range(n)]
        self.shape = [[0.0] * len(_SHAPES) for _ in range(n)]

    def learn(self, turns: list[tuple[str, str]], style: int) -> None:
        """Count one transcript with known roles, in which one marker in UNMARKED is missing."""
        last = None
        for n, (role, text) in enumerate(turns):
            marked = not n or (n + 7 * style) % UNMARKED
            for k, line in enumerate((transcript([(role, text)], style) if marked else text).split("\n")):
                s = _STATES.index((role, k == 0))
                mark, shape, _ = features(line)
                self.mark[s][_MARKS.index(mark)] += 1
                self.shape[s][_SHAPES.index(shape)] += 1
                if last is None:
                    self.start[s] += 1
                else:
                    self.move[last][s] += 1
                last = s

    def fixed(self) -> "Hmm":
        """Counts as log probabilities; a later line only follows a line of its own role."""

        def log(counts, allowed=None, rest=1e-3):
            # a small share is spread evenly: what was never seen is as unlikely in every state
            allowed = allowed or [True] * len(counts)
            total, n = sum(counts), sum(allowed)
            return [math.log(((1 - rest) * c / total if total else (1 - rest) / n) + rest / n) if ok else -math.inf for c, ok in zip(counts, allowed)]

        self.start = log(self.start, [first for _, first in _STATES])
        self.move = [log(row, [first or to == role for to, first in _STATES]) for row, (role, _) in zip(self.move, _STATES)]
        self.mark = [log(r, rest=1e-6) for r in self.mark]  # a marker outweighs the order of roles
        self.shape = [log(r) for r in self.shape]
        return self

    def viterbi(self, seen: list[tuple[str, str]]) -> list[tuple[str, bool]]:
        """Likeliest states of lines with these marker and line classes."""
        return [_STATES[s] for s in self.paths([symbols(seen)])[0].tolist()]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start by state, move from state to state, and emit by symbol and state."""
        emit = np.array(self.mark).T[:, None, :] + np.array(self.shape).T[None, :, :]
        return np.array(self.start), np.array(self.move), emit.reshape(-1, len(_STATES))

    def paths(self, seen: list[np.ndarray], before: list[int] | None = None, last: list[int] | None = None) -> list[np.ndarray]:
        """States of many symbol sequences at once, each between a state before it (-1: none) and its last state (-1: any)."""
        start, move, emit = self.tables()
        order = sorted(range(len(seen)), key=lambda i: -len(seen[i]))
        sizes = np.array([len(seen[i]) for i in order])
        width = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(order), width), np.int16)
        for k, i in enumerate(order):
            grid[k, : sizes[k]] = seen[i]
        first = np.array([start if before is None or before[i] < 0 else move[before[i]] for i in order]).reshape(-1, len(start))
        ends = np.zeros((len(order), len(start)))
        if width:
            score = first + emit[grid[:, 0]]
            ends[:] = score
        back = []
        for k in range(1, width):
            live = int(np.searchsorted(-sizes, -k, "left"))  # sequences of more than k lines
            step = score[:live, :, None] + move[None]
            back.append(step.argmax(1).astype(np.uint8))
            score = step.max(1) + emit[grid[:live, k]]
            ends[:live] = score
        state = ends.argmax(1)
        if last is not None:
            state = np.array([state[k] if last[i] < 0 else last[i] for k, i in enumerate(order)])
        out = np.zeros((len(order), width), np.uint8)
        for k in range(width - 1, -1, -1):
            live = int(np.searchsorted(-sizes, -k, "left"))
            out[:live, k] = state[:live]
            if k:
                state[:live] = back[k - 1][np.arange(live), state[:live]]
        found: list = [None] * len(order)
        for k, i in enumerate(order):
            found[i] = out[k, : sizes[k]]
        return found

    def matrix(self, seen: np.ndarray, begins: bool) -> np.ndarray:
        """Best score from each state before the symbols (at the begin of a conversation all rows are equal) to each last state."""
        start, move, emit = self.tables()
        score = (np.broadcast_to(start, move.shape) if begins else move) + emit[seen[0]]
        for x in seen[1:]:
            score = (score[:, :, None] + move[None]).max(1) + emit[x]
        return score

    def turns(self, text: str, states: np.ndarray | None = None) -> list[tuple[str, str, bool]]:
        """(role, text, whether the turn begins here) of a transcript or a part of one; only the first may go on from the part before."""
        lines = text.split("\n")
        found = [features(x) for x in lines]
        states = self.paths([symbols([f[:2] for f in found])])[0] if states is None else states
        out: list[tuple[str, list[str], bool]] = []
        for line, (mark, _, size), s in zip(lines, found, states.tolist()):
            role, first = _STATES[s]
            if first or not out:
                out.append((role, [], first))
                line = line[size:] if first and mark != "none" else line
                if not line and first and mark != "none":
                    continue  # a marker on a line of its own
            out[-1][1].append(line)
        return [(role, "\n".join(body), first) for role, body, first in out]

    def parse(self, text: str) -> list[tuple[str, str]]:
        """Turns (role, text) of a transcript."""
        return [x[:2] for x in self.turns(text)] if text else []


def symbols(seen: list[tuple[str, str]]) -> np.ndarray:
    """Marker and line classes as one number a line."""
    return np.array([_MARKS.index(m) * len(_SHAPES) + _SHAPES.index(s) for m, s in seen], np.int16)


def between(mats: list[np.ndarray], before: int = 0, last: int = -1) -> list[int]:
    """Likeliest last state of each of a row of parts, of which the first begins in state `before` and the last ends in `last` (-1: any)."""
    score, back = mats[0][before], []
    for m in mats[1:]:
        step = score[:, None] + m
        back.append(step.argmax(0))
        score = step.max(0)
    s = int(score.argmax()) if last < 0 else last
    out = [s]
    for b in reversed(back):
        s = int(b[s])
        out.append(s)
    return out[::-1]


def rendered(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}\n<|end|>\n"


def sampled(turns: DataFrame, conversations: int = 2000, most_rows: int = 128_000) -> DataFrame:
    """The turns (conv_id, turn, role, text) of about `conversations` whole conversations, at most `most_rows` rows in all.

    By hash of conv_id, and in its order where the rows are too many: a conversation that doesn't fit in what is left is
    passed over whole. Turns of other roles and without text aren't learned from and don't count.
    """
    total = turns.select("conv_id").distinct().count()
    rate = min(1.0, conversations / max(1, total))
    place = F.pmod(F.xxhash64("conv_id", F.lit(9)), F.lit(1 << 30))
    some = turns.filter(place < rate * (1 << 30)).filter(F.col("role").isin(*ROLES) & F.col("text").isNotNull())
    some = some.select("conv_id", "turn", "role", "text")
    left, out = most_rows, []
    for r in sorted(some.groupBy("conv_id", place.alias("place")).agg(F.count("*").alias("n")).collect(), key=lambda r: (r.place, str(r.conv_id))):
        if r.n <= left:
            left -= r.n
        else:
            out.append(r.conv_id)
    if not out:
        return some
    over = F.when(F.col("conv_id").isNull(), F.lit(None in out)).otherwise(F.col("conv_id").isin([c for c in out if c is not None]))
    return some.filter(~over)


def learn(turns: DataFrame, conversations: int = 2000, most_rows: int = 128_000) -> Hmm:
    """Fit on the sampled() conversations, each in every style; the bounds hold whatever the table's size."""
    by: dict[int, list] = {}
    for r in sampled(turns, conversations, most_rows).collect():
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    model = Hmm()
    for c in sorted(by, key=str):
        for style in range(len(STYLES)):
            model.learn([x[1:] for x in sorted(by[c])], style)
    return model.fixed()


def transcripts(turns: DataFrame) -> DataFrame:
    """Transcripts (conv_id, part, many, numbers, transcript) of conversations (conv_id, turn, role, text).

    A transcript holds the turns of one conversation in order of turn, role and text, in a style chosen by its id, and
    numbers their turn numbers. Conversations over several stretches of 256 turn numbers, or with more than 1,024 rows in
    one, come in parts (many: true) of bounded size, whose order is that of part. Null text is empty, a null turn is 0;
    names of roles that SPEAKERS knows stand for their role, and rows with another role, or null, are taken as the user's.
    """
    said = F.lower("role")
    role = F.lit("user")
    for r in ROLES:
        role = F.when(said.isin(*SPEAKERS[r]), r).otherwise(role)
    rows = turns.select(
        F.col("conv_id").cast("long"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.xxhash64("text", F.monotonically_increasing_id()).alias("deal"),
    )
    stretch = F.floor(F.col("turn") / TURNS).cast("long")
    counted = rows.groupBy("c", "turn").agg(F.count("*").alias("n")).withColumn("stretch", stretch)
    heavy = counted.groupBy("c", "stretch").agg((F.sum("n") > 4 * TURNS).alias("heavy"))
    long = heavy.groupBy("c").agg(((F.count("*") > 1) | F.bool_or("heavy")).alias("long")).filter("long").drop("long")
    found = counted.join(long, "c").join(heavy, ["c", "stretch"]).select("c", "turn", "heavy", F.ceil(F.col("n") / TURNS).alias("pieces"))
    rows = rows.join(cut(found), ["c", "turn"], "left").withColumn("many", F.col("pieces").isNotNull())
    # (stretch, turn, piece): stretches that aren't heavy are one part
    alone = F.coalesce("heavy", F.lit(False))
    part = F.array(F.when(F.col("many"), stretch).otherwise(0), F.when(alone, F.col("turn")).otherwise(0), F.when(alone, F.pmod("deal", "pieces")).otherwise(0))
    rows = rows.groupBy("conv_id", part.alias("part"), "many").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    forms = F.array(*(F.lit(x[0]) for x in STYLES))
    kinds = F.array(*(F.lit(x[1]) for x in STYLES))
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES))).cast("int")
    rows = rows.withColumn("form", F.element_at(forms, style + 1)).withColumn("kind", F.element_at(kinds, style + 1))

    def name(x):
        out = None
        for r in ROLES:
            said = F.when(F.col("kind") == 0, SPEAKERS[r][0].capitalize()).otherwise(SPEAKERS[r][min(1, len(SPEAKERS[r]) - 1)].capitalize())
            out = F.when(x["role"] == r, said) if out is None else out.when(x["role"] == r, said)
        return F.replace(F.col("form"), F.lit("{}"), out)

    body = F.array_join(F.transform("turns", lambda x: F.concat(name(x), x["text"])), "\n")
    return rows.select("conv_id", "part", "many", F.transform("turns", lambda x: x["turn"]).alias("numbers"), body.alias("transcript"))


_TURN = "conv_id long, part array<long>, turn long, role string, text string, rendered string"


def _rows(c, part, numbers, found):
    """A batch of the turns of one transcript: the stated turn numbers if they are as many, else counted on from the first."""
    n = len(found)
    first = numbers[0] if numbers else 0
    numbers = numbers if numbers and len(numbers) == n else range(first, first + n)
    return [(c, part, t, role, text, rendered(role, text)) for t, (role, text, _) in zip(numbers, found)]


def _batch(rows):
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["conv_id", "part", "turn", "role", "text", "rendered"])


def parse(lines: DataFrame, model: Hmm) -> DataFrame:
    """Turns of transcripts (conv_id, transcript, and, where transcripts() made them, part, many, numbers): conv_id, part, turn, role, text, rendered.

    Null and empty transcripts have no turns. Turns carry the stated numbers where as many turns are found as stated,
    else they count on from the first. Rows that repeat a conv_id are parsed each for itself unless many is true: those
    are the parts of one conversation, in order of part, and its states are found as in one pass; a turn that goes on in the next part
    stays a row of each. An empty table gives no rows.
    """
    ship(lines.sparkSession)
    for name, value in (("part", F.array(F.lit(0).cast("long"))), ("many", F.lit(False)), ("numbers", F.lit(None).cast("array<long>"))):
        if name not in lines.columns:
            lines = lines.withColumn(name, value)
    lines = lines.select(F.col("conv_id").cast("long"), F.col("part").cast("array<long>"), "many", F.col("numbers").cast("array<long>"), F.col("transcript").cast("string"))
    lines = lines.filter(F.col("transcript") != "")

    @frugal
    def run(batches):
        for batch in batches:
            whole, part, numbers, text, before, last = (batch.column(i).to_pylist() for i in range(6))
            for at in range(0, len(text), 1024):
                some = range(at, min(at + 1024, len(text)))
                seen = [symbols([features(x)[:2] for x in text[i].split("\n")]) for i in some]
                states = model.paths(seen, [before[i] for i in some], [last[i] for i in some])
                yield _batch([r for i, s in zip(some, states) for r in _rows(whole[i], part[i], numbers[i], model.turns(text[i], s))])

    columns = ["conv_id", "part", "numbers", "transcript", "before", "last"]
    short = lines.filter("not many").withColumn("before", F.lit(-1)).withColumn("last", F.lit(-1))
    return short.select(columns).mapInArrow(run, _TURN).unionByName(_in_parts(lines.filter("many"), model).select(columns).mapInArrow(run, _TURN))


def _in_parts(lines: DataFrame, model: Hmm) -> DataFrame:
    """The parts of long conversations with the states before them and at their ends, as one pass over all parts finds them."""
    lines = cut(lines.withColumn("c", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))))
    if lines.isEmpty():
        return lines.withColumn("before", F.lit(-1)).withColumn("last", F.lit(-1))
    # part numbers of a conversation: no text moves for them
    place = F.row_number().over(Window.partitionBy("c").orderBy("part")) - 1
    numbered = cut(lines.select("c", "part").withColumn("k", place))

    @frugal
    def score(batches):
        for batch in batches:
            c, k, text = (batch.column(i).to_pylist() for i in range(3))
            mats = [model.matrix(symbols([features(x)[:2] for x in t.split("\n")]), n == 0).ravel().tolist() for t, n in zip(text, k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mats, pa.list_(pa.float64()))], ["c", "k", "m"])

    def ordered(table, by):
        table = table.sort_by(by)
        return table, [np.array(m).reshape(len(_STATES), -1) for m in table.column("m").to_pylist()]

    def product(key, table):
        _, mats = ordered(table, "k")
        out = mats[0]
        for m in mats[1:]:
            out = (out[:, :, None] + m[None]).max(1)
        return pa.table({"c": [key[0].as_py()], "g": pa.array([key[1].as_py()], pa.int32()), "m": pa.array([out.ravel().tolist()], pa.list_(pa.float64()))})

    def outer(key, table):  # one row for PARTS_TOGETHER parts
        table, mats = ordered(table, "g")
        last = between(mats)
        return pa.table({"c": table.column("c"), "g": table.column("g"), "before": pa.array([0, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    def inner(key, table):
        table, mats = ordered(table, "k")
        first = table.column("k")[0].as_py() == 0
        before = table.column("before")[0].as_py()
        last = between(mats, before, table.column("last")[0].as_py())
        return pa.table({"c": table.column("c"), "k": table.column("k"), "before": pa.array([-1 if first else before, *last[:-1]], pa.int32()), "last": pa.array(last, pa.int32())})

    mats = lines.select("c", "part", "transcript").join(numbered, ["c", "part"]).select("c", "k", "transcript").mapInArrow(score, "c string, k int, m array<double>")
    mats = cut(mats.withColumn("g", F.floor(F.col("k") / PARTS_TOGETHER).cast("int")))
    groups = mats.groupBy("c", "g").applyInArrow(product, "c string, g int, m array<double>")
    ends = groups.groupBy("c").applyInArrow(outer, "c string, g int, before int, last int")
    states = mats.join(ends, ["c", "g"]).groupBy("c", "g").applyInArrow(inner, "c string, k int, before int, last int")
    return lines.join(numbered, ["c", "part"]).join(states, ["c", "k"])
