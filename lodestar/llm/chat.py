"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns (operator 3).

States are (role, first line of a turn) and (role, further line). A line is observed by its speaker
marker and by marker-free features, taken as independent given the state; all tables are counted,
with smoothing, from labelled turns. Viterbi's best path gives the turns. A conversation of many rows
is cut into consecutive parts; the best path is that of the whole conversation all the same, as the
parts' best scores from each state to each other are combined before any part is decoded."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut

#: Labelled turns that are learned from, at most.
TRAIN_TURNS, SMOOTH = 20_000, 0.5
#: Rows of a conversation that make one part, parts that are combined at once, and numbers that these may hold.
MOST, FAN, WAYS = 128, 256, 1 << 22
#: Log probabilities are multiples of this, so that their sums are exact in any order.
GRAIN = 2.0**-24
#: Conversations of more than MOST rows that a broadcast may list.
MAX_LARGE = 100_000

_SPEAKERS = {
    "user": "user", "human": "user", "q": "user", "question": "user", "prompt": "user", "instruction": "user", "customer": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "a": "assistant", "answer": "assistant", "response": "assistant", "model": "assistant", "agent": "assistant",
    "system": "system", "context": "system", "sys": "system",
}
_MARKER = re.compile(r"[ \t]*(?:#{1,6} *|\*{1,2}|<\|(?:im_start\|>)?|\[)?([A-Za-z][A-Za-z0-9_ .-]{0,23}?)(?:\|>|\]:?|\*{0,2}:\*{0,2}|>)(?:[ \t]+|$)")
_KINDS = ("none", "other", "user", "assistant", "system")
#: How a raw transcript may mark a turn; {} is the role's own name or its alias.
STYLES: tuple[tuple[str, dict[str, str]] | None, ...] = (
    ("{}: ", {"user": "User", "assistant": "Assistant", "system": "System"}),
    ("{}: ", {"user": "Human", "assistant": "AI", "system": "System"}),
    ("<|{}|>\n", {}),
    None,
)

Turn = tuple[str, str]


def marker(line: str) -> tuple[str, int]:
    """The kind of speaker marker that a line begins with, and where the line goes on."""
    m = _MARKER.match(line)
    if not m:
        return "none", 0
    kind = _SPEAKERS.get(m[1].strip().lower())
    if kind is None and (len(m[1].split()) > 3 or not m[1][0].isupper()):
        return "none", 0
    return kind or "other", m.end()


def observe(text: str, blank: bool = True, first: bool = True) -> tuple[list[str], np.ndarray]:
    """Lines that aren't blank, and their features: marker, blank line before, length, question, capital.

    blank and first tell what is before the text: a blank line or nothing, and no line at all."""
    lines, rows = [], []
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        kind, _ = marker(line)
        n = len(line)
        rows.append((_KINDS.index(kind), int(blank) + 2 * (first and not lines), min(7, n.bit_length() // 2 + (n > 300)), int(line.rstrip().endswith("?")), int(line.lstrip()[0].isupper())))
        lines.append(line)
        blank = False
    return lines, np.array(rows, np.int64).reshape(-1, len(_SIZES))


_SIZES = (len(_KINDS), 4, 8, 2, 2)


def raw_transcript(turns: list[tuple[str | None, str | None]], style: int) -> str:
    """The turns as people paste them: by style with markers, or with blank lines only."""
    how = STYLES[style % len(STYLES)]
    out = []
    for role, text in turns:
        lead = "" if how is None or role is None else how[0].format(how[1].get(role, role))
        out.append(lead + (text or ""))
    return ("\n\n" if how is None else "\n").join(out)


def render(turns: list[Turn]) -> str:
    """Canonical form: role tag, text, end tag."""
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def _grained(logs: np.ndarray) -> np.ndarray:
    return np.round(logs / GRAIN) * GRAIN


class RoleModel:
    """Log probabilities of starts, moves and features, counted from labelled transcripts."""

    def __init__(self, transcripts: list[list[tuple[str, str]]]):
        roles = Counter(role for turns in transcripts for role, _ in turns)
        self.roles = sorted(roles) or ["user"]
        n = 2 * len(self.roles)
        start, move = np.full(n, SMOOTH), np.full((n, n), SMOOTH)
        emit = [np.full((n, size), SMOOTH) for size in _SIZES]
        for number, turns in enumerate(transcripts):
            for style in {number % len(STYLES), len(STYLES) - 1}:
                path, rows = self._labelled([t for t in turns if t[0] in self.roles], style)
                if not path:
                    continue
                start[path[0]] += 1
                np.add.at(move, (path[:-1], path[1:]), 1)
                for f in range(len(_SIZES)):
                    np.add.at(emit[f], (path, rows[:, f]), 1)
        # a further line never begins a transcript, nor follows another role's
        allowed = np.zeros((n, n), bool)
        for s in range(n):
            allowed[s, 0::2] = True
            allowed[s, s | 1] = True
        start[1::2] = 0
        move[~allowed] = 0
        with np.errstate(divide="ignore"):
            self.start = _grained(np.log(start / start.sum()))
            self.move = _grained(np.log(move / move.sum(axis=1, keepdims=True)))
        self.emit = [_grained(np.log(e / e.sum(axis=1, keepdims=True))) for e in emit]

    def _labelled(self, turns: list[tuple[str, str]], style: int) -> tuple[list[int], np.ndarray]:
        """States and features of the raw transcript's lines."""
        path = []
        for turn in turns:
            lines = [x for x in raw_transcript([turn], style).split("\n") if x.strip()]
            path += [2 * self.roles.index(turn[0]) + (i > 0) for i in range(len(lines))]
        return path, observe(raw_transcript(turns, style))[1]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sum((self.emit[f][:, rows[:, f]].T for f in range(len(_SIZES))), np.zeros((len(rows), len(self.start))))

    def viterbi(self, scores: np.ndarray, before: int | None = None, last: int | None = None) -> list[int]:
        """The likeliest states; of equal ones the first. before is the state of the line before, last that of the last line, where known."""
        n = len(scores)
        if not n:
            return []
        back = np.zeros(scores.shape, np.int64)
        best = (self.start if before is None else self.move[before]) + scores[0]
        for t in range(1, n):
            ways = best[:, None] + self.move
            back[t] = ways.argmax(axis=0)
            best = ways.max(axis=0) + scores[t]
        path = [int(best.argmax()) if last is None else last]
        for t in range(n - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]

    def passage(self, text: str, blank: bool) -> np.ndarray | None:
        """Best scores through a part, by the state before it (the last row: nothing is before) and its last line's; None without lines."""
        rows = observe(text, blank, False)[1]
        if not len(rows):
            return None
        scores = self.scores(rows)
        ways = np.vstack([self.move + scores[0], self.start + self.scores(observe(text)[1][:1])[0]])
        for own in scores[1:]:
            ways = (ways[:, :, None] + self.move).max(axis=1) + own
        return ways

    def turns(self, text: str | None, blank: bool = True, before: int | None = None, last: int | None = None) -> tuple[list[str], list[tuple[int, str, list[str]]]]:
        """Lines that go on with a turn from before the text, and turns: number of the first line, role and lines without markers."""
        text = text or ""
        lines, rows = observe(text, blank, before is None)
        at = [i for i, line in enumerate(text.split("\n")) if line.strip()]
        lead: list[str] = []
        turns: list[tuple[int, str, list[str]]] = []
        for i, line, state in zip(at, lines, self.viterbi(self.scores(rows), before, last), strict=True):
            if state % 2 == 0:
                _, end = marker(line)
                turns.append((i, self.roles[state // 2], [line[end:]] if line[end:].strip() else []))
            else:
                (turns[-1][2] if turns else lead).append(line)
        return lead, turns

    def parse(self, text: str | None) -> list[Turn]:
        """Turns of a raw transcript, without markers; none for null, empty and blank texts."""
        return [(role, "\n".join(own).strip()) for _, role, own in self.turns(text)[1]]


def joined(ways: list[np.ndarray]) -> np.ndarray:
    """Best scores through consecutive parts, less a constant."""
    out = ways[0]
    for own in ways[1:]:
        out = (out[:, :, None] + own[:-1]).max(axis=1)
        out = out - out.max()
    return out


def borders(ways: list[np.ndarray], before: int | None, last: int | None) -> list[tuple[int | None, int]]:
    """The best path's state before each of the consecutive parts and at its end."""
    best = [ways[0][-1 if before is None else before]]
    for own in ways[1:]:
        now = (best[-1][:, None] + own[:-1]).max(axis=0)
        best.append(now - now.max())
    end = int(best[-1].argmax()) if last is None else last
    out: list[tuple[int | None, int]] = []
    for k in range(len(ways) - 1, 0, -1):
        begin = int((best[k - 1] + ways[k][:-1, end]).argmax())
        out.append((begin, end))
        end = begin
    return [*reversed([*out, (before, end)])]


def held_out(column):
    """Conversations that aren't learned from: CRC-32 of the id as text modulo 4 is 2."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_turns: int = TRAIN_TURNS) -> RoleModel:
    """A model from at most train_turns labelled turns of conversations that aren't held out, those of least
    hash of the id, in order of turn (null as 0), role and text: the same on every run. All their
    roles are learned; scores grow with the square of their number."""
    rows = turns.select(F.col(conv_col).cast("string").alias("conv"), F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.filter(F.col("conv").isNotNull() & F.col("role").isNotNull() & ~held_out(F.col("conv"))).withColumn("h", F.xxhash64("conv"))
    count = rows.count()
    part = min(1.0, 1.2 * train_turns / max(1, count))
    sample = rows.filter(F.col("h").cast("double") / 2.0**64 + 0.5 <= part).orderBy("h", "conv", "turn", "role", "text").limit(train_turns)
    taken: dict[str, list[tuple[int, str, str]]] = {}
    for r in sample.toArrow().to_pylist():
        taken.setdefault(r["conv"], []).append((r["turn"], r["role"], r["text"]))
    return RoleModel([[(role, text) for _, role, text in t] for t in taken.values()])


def transcripts(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, part, text, turns, begins, blank and whole: raw transcripts in a style that the conversation's hash chooses.

    A conversation's rows are in the order of turn (null as 0), role and text. Up to MOST of them are one
    transcript; more are cut into consecutive parts of MOST, wherever they lie, so that a conversation of
    any length is spread over tasks. turns has the rows' turn numbers, begins the line where each begins;
    blank tells that a blank line or nothing is before the part, whole that the conversation isn't cut."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col), F.lit(0)).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # on the scan, where a task run again numbers alike
    rows = rows.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    large = cut(rows.groupBy("conv").agg(F.count("*").alias("n")).filter(F.col("n") > MOST).select("conv"))
    listed = broadcast_checked(large, MAX_LARGE)
    groups = rows.join(listed, "conv", "left_anti").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    out = _raw(groups.select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(False).alias("led"), "rows")).withColumn("whole", F.lit(True))
    if large.isEmpty():
        return out
    order = ["conv", "turn", "role", "text", "row"]
    ranked = cut(rows.join(listed, "conv", "left_semi").orderBy(*order).withColumns({"at": F.monotonically_increasing_id(), "task": F.spark_partition_id()}))
    runs = ranked.groupBy("conv", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    so_far = Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select("conv", "task", (F.coalesce(F.sum("n").over(so_far), F.lit(0)) - F.col("first")).alias("shift")))
    placed = ranked.join(broadcast_checked(runs, MAX_LARGE), ["conv", "task"]).withColumn("place", F.col("at") + F.col("shift"))
    part = F.floor(F.col("place") / F.lit(MOST))
    # the last row of a part also goes to the next, which must know whether it ends in a blank line
    parts = F.when(F.pmod("place", F.lit(MOST)) == MOST - 1, F.array(part, part + 1)).otherwise(F.array(part))
    groups = placed.withColumn("part", F.explode(parts)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "role", "text"))).alias("rows"))
    led = F.col("rows")[0]["place"] < F.col("part") * MOST
    groups = groups.select("conv_id", "part", led.alias("led"), F.transform("rows", lambda r: F.struct(r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))
    return out.unionByName(_raw(groups.filter(~F.col("led") | (F.size("rows") > 1))).withColumn("whole", F.lit(False)))


def _raw(groups: DataFrame) -> DataFrame:
    """Transcripts of conv_id, part, led and rows; where led is true the first row is only looked at for a blank line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            texts, turns, begins, blanks = [], [], [], []
            for conv, led, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                style = zlib.crc32(f"style {conv}".encode())
                raw = [raw_transcript([(t["role"], t["text"])], style) for t in own]
                between = "\n\n" if STYLES[style % len(STYLES)] is None else "\n"
                blanks.append(not led or len(between) == 2 or not raw[0].rsplit("\n", 1)[-1].strip())
                raw, own = raw[led:], own[led:]
                texts.append(between.join(raw))
                turns.append([t["turn"] for t in own])
                begins.append(np.cumsum([0, *(r.count("\n") + len(between) for r in raw[:-1])]).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(turns, pa.list_(pa.int64())), pa.array(begins, pa.list_(pa.int64())), pa.array(blanks, pa.bool_())], names=["conv_id", "part", "text", "turns", "begins", "blank"])

    kind = dict(groups.dtypes)["conv_id"]
    return groups.mapInArrow(run, f"conv_id {kind}, part long, text string, turns array<long>, begins array<long>, blank boolean")


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_NAMES, _TYPES = ["number", "turn", "role", "text", "rendered"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]


def _parse(model: RoleModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns of whole conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                source, out = [], []
                for i, (text, turns, begins) in enumerate(zip(*(some.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                    for k, (line, role, own) in enumerate(model.turns(text)[1]):
                        said = "\n".join(own).strip()
                        source.append(i)
                        out.append((k, turns[bisect_right(begins, line) - 1], role, said, render([(role, said)])))
                own = [c.take(pa.array(source, pa.int64())) for c in some.columns[:2]]
                yield pa.RecordBatch.from_arrays([*own, *_table(out, _NAMES, _TYPES).columns], names=["conv_id", "part", *_NAMES])

    return run


def _passages(model: RoleModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """conv, part and ways (the bytes of passage()) of parts that have lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(conv, part, ways.tobytes()) for conv, part, text, blank in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (ways := model.passage(text, blank)) is not None]
            yield _table(out, ["conv", "part", "ways"], [pa.string(), pa.int64(), pa.binary()])

    return run


def _borders(model: RoleModel, parts: DataFrame) -> DataFrame:
    """conv, part, before and last: states of the whole conversation's best path at the borders of every part with lines.

    FAN parts, or as many as hold WAYS numbers, are combined into one of the level above until one is
    left, then the path is traced down level by level; no task holds more of a conversation at once."""
    states = len(model.start)
    fan = max(2, min(FAN, WAYS // states**2))

    def matrices(blobs: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(b, np.float64).reshape(states + 1, states) for b in blobs]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(conv, part, joined(matrices([o["ways"] for o in own])).tobytes()) for conv, part, own in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _table(out, ["conv", "part", "ways"], [pa.string(), pa.int64(), pa.binary()])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, own, before, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = borders(matrices([o["ways"] for o in own]), before, last)
                out += [(conv, o["part"], *ends) for o, ends in zip(own, found, strict=True)]
            yield _table(out, ["conv", "part", "before", "last"], [pa.string(), pa.int64(), pa.int64(), pa.int64()])

    def grouped(level: DataFrame) -> DataFrame:
        above = F.floor(F.col("part") / F.lit(fan)).alias("above")
        return level.groupBy("conv", above).agg(F.array_sort(F.collect_list(F.struct("part", "ways"))).alias("own"))

    levels = [cut(parts)]
    while (levels[-1].agg(F.max("part")).first()[0] or 0) >= fan:
        levels.append(cut(grouped(levels[-1]).mapInArrow(up, "conv string, part long, ways binary")))
    found = None
    for level in reversed(levels):
        own = grouped(level)
        if found is None:
            own = own.withColumns({"before": F.lit(None).cast("long"), "last": F.lit(None).cast("long")})
        else:
            own = own.join(found.withColumnRenamed("part", "above"), ["conv", "above"])
        found = own.select("conv", "own", "before", "last").mapInArrow(down, "conv string, part long, before long, last long")
    return found


def _decode(model: RoleModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns that begin in each part, and the lead that goes on with an earlier part's last turn."""
    turn = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads, found = [], []
            for text, turns, begins, blank, before, last in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                lead, own = model.turns(text, blank, before, last)
                leads.append("\n".join(lead) if lead else None)
                found.append([{"turn": turns[bisect_right(begins, line) - 1], "role": role, "text": "\n".join(said)} for line, role, said in own])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(leads, pa.string()), pa.array(found, pa.list_(turn))], names=["conv_id", "conv", "part", "lead", "found"])

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every turn; tails are the later parts' leads that belong to the last one."""
    for batch in batches:
        source, out = [], []
        for i, (found, number, tails) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)):
            for k, t in enumerate(found):
                more = [x["lead"] for x in tails or []] if k == len(found) - 1 else []
                said = "\n".join([t["text"], *more]).strip()
                source.append(i)
                out.append((number + k, t["turn"], t["role"], said, render([(t["role"], said)])))
        own = [c.take(pa.array(source, pa.int64())) for c in batch.columns[:2]]
        yield pa.RecordBatch.from_arrays([*own, *_table(out, _NAMES, _TYPES).columns], names=["conv_id", "part", *_NAMES])


def _format_parts(raw: DataFrame, model: RoleModel, schema: str) -> DataFrame:
    """Turns of conversations that are cut into parts."""
    kind = dict(raw.dtypes)["conv_id"]
    raw = raw.withColumn("conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))
    ends = _borders(model, raw.select("conv", "part", "text", "blank").mapInArrow(_passages(model), "conv string, part long, ways binary"))
    known = raw.join(ends, ["conv", "part"]).select("conv_id", "conv", "part", "text", "turns", "begins", "blank", "before", "last")
    decoded = cut(known.mapInArrow(_decode(model), f"conv_id {kind}, conv string, part long, lead string, found array<struct<turn:long,role:string,text:string>>"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    count = F.size("found")
    counts = decoded.select("conv", "part", count.alias("n"), F.col("lead").isNotNull().alias("led"))
    counts = counts.select("conv", "part", "n", "led", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("number"), F.last(F.when(F.col("n") > 0, F.col("part")), True).over(earlier).alias("owner"))
    counts = cut(counts)
    leads = decoded.filter("lead is not null").select("conv", "part", "lead").join(counts.filter("led").select("conv", "part", "owner"), ["conv", "part"])
    tails = leads.groupBy("conv", F.col("owner").alias("part")).agg(F.array_sort(F.collect_list(F.struct("part", "lead"))).alias("tails"))
    turns = decoded.filter(count > 0).join(counts.select("conv", "part", "number"), ["conv", "part"]).join(tails, ["conv", "part"], "left")
    return turns.select("conv_id", "part", "found", "number", "tails").mapInArrow(_finish, schema)


def format_chats(raw: DataFrame, model: RoleModel) -> DataFrame:
    """conv_id, part, number, turn, role, text and rendered of every turn found in transcripts().

    number counts a conversation's turns, part and turn are those of the row where the turn begins.
    A conversation in parts has the turns of its likeliest path as a whole: states are carried over
    the borders, and a turn that goes on beyond one is joined. Null, empty and blank transcripts
    have no turns; equal transcripts have equal turns; an empty table gives no rows."""
    schema = f"conv_id {dict(raw.dtypes)['conv_id']}, part long, number long, turn long, role string, text string, rendered string"
    out = raw.filter("whole").mapInArrow(_parse(model), schema)
    parts = raw.filter("not whole")
    return out if parts.isEmpty() else out.unionByName(_format_parts(parts, model, schema))
