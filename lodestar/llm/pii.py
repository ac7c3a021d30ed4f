"""Personal data by patterns and a character-level BiLSTM with CRF transitions (operator 8).

The patterns give the base spans. The network reads windows of characters that overlap by MARGIN on
either side; each window answers for its core, the cores' emissions are joined over the whole text,
and the CRF decodes the text as one: characters that no best path can take for personal data are known by
a bound, and only the stretches between them are searched."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import pieces, text_buffer

KINDS = ("email", "ip", "card", "phone")
CORE, MARGIN = 224, 16
WINDOW = CORE + 2 * MARGIN
HIDDEN, EMBED, TAGS = 8, 6, 1 + len(KINDS)
BATCH = 512
PIECE = 1 << 19
#: Windows whose emissions are held at once.
KEPT = 8192
#: Stretches searched together at most, and how far one may be filled up to the length of another.
TOGETHER, FILLED, FILLED_LEAST = 1024, 1.25, 8
#: Made-up training texts, the characters seen of each, and how they are gone through.
TRAIN_TEXTS, TRAIN_WINDOW, TRAIN_BATCH, TRAIN_STEPS, TRAIN_SEED = 6000, 64, 64, 450, 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: An address that is spelt out; a bare `at` needs a bare `dot`.
_SPELT = re.compile(r"(?i)[a-z0-9._%+-]+(?: ?[(\[]at[)\]] ?[a-z0-9-]+(?:(?:\.| ?[(\[]dot[)\]] ?)[a-z0-9-]+)+| at [a-z0-9-]+(?: dot [a-z0-9-]+)+|@[a-z0-9-]+(?:\.[a-z0-9-]+)+)")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# no match begins within a run of digits: what fails at its start fails further on
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# character classes by the first byte of a character's UTF-8 form: letters without case, digits as one
_MARKS = "@.-+()[]_/:,"
PAD, OTHER, FOREIGN, DIGIT, BLANK, BREAK = 0, 1, 2, 3, 4, 5
CLASSES = 6 + len(_MARKS) + 26
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[128:] = FOREIGN
_CLASS[48:58] = DIGIT
_CLASS[[32, 9]] = BLANK
_CLASS[[10, 11, 12, 13]] = BREAK
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _i
for _i in range(26):
    _CLASS[[65 + _i, 97 + _i]] = 6 + len(_MARKS) + _i

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by the patterns, in code points; in time linear in the text."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        local = text[end:at]
        start = at - (len(local) - len(local.rstrip(_LOCAL)))
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            out.append((start, end, "email"))
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# ---------------------------------------------------------------- labelled spans to learn from


def labelled_text(rng: random.Random, words: int = 12) -> tuple[str, list[Span]]:
    """A made-up text with its spans: forms that the patterns know, forms that they don't, and look-alikes."""

    def word() -> str:
        return "".join(rng.choice("the an er re on in tion ou le qui en der sch ung que ado os ie eau é ü ñ ing wh st a i at dot".split()) for _ in range(rng.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def hexes() -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 40)))

    def name() -> str:
        return "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8)))

    def email() -> str:
        user = name() + rng.choice(["", "." + name(), digits(2), "_" + name(), "." + digits(2)])
        host, top = name() + rng.choice(["", digits(1)]) + rng.choice(["", ".example"]), rng.choice(["com", "org", "net", "de", "fr", "es"])
        at, dot = rng.choice([("@", ".")] * 3 + [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        return f"{user}{at}{host.replace('.', dot)}{dot}{top}"

    def ip() -> str:
        return rng.choice([".", ".", "[.]"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def card() -> str:
        number = [rng.choice("45") + digits(3), *(digits(4) for _ in range(3))]
        return rng.choice(["", "", " ", "-", "."]).join(number)

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"+{digits(1)} ({a}) {b}-{c}"] * 3 + [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)} {digits(2)} {c} {digits(4)}", f"{a}.{b}.{c}"])

    def alike() -> str:
        return rng.choice(
            [str(rng.randint(1900, 2100)), digits(rng.randint(1, 6)), f"{digits(2)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}",
             f"({word()})", f"[{digits(2)}]", f"{word()} at {word()}", f"{word()}. At {word()}. {word()}", hexes(), f"{word()}={hexes()}", f'{word()} = "{hexes()}"', f"{digits(4)}-{digits(2)}", f"{word()}@", "***", "|", "###", "$$$", f"{digits(3)},{digits(3)}", f"v{digits(1)}.{digits(2)}", f"+{digits(1)}", f"{word()}/{word()}", f"{word()}_{digits(2)}", f"https://{name()}.com/{name()}"]
        )

    makers = (email, ip, card, phone)
    text, spans = "", []
    for _ in range(words):
        r = rng.random()
        if r < 0.1:
            kind = rng.randrange(len(KINDS))
            piece = makers[kind]()
            spans.append((len(text), len(text) + len(piece), KINDS[kind]))
        else:
            piece = alike() if r < 0.22 else word()
            piece = piece.capitalize() if rng.random() < 0.15 else piece
        text += piece + rng.choice([" "] * 8 + [". ", ", ", "\n", " - ", ": "])
    return text, spans


def classes_of(raw: np.ndarray) -> np.ndarray:
    """Class of each character of UTF-8 bytes; continuation bytes go."""
    return _CLASS[raw[(raw & 0xC0) != 0x80]]


# ---------------------------------------------------------------- the network

Weights = dict[str, np.ndarray]


def _initial(rng: np.random.Generator) -> Weights:
    k = HIDDEN + EMBED
    single = lambda w: {n: v.astype(np.float32) for n, v in w.items()}
    gates = rng.normal(0, 1 / np.sqrt(k), (2, 4 * HIDDEN, k))
    bias = np.zeros((2, 4 * HIDDEN, 1))
    bias[:, HIDDEN : 2 * HIDDEN] = 1.0
    return single({"embed": rng.normal(0, 0.5, (EMBED, CLASSES)), "gates": gates, "bias": bias, "out": rng.normal(0, 0.3, (TAGS, 2 * HIDDEN)), "out_bias": np.zeros((TAGS, 1)), "moves": np.zeros((TAGS, TAGS))})


def _gradients(w: Weights, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, Weights]:
    """Mean negative log-likelihood of tag sequences (T, B) and its gradient."""
    steps, batch = symbols.shape
    h, c = np.zeros((2, HIDDEN, batch), np.float32), np.zeros((2, HIDDEN, batch), np.float32)
    seen: list[tuple[np.ndarray, ...]] = []
    hidden = np.empty((steps, 2, HIDDEN, batch), np.float32)
    both = np.stack([symbols, symbols[::-1]], 1)
    for t in range(steps):
        x = np.concatenate([h, w["embed"][:, both[t]].transpose(1, 0, 2)], axis=1)
        z = w["gates"] @ x + w["bias"]
        gate, g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN])), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        th = np.tanh(c)
        h = o * th
        hidden[t] = h
        seen.append((x, i, f, o, g, before, th))
    states = np.concatenate([hidden[:, 0], hidden[::-1, 1]], axis=1)
    emit = w["out"] @ states + w["out_bias"]
    # CRF: forward and backward log sums
    moves = w["moves"][:, :, None]
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    logsum = lambda v, axis: (m := v.max(axis=axis, keepdims=True), m.squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis)))[1]
    ahead[0] = emit[0]
    for t in range(1, steps):
        ahead[t] = logsum(ahead[t - 1][:, None] + moves, 0) + emit[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = logsum(moves + (emit[t + 1] + behind[t + 1])[None], 1)
    total = logsum(ahead[-1], 0)
    columns = np.arange(batch)
    gold = emit[np.arange(steps)[:, None], tags, columns].sum(0) + w["moves"][tags[:-1], tags[1:]].sum(0)
    d_emit = np.exp(ahead + behind - total)
    d_emit[np.arange(steps)[:, None], tags, columns] -= 1
    pair = np.exp(ahead[:-1, :, None] + moves + (emit[1:] + behind[1:])[:, None] - total)
    d_moves = pair.sum((0, 3))
    np.add.at(d_moves, (tags[:-1], tags[1:]), -1.0)
    scale = np.float32(1.0 / (batch * steps))
    grad = {"moves": d_moves * scale, "out": np.einsum("tkb,thb->kh", d_emit, states) * scale, "out_bias": d_emit.sum((0, 2))[:, None] * scale}
    d_states = w["out"].T @ d_emit * scale
    d_hidden = np.stack([d_states[:, :HIDDEN], d_states[::-1, HIDDEN:]], 1)
    grad |= {"gates": np.zeros_like(w["gates"]), "bias": np.zeros_like(w["bias"]), "embed": np.zeros_like(w["embed"])}
    dh, dc = np.zeros((2, HIDDEN, batch), np.float32), np.zeros((2, HIDDEN, batch), np.float32)
    d_x = np.empty((steps, 2, EMBED, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        x, i, f, o, g, before, th = seen[t]
        dh = dh + d_hidden[t]
        dc = dc + dh * o * (1 - th * th)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        grad["gates"] += dz @ x.transpose(0, 2, 1)
        grad["bias"] += dz.sum(2, keepdims=True)
        dx = w["gates"].transpose(0, 2, 1) @ dz
        dh, d_x[t] = dx[:, :HIDDEN], dx[:, HIDDEN:]
        dc = dc * f
    flat = d_x.transpose(2, 0, 1, 3).reshape(EMBED, -1)
    for e in range(EMBED):
        grad["embed"][e] = np.bincount(both.reshape(-1), flat[e], CLASSES)
    return float((total - gold).sum() * scale), grad


class Tagger:
    """Frozen weights in single precision.

    A logistic gate is 1 / (1 + exp(-z)) and tanh(z) is 2 / (1 + exp(-2 * z)) - 1: the inner factors are in
    the gates' weights, so that one exp serves all four, and the cell is carried as -2 times itself."""

    def __init__(self, w: Weights):
        inner = np.full((4 * HIDDEN, 1), -1.0)
        inner[3 * HIDDEN :] = -2
        self.embed = np.concatenate([w["embed"], np.ones((1, CLASSES))]).astype(np.float32)
        self.gates = (np.concatenate([w["gates"], w["bias"]], axis=2) * inner).astype(np.float32)
        self.outs = np.stack([w["out"][:, :HIDDEN], w["out"][:, HIDDEN:]]).astype(np.float32)
        self.out_bias, self.moves = w["out_bias"].astype(np.float32), w["moves"].astype(np.float32)
        m = w["moves"]
        #: A run of personal data gains at most the sum of its tags' leads and stays over it, less toll.
        self.stay = m[1:, 1:].max(axis=0) - m[0, 0]
        self.toll = float((self.stay + m[0, 0] - m[0, 1:]).min() + (m[0, 0] - m[1:, 0]).min())

    def emissions(self, symbols: np.ndarray, out: np.ndarray) -> None:
        """Writes the emissions (CORE, TAGS, B) of windows (WINDOW, B) to out."""
        batch = symbols.shape[1]
        x = np.zeros((2, HIDDEN + EMBED + 1, batch), np.float32)
        c, part, z = np.zeros((2, HIDDEN, batch), np.float32), np.empty((2, HIDDEN, batch), np.float32), np.empty((2, 4 * HIDDEN, batch), np.float32)
        both = np.empty((2, TAGS, batch), np.float32)
        read = np.take(self.embed, symbols, axis=1, mode="clip")
        above = np.ones((4 * HIDDEN, 1), np.float32)
        above[3 * HIDDEN :] = -4
        state = x[:, :HIDDEN]
        i, f, o, g = (z[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        # what lies behind the core in a direction bears on nothing that is kept; exp may overflow, where a gate is 0 or a tanh -1
        with np.errstate(over="ignore"):
            for t in range(MARGIN + CORE):
                x[0, HIDDEN:], x[1, HIDDEN:] = read[:, t], read[:, WINDOW - 1 - t]
                np.matmul(self.gates, x, out=z)
                np.exp(z, out=z)
                z += 1
                np.divide(above, z, out=z)
                g += 2
                np.multiply(i, g, out=part)
                c *= f
                c += part
                np.exp(c, out=part)
                part += 1
                np.divide(2, part, out=part)
                part -= 1
                np.multiply(o, part, out=state)
                if t >= MARGIN:
                    # the core's places are met from both sides: the first to come sets, the second adds
                    np.matmul(self.outs, state, out=both)
                    for place, own in ((t - MARGIN, both[0]), (WINDOW - 1 - t - MARGIN, both[1])):
                        if 2 * (t - MARGIN) < CORE:
                            out[place] = own
                        else:
                            out[place] += own
        out += self.out_bias

    def decode(self, emit: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags of stretches begin:begin + length, between characters that are outside, of emissions (CORE, TAGS, windows), one after another.

        Stretches of like length are searched together; what fills the shorter ones up is outside."""
        ends = np.cumsum(length)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int8)
        order = np.argsort(length, kind="stable")
        sizes = length[order]
        filler = np.array([0.0] + [-1e6] * (TAGS - 1), np.float32)
        moves, flat, windows = self.moves[:, :, None], emit.reshape(-1), emit.shape[2]
        a = 0
        while a < len(order):
            # a long stretch is not searched beside many short ones that it would fill up
            own = order[a : min(a + TOGETHER, max(a + 1, int(np.searchsorted(sizes, sizes[a] * FILLED + FILLED_LEAST, "right"))))]
            a += len(own)
            steps = int(length[own].max())
            line = np.arange(steps)[:, None]
            at = np.minimum(begin[own] + line, CORE * windows - 1)
            at = at % CORE * (TAGS * windows) + at // CORE
            outside = line >= length[own]
            values = np.empty((steps, TAGS, len(own)), np.float32)
            for k in range(TAGS):
                values[:, k] = flat[at]
                values[:, k][outside] = filler[k]
                at += windows
            score, pairs = np.empty((steps, TAGS, len(own)), np.float32), np.empty((TAGS, TAGS, len(own)), np.float32)
            score[0] = values[0] + self.moves[0][:, None]
            for t in range(1, steps):
                np.add(score[t - 1][:, None], moves, out=pairs)
                np.maximum.reduce(pairs, axis=0, out=score[t])
                score[t] += values[t]
            # where the best path is outside all along, its score is the sum of that path
            best = (score[-1] + self.moves[:, :1]).max(0)
            some = np.flatnonzero(best > values[:, 0].sum(0) + self.moves[0, 0] * (steps + 1) + 1e-3)
            if not len(some):
                continue
            score = np.ascontiguousarray(score[:, :, some])
            tags = np.zeros((steps, len(some)), np.int8)
            tags[-1] = (score[-1] + self.moves[:, :1]).argmax(0)
            for t in range(steps - 1, 0, -1):
                tags[t - 1] = (score[t - 1] + self.moves[:, tags[t]]).argmax(0)
            inside = line < length[own[some]]
            out[(line + (ends - length)[own[some]])[inside]] = tags[inside]
        return out

    def _through(self, lead: np.ndarray) -> np.ndarray:
        """Whether the best sum of a run through each character passes the toll; sums are carried from PIECE to PIECE."""
        behind = np.empty(len(lead), np.float32)
        starts = range(0, len(lead), PIECE)
        carry = 0.0
        for a in starts:
            sums = np.concatenate(([0.0], np.cumsum(lead[a : a + PIECE], dtype=np.float64)))
            behind[a : a + PIECE] = sums[1:] - np.minimum.accumulate(np.concatenate(([-carry], sums[1:-1])))
            carry = max(0.0, float(behind[min(a + PIECE, len(lead)) - 1]))
        out, carry = np.empty(len(lead), bool), 0.0
        for a in reversed(starts):
            own = lead[a : a + PIECE]
            sums = np.concatenate(([0.0], np.cumsum(own[::-1], dtype=np.float64)))
            ahead = (sums[1:] - np.minimum.accumulate(np.concatenate(([-carry], sums[1:-1]))))[::-1]
            out[a : a + PIECE] = behind[a : a + PIECE] + ahead - own > self.toll - 2e-3
            carry = max(0.0, float(ahead[0]))
        return out

    def tag(self, symbols: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, first, end, tag) of the runs that aren't outside, in texts at starts[i]:starts[i + 1].

        Emissions are kept for KEPT windows; those of a longer text are computed again where a run may be."""
        n = np.diff(starts)
        if not len(symbols):
            return []
        # each text begins a window's core and is followed by MARGIN pads at least
        per = -(-(n + MARGIN) // CORE) * (n > 0)
        laid = np.concatenate(([0], np.cumsum(per))) * CORE
        count = int(laid[-1]) // CORE
        padded = np.full(laid[-1] + 2 * MARGIN, PAD, np.uint8)
        for i in np.flatnonzero(n).tolist():
            padded[laid[i] + MARGIN : laid[i] + MARGIN + n[i]] = symbols[starts[i] : starts[i + 1]]
        windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::CORE]
        lead = np.empty((count, CORE), np.float32)
        emit = np.empty((CORE, TAGS, count if count <= KEPT else 0), np.float32)
        for a in range(0, count, BATCH):
            many = min(BATCH, count - a)
            own = emit if many == count else np.empty((CORE, TAGS, many), np.float32)
            self.emissions(np.ascontiguousarray(windows[a : a + BATCH].T).astype(np.intp), own)
            if own is not emit and count <= KEPT:
                emit[:, :, a : a + BATCH] = own
            best = own[:, 1] + self.stay[0]
            for k in range(2, TAGS):
                np.maximum(best, own[:, k] + self.stay[k - 1], out=best)
            lead[a : a + BATCH] = (best - own[:, 0]).T
        # no run bridges a pad
        lead = lead.reshape(-1)
        lead[padded[MARGIN : MARGIN + len(lead)] == PAD] = -1e6
        where = np.flatnonzero(self._through(lead))
        if not len(where):
            return []
        heads = np.concatenate(([0], np.flatnonzero(np.diff(where) != 1) + 1))
        begins, lengths = where[heads], np.diff(np.append(heads, len(where)))
        del lead, where
        tags: list[np.ndarray] = []
        if count <= KEPT:
            tags.append(self.decode(emit, begins, lengths))
        else:
            first = 0
            while first < len(begins):  # stretches in as many windows as are kept, or one longer stretch
                last = max(first + 1, int(np.searchsorted((begins + lengths - 1) // CORE, begins[first] // CORE + KEPT)))
                need = np.unique(np.concatenate([np.arange(x // CORE, (x + k - 1) // CORE + 1) for x, k in zip(begins[first:last].tolist(), lengths[first:last].tolist(), strict=True)]))
                emit = np.empty((CORE, TAGS, len(need)), np.float32)
                for a in range(0, len(need), BATCH):
                    own = np.empty((CORE, TAGS, min(BATCH, len(need) - a)), np.float32)
                    self.emissions(np.ascontiguousarray(windows[need[a : a + BATCH]].T).astype(np.intp), own)
                    emit[:, :, a : a + BATCH] = own
                at = np.searchsorted(need, begins[first:last] // CORE) * CORE + begins[first:last] % CORE
                tags.append(self.decode(emit, at, lengths[first:last]))
                first = last
        # the stretches' tags, one outside after each
        begun = np.cumsum(lengths + 1) - lengths - 1
        line = np.zeros(int((lengths + 1).sum()), np.int8)
        line[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = np.concatenate(tags)
        edges = np.flatnonzero(np.diff(line, prepend=0, append=0))
        first, last = edges[:-1][line[edges[:-1]] > 0], edges[1:][line[edges[:-1]] > 0]
        own = np.searchsorted(begun, first, "right") - 1
        places = begins[own] + first - begun[own]
        text = np.searchsorted(laid, places, "right") - 1
        start = places - laid[text]
        return list(zip(text.tolist(), start.tolist(), (start + last - first).tolist(), line[first].tolist(), strict=True))


@lru_cache(maxsize=2)
def trained(steps: int = TRAIN_STEPS, seed: int = TRAIN_SEED) -> Tagger:
    """Trains the network on TRAIN_TEXTS made-up labelled texts: `steps` batches, Adam."""
    rng, made = np.random.Generator(np.random.PCG64(seed)), random.Random(seed)
    w = _initial(rng)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    all_symbols, all_tags = np.zeros((TRAIN_TEXTS, TRAIN_WINDOW), np.int64), np.zeros((TRAIN_TEXTS, TRAIN_WINDOW), np.int64)
    for b in range(TRAIN_TEXTS):
        text, spans = labelled_text(made, 14)
        marks = np.zeros(len(text), np.int64)
        for x, y, kind in spans:
            marks[x:y] = KINDS.index(kind) + 1
        skip = made.randrange(0, 24)
        own = classes_of(np.frombuffer(text.encode(), np.uint8))[skip : skip + TRAIN_WINDOW]
        all_symbols[b, : len(own)], all_tags[b, : len(own)] = own, marks[skip : skip + TRAIN_WINDOW]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, TRAIN_TEXTS, TRAIN_BATCH)
        symbols, tags = all_symbols[chosen].T, all_tags[chosen].T
        _, grad = _gradients(w, symbols, tags)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k in w:
            g = grad[k] * min(1.0, 0.5 / (norm + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = (w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Tagger(w)


def plausible(text: str, kind: str) -> bool:
    """Whether a decoded span can be of its kind at all."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return bool(_SPELT.fullmatch(text))
    return {"ip": 4 <= digits <= 12 and len(re.findall("[0-9]+", text)) == 4, "card": 12 <= digits <= 19, "phone": 7 <= digits <= 15}[kind]


def find(raw: np.ndarray, offsets: np.ndarray, tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    lead = (raw & 0xC0) != 0x80
    symbols = _CLASS[raw[lead]]
    bounds = offsets.tolist()
    starts = np.concatenate(([0], np.cumsum([np.count_nonzero(lead[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]))).astype(np.int64)
    hint = (symbols == DIGIT) | (symbols == 6)  # a base span has a digit or @
    texts: dict[int, str] = {}

    def text(i: int) -> str:
        if i not in texts:
            texts[i] = raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        return texts[i]

    out: list[tuple[list[Span], list[Span]]] = [([], []) for _ in range(len(offsets) - 1)]
    for i in [i for i in range(len(out)) if hint[starts[i] : starts[i + 1]].any()]:
        base = base_spans(text(i))
        out[i] = (base, list(base))
    for i, x, y, tag in tagger.tag(symbols, starts):
        kind = KINDS[tag - 1]
        piece = text(i)[x:y]
        x, y = x + len(piece) - len(piece.lstrip()), y - (len(piece) - len(piece.rstrip()))
        if plausible(text(i)[x:y], kind) and not any(s < y and x < e for s, e, _ in out[i][0]):
            out[i][1].append((x, y, kind))
    for base, every in out:
        if len(every) > len(base):
            every.sort(key=_order)
    return out


def _scan(tagger: Tagger) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for a, b in pieces(offsets, PIECE):
                found = find(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], tagger)
                counts = [[sum(s[2] == kind for s in base) for base, _ in found] for kind in KINDS]
                digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([joined(every) for _, every in found], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def detect(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts n_email, n_ip, n_card and n_phone, base_sha256 and all spans of every row.

    Base spans stay as they are; the network's spans are added where they meet no base span. Null
    and empty texts have none; equal texts have equal spans; null and repeated ids are passed on; an
    empty table gives no rows; other columns aren't read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return rows.mapInArrow(_scan(tagger or trained()), schema).withColumnRenamed("id", "doc_id")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (the first of overlapping ones) replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])
