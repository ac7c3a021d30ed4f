"""Removal of repeated passages, exact to the byte (operator 4).

A string of LENGTH bytes is removed where it also starts in a document of smaller id. Documents are
dealt into batches, the shards of the text. Every string holds an anchor, its GRAM bytes of least
hash, so equal strings hold equal anchors at equal places. (1) Each batch lists its anchors' hashes;
(2) those that several documents have are kept: no other string can repeat; (3) each batch builds the
suffix array, with Kasai's common prefixes, of all its stretches with kept anchors: suffixes that
share LENGTH bytes are one string, and where a smaller id of the batch has it, that is settled. What
is open is cut into contexts, the bytes of an anchor's strings, which go to the anchor's number; (4)
there the batches' sorted contexts are merged into one another by binary search, and where several
contexts of an anchor are left, their suffix array tells which strings are equal; the least id
decides; (5) the verdicts return to the batches.

Lists and hashes only say where to look; that two strings are one is always told by their bytes
(whole copies of a text: by SHA-256). An anchor that FREQUENT batches have is replaced by one of LONG
bytes, of which far fewer strings hold the same, and its contexts are merged within groups of batches
first, so that what all batches repeat reaches its number once a group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import broadcast_checked, cut, pieces, text_buffer
from lodestar.llm.shingles import mixed
from lodestar.llm.suffixes import common_prefixes, suffix_order, words8

LENGTH, GRAM, LONG = 50, 24, 40
STRINGS = LENGTH - GRAM + 1
#: Bytes of text in a batch, on average, and for a shard.
BATCH_BYTES = 4 << 20
#: An anchor of this many batches is very frequent.
FREQUENT = 64
#: Bytes whose anchors are looked for at once (longer documents come in stretches), and of one suffix array.
STRETCH, ARRAY = 1 << 19, 4 << 20
#: Contexts that are put into sorted order, or into keys, at once.
RUN = 1 << 14
_WIDTH = LENGTH + STRINGS - 1


def gram_hashes(words: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of the `size` bytes (a multiple of eight) at the places, or at each but the last size - 1, from their eight-byte words."""
    step = (lambda k: words[k : k + max(0, len(words) - size + 1)]) if at is None else (lambda k: words[at + k])
    out = step(0) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(8, size, 8):
        out = mixed(out + mixed(step(k)))
    return mixed(out)


def least_grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """For every string's start: the place of its gram of least hash (of equal ones the first)."""
    n, wide = len(hashes) + size - LENGTH, LENGTH - size + 1
    low = np.uint64((1 << 24) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return (np.minimum(least[:n], least[wide - width : wide - width + n]) & low).astype(np.int64)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings within the documents: place, first and last string's start, hash."""
    n = len(raw) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(words8(raw), GRAM)
    at = least_grams(hashes, GRAM)
    # no string starts in a document's last LENGTH - 1 bytes
    edge = np.zeros(len(raw) + 1, np.int32)
    edge += np.bincount(np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1), minlength=len(edge)).astype(np.int32)
    edge -= np.bincount(offsets[1:], minlength=len(edge)).astype(np.int32)
    starts = np.flatnonzero(np.cumsum(edge[:n]) == 0)
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = at[starts]
    first = np.concatenate(([True], at[1:] != at[:-1]))
    begin = np.flatnonzero(first)
    last = np.append(begin[1:], len(starts)) - 1
    return at[begin], starts[begin], starts[last], hashes[at[begin]]


def stretches(table: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """ids, [(bytes, offsets, row, base) ...], all bytes and offsets of a batch (batch, id, text).

    Rows are put in the order of id and text, the same whenever the batch is read. A long document
    comes in stretches that overlap by LENGTH - 1 bytes, so that each string is in just one."""
    ids = table.column("id").to_numpy()
    texts = table.column("text").combine_chunks()
    order = np.argsort(ids, kind="stable")
    if len(np.unique(ids)) < len(ids):
        strings = texts.to_pylist()
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], strings[i])), np.int64)
    ids = ids[order]
    raw, offsets = text_buffer(texts.take(pa.array(order)))
    parts = []
    for a, b in pieces(offsets, STRETCH):
        own = raw[offsets[a] : offsets[b]]
        if b - a > 1 or len(own) <= STRETCH:
            parts.append((own, offsets[a : b + 1] - offsets[a], np.arange(a, b), np.zeros(b - a, np.int64)))
        else:
            for base in range(0, max(1, len(own) - LENGTH + 1), STRETCH):
                some = own[base : base + STRETCH + LENGTH - 1]
                parts.append((some, np.array([0, len(some)]), np.array([a]), np.array([base])))
    return ids, parts, raw, offsets


def gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices of raw, joined."""
    ends = np.cumsum(length)
    return raw[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number and the places that have it."""
    if not len(shard):
        return
    order = np.argsort(shard, kind="stable")
    heads = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for a, b in zip(heads, np.append(heads[1:], len(order)), strict=True):
        yield int(shard[order[a]]), order[a:b]


def short(hashes: np.ndarray) -> np.ndarray:
    """The bits of hashes that lists hold."""
    return (hashes >> np.uint64(33)).astype(np.uint32)


def list_anchors(shards: int) -> Callable[[pa.Table], pa.Table]:
    """(1) batch to (shard, batch, hashes): its distinct anchors, flagged if several ids have them."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        ids, parts, _, _ = stretches(table)
        hashes, owners = [], []
        for raw, offsets, row, _ in parts:
            at, _, _, own = anchors(raw, offsets)
            hashes.append(own)
            owners.append(ids[row[np.searchsorted(offsets, at, "right") - 1]])
        hashed, owner = np.concatenate(hashes), np.concatenate(owners)
        if not len(hashed):
            return _ANCHORS.empty_table()
        order = np.lexsort((owner, hashed))
        hashed, owner = hashed[order], owner[order]
        head = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1])))
        several = owner[head] != owner[np.append(head[1:], len(owner)) - 1]
        distinct = hashed[head]
        listed = short(distinct) | several * _FLAG
        rows = [{"shard": s, "batch": batch, "hashes": listed[i].tobytes()} for s, i in _by_shard((distinct % np.uint64(shards)).astype(np.int64))]
        return pa.Table.from_pylist(rows, _ANCHORS)

    return run


#: Lists hold 31 bits of a hash and a flag. A shard has some 500,000 anchors at any size of the whole,
#: so one in some thousands is taken for another's; that adds contexts to judge and changes no verdict.
_FLAG = np.uint32(1 << 31)
_ANCHORS = pa.schema([("shard", pa.int64()), ("batch", pa.int64()), ("hashes", pa.binary())])
_KEPT = pa.schema([("batch", pa.int64()), ("shard", pa.int64()), ("hashes", pa.binary())])
#: level 0: verdicts for the batch that is the number; 1: contexts of an anchor's number; 2: contexts
#: of frequent strings for a group of batches, with their numbers; 3: those that are left of a group.
_CONTEXTS = pa.schema([("level", pa.int64()), ("number", pa.int64()), ("batch", pa.int64()), *((n, pa.binary()) for n in ("text", "length", "place", "id", "times", "row", "start", "numbers", "verdicts"))])
_VERDICTS = pa.schema([("batch", pa.int64()), ("verdicts", pa.binary())])
_VERDICT = np.dtype([("row", "<i4"), ("start", "<i4"), ("strings", "<u8")])
#: Of a context that one id has several times, the bytes are sent once with all its places.
_FIELDS = (("length", np.uint8), ("place", np.uint8), ("id", np.int64), ("times", np.int32), ("row", np.int32), ("start", np.int32))


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _blobs(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a binary column joined, and the length of each."""
    raw, offsets = text_buffer(column)
    return np.frombuffer(raw.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


def keep_anchors(table: pa.Table) -> pa.Table:
    """(2) a shard's lists to (batch, shard, hashes): anchors that several documents have, flagged if frequent."""
    listed, sizes = _blobs(table.column("hashes"), np.uint32)
    if not len(listed):
        return _KEPT.empty_table()
    hashes, several = listed & ~_FLAG, listed >= _FLAG
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(hashes, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    count = np.diff(np.append(head, len(hashes)))
    kept = (count > 1) | np.logical_or.reduceat(several[order], head)
    keep, frequent = np.empty(len(hashes), bool), np.empty(len(hashes), bool)
    keep[order], frequent[order] = np.repeat(kept, count), np.repeat(count >= FREQUENT, count)
    left, marked = np.flatnonzero(keep), hashes | frequent * _FLAG
    shard = table.column("shard")[0].as_py()
    rows = [{"batch": table.column("batch")[b].as_py(), "shard": shard, "hashes": marked[left[i]].tobytes()} for b, i in _by_shard(source[left])]
    return pa.Table.from_pylist(rows, _KEPT)


def _verdicts(level: int, batch: int, row: np.ndarray, start: np.ndarray, strings: np.ndarray) -> dict:
    verdict = np.zeros(len(row), _VERDICT)
    verdict["row"], verdict["start"], verdict["strings"] = row, start, strings
    return {"level": level, "number": batch, "batch": batch, "verdicts": verdict.tobytes()}


def _bits(flags: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The flags of each context's strings in turn as one number."""
    upto = np.cumsum(many)
    bit = np.arange(len(flags)) - np.repeat(upto - many, many)
    return np.add.reduceat(flags.astype(np.uint64) << bit.astype(np.uint64), upto - many)


def _spread(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, as many as there are."""
    upto = np.cumsum(many)
    return np.repeat(start - (upto - many), many) + np.arange(upto[-1] if len(upto) else 0)


def string_groups(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A number for the string at each place, the same for equal strings only.

    By the suffix array of the text: suffixes next to each other that share LENGTH bytes are one string."""
    words = words8(text)
    order = suffix_order(text, words)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(common_prefixes(text, order, LENGTH, words) < LENGTH) - 1
    return group[place]


def least_by(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each, the least id of its group."""
    out = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(out, group, ids)
    return out[group]


def _chunks(parts: list, size: int) -> Iterator[list]:
    """Parts of some `size` bytes together."""
    held, total = [], 0
    for part in parts:
        if held and total + len(part[0]) > size:
            yield held
            held, total = [], 0
        held.append(part)
        total += len(part[0])
    if held:
        yield held


def cut_contexts(shards: int, groups: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(3) a batch and its kept anchors to open contexts by number, and verdicts known within the batch.

    Frequent strings go to one of some `shards` numbers at level 2, apart for each of `groups` groups of batches."""
    coarse = max(1, shards // groups)

    def run(table: pa.Table, kept: pa.Table) -> pa.Table:
        if not len(table) or not len(kept):
            return _CONTEXTS.empty_table()
        batch = table.column("batch")[0].as_py()
        marked, sizes = _blobs(kept.column("hashes"), np.uint32)
        known = np.repeat(kept.column("shard").to_numpy(), sizes).astype(np.uint64) << np.uint64(32) | (marked & ~_FLAG)
        order = np.argsort(known)
        known, frequent = known[order], marked[order] >= _FLAG
        ids, parts, _, _ = stretches(table)
        rows: list[dict] = []
        for chunk in _chunks(parts, ARRAY):
            texts, found, end = [], [], 0
            for raw, offsets, row, base in chunk:
                at, first, last, hashed = anchors(raw, offsets)
                asked = (hashed % np.uint64(shards)) << np.uint64(32) | short(hashed)
                slot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                own = known[slot] == asked
                if not own.any():
                    continue
                at, first, last, hashed, often = at[own], first[own], last[own], hashed[own], frequent[slot[own]]
                # stretches of strings with kept anchors, joined
                head = np.flatnonzero(np.concatenate(([True], first[1:] != last[:-1] + 1)))
                tail = np.append(head[1:], len(first)) - 1
                size = last[tail] - first[head] + LENGTH
                texts.append(gather(raw, first[head], size))
                shift = np.repeat(end + np.cumsum(size) - size - first[head], tail - head + 1)
                end += int(size.sum())
                doc = np.searchsorted(offsets, first, "right") - 1
                found.append([first + shift, last - first + 1, at - first, hashed, often, ids[row[doc]], row[doc], first - offsets[doc] + base[doc]])
            if not texts:
                continue
            text = texts[0] if len(texts) == 1 else np.concatenate(texts)
            begin, many, place, hashed, often, owner, row, where = (np.concatenate(x) for x in zip(*found, strict=True))
            strings = _spread(begin, many)
            whose = np.repeat(np.arange(len(begin)), many)
            groups_of = string_groups(text, strings)
            done = least_by(groups_of, owner[whose]) < owner[whose]
            upto = np.cumsum(many)
            same = _numbered(groups_of[upto - many], groups_of[upto - 1], many, owner)
            settled = _bits(done, many)
            hit = np.flatnonzero(settled)
            if len(hit):
                rows.append(_verdicts(0, batch, row[hit], where[hit], settled[hit]))
            open_ = settled != (np.uint64(1) << many.astype(np.uint64)) - np.uint64(1)
            rows += _rows(1, batch, text, *(x[open_ & ~often] for x in (begin, many, place, owner, row, where)), (hashed[open_ & ~often] % np.uint64(shards)).astype(np.int64), same[open_ & ~often])
            left = np.flatnonzero(often[whose] & ~done)
            if len(left):
                # contexts of the longer anchors, of strings next to each other
                start, own = strings[left], whose[left]
                hashes = gram_hashes(words8(text), LONG)
                at = least_grams(hashes, LONG)[start]
                head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
                many = np.diff(np.append(head, len(start)))
                same = _numbered(groups_of[left[head]], groups_of[left[head + many - 1]], many, owner[own[head]])
                start, own, at = start[head], own[head], at[head]
                number = (hashes[at] % np.uint64(shards)).astype(np.int64)
                group = batch * groups // shards * coarse + number % coarse
                for g, i in _by_shard(group):
                    rows += _rows(2, batch, text, start[i], many[i], at[i] - start[i], owner[own[i]], row[own[i]], (where[own] + start - begin[own])[i], np.full(len(i), g), same[i], number[i])
        return pa.Table.from_pylist(rows, _CONTEXTS)

    return run


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each, the same where all keys are equal. Contexts with equal first and last strings and ids are so told to be the same."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _rows(level: int, batch: int, text: np.ndarray, begin: np.ndarray, many: np.ndarray, place: np.ndarray, owner: np.ndarray, row: np.ndarray, where: np.ndarray, number: np.ndarray, same: np.ndarray, numbers: np.ndarray | None = None) -> Iterator[dict]:
    """A row of contexts for each number; of those that are the same the bytes go once."""
    length = many + LENGTH - 1
    for n, i in _by_shard(number):
        i = i[np.argsort(same[i], kind="stable")]
        head = np.flatnonzero(np.diff(same[i], prepend=-1))
        one = i[head]
        held = {"level": level, "number": n, "batch": batch, "text": gather(text, begin[one], length[one]).tobytes()}
        values = (length[one], place[one], owner[one], np.diff(np.append(head, len(i))), row[i], where[i])
        held |= {name: own.astype(kind).tobytes() for (name, kind), own in zip(_FIELDS, values, strict=True)}
        yield held if numbers is None else held | {"numbers": numbers[one].astype(np.int64).tobytes()}


def _contexts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Bytes, starts and fields of the contexts in a table's rows; the context and batch of each of their places."""
    text, _ = _blobs(table.column("text"), np.uint8)
    fields = {name: _blobs(table.column(name), kind)[0] for name, kind in _FIELDS}
    fields["length"] = fields["length"].astype(np.int64)
    of = np.repeat(np.arange(len(fields["times"])), fields["times"])
    batches = np.repeat(table.column("batch").to_numpy(), _blobs(table.column("row"), np.int32)[1])
    return text, np.cumsum(fields["length"]) - fields["length"], fields, of, batches


def union(into: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Two sorted arrays without repeats merged, by a binary search for each of the second in the first."""
    at = np.searchsorted(into, other)
    new = np.ones(len(other), bool)
    inner = at < len(into)
    new[inner] = into[at[inner]] != other[inner]
    return np.insert(into, at[new], other[new])


def merged(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each context, the same for equal ones only.

    Contexts are made into keys of _WIDTH bytes and their length, which stands last lest a key end in
    zeros. RUN contexts at a time are sorted, and the runs are merged in pairs."""
    keys = np.zeros((len(start), _WIDTH + 1), np.uint8)
    keys[:, _WIDTH] = length
    held = np.concatenate([text, np.zeros(_WIDTH, np.uint8)])
    for a in range(0, len(start), RUN):
        own = held[start[a : a + RUN, None] + np.arange(_WIDTH)]
        own[np.arange(_WIDTH) >= length[a : a + RUN, None]] = 0
        keys[a : a + RUN, :_WIDTH] = own
    keys = keys.reshape(-1).view(f"S{_WIDTH + 1}")
    runs = [np.unique(keys[a : a + RUN]) for a in range(0, len(keys), RUN)]
    while len(runs) > 1:
        runs = [union(runs[i], runs[i + 1]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return np.searchsorted(runs[0], keys)


def premerge(table: pa.Table) -> pa.Table:
    """A group's level-2 contexts to level-3 ones by their own number: those that no smaller id of the group has, and verdicts on the others."""
    text, start, fields, of, batches = _contexts(table)
    numbers, _ = _blobs(table.column("numbers"), np.int64)
    later = (least_by(merged(text, start, fields["length"]), fields["id"]) < fields["id"])[of]
    many = (fields["length"] - LENGTH + 1)[of]
    rows: list[dict] = []
    for b, i in _by_shard(batches):
        gone, left = i[later[i]], i[~later[i]]
        if len(gone):
            rows.append(_verdicts(0, b, fields["row"][gone], fields["start"][gone], (np.uint64(1) << many[gone].astype(np.uint64)) - np.uint64(1)))
        own = of[left]
        rows += _rows(3, b, text, start[own], many[left], fields["place"][own], fields["id"][own], fields["row"][left], fields["start"][left], numbers[own], own)
    return pa.Table.from_pylist(rows, _CONTEXTS)


def judge(table: pa.Table, gram: int) -> pa.Table:
    """(4) a number's contexts to verdicts by batch: which strings start in a smaller id as well."""
    text, start, fields, of, batches = _contexts(table)
    length, ids = fields["length"], fields["id"]
    # merge the batches' contexts: equal ones become one with the least id
    group = merged(text, start, length)
    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
    group[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
    one, least = order[head], np.minimum.reduceat(ids[order], head)
    # anchors with several contexts: equal strings have the least id of all their contexts
    anchor = gram_hashes(words8(text), gram, start[one] + fields["place"][one])
    _, which, count = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.flatnonzero(count[which] > 1)
    many = (length - LENGTH + 1)[one]
    ends = np.cumsum(many)
    minimum = np.repeat(least, many)
    if len(several):
        size = length[one[several]]
        joined = gather(text, start[one[several]], size)
        own = many[several]
        minimum[_spread((ends - many)[several], own)] = least_by(string_groups(joined, _spread(np.cumsum(size) - size, own)), np.repeat(least[several], own))
    # every context's strings against its own id
    own = many[group]
    smaller = _bits(minimum[_spread((ends - many)[group], own)] < np.repeat(ids, own), own)[of]
    rows = []
    for b, i in _by_shard(batches):
        i = i[smaller[i] != 0]
        if len(i):
            rows.append(_verdicts(0, b, fields["row"][i], fields["start"][i], smaller[i]))
    return pa.Table.from_pylist(rows, _CONTEXTS)


def settle(table: pa.Table) -> pa.Table:
    """The rows of one level and number: level 1 and 3 are judged, level 2 is merged, verdicts stay as they are."""
    level = table.column("level")[0].as_py()
    if level == 2:
        return premerge(table)
    return judge(table, GRAM if level == 1 else LONG) if level else table


def covered(table: pa.Table, verdicts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes, offsets of a batch, and which bytes go."""
    ids, _, raw, offsets = stretches(table)
    verdict, _ = _blobs(verdicts.column("verdicts"), _VERDICT) if len(verdicts) else (np.zeros(0, _VERDICT), None)
    gone = np.zeros(len(raw), bool)
    for a in range(0, len(verdict), RUN):
        some = verdict[a : a + RUN]
        which, shift = np.nonzero(some["strings"][:, None] >> np.arange(STRINGS, dtype=np.uint64) & np.uint64(1))
        gone[offsets[some["row"][which]] + some["start"][which] + shift] = True
    # a string's start stands for its LENGTH bytes, which are all in its document
    width = 1
    while width < LENGTH:
        more = min(width, LENGTH - width)
        gone[more:] |= gone[:-more].copy()
        width += more
    return ids, raw, offsets, gone


_REMOVED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def remove(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    """(5) a batch and its verdicts to doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    if not len(table):
        return _REMOVED.empty_table()
    ids, raw, offsets, gone = covered(table, verdicts)
    rows = []
    for i, a, b in zip(ids.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = gone[a:b]
        removed = int(np.count_nonzero(own))
        spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum()) if removed else 0
        rows.append((i, b - a, removed, spans, hashlib.sha256(raw[a:b][~own] if removed else raw[a:b]).hexdigest()))
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _REMOVED.types, strict=True)], schema=_REMOVED)


def kept_texts(table: pa.Table, verdicts: pa.Table) -> pa.Table:
    """(5) a batch and its verdicts to doc_id and the bytes that stay."""
    if not len(table):
        return pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())]).empty_table()
    ids, raw, offsets, gone = covered(table, verdicts)
    rows = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.table({"doc_id": ids, "kept": pa.array(rows, pa.binary())})


def _searched(docs: DataFrame, batch_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows decided without a search, searched rows by batch, verdicts by batch)."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError("ids must be whole numbers")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = rows.filter("id is not null").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    copies = broadcast_checked(cut(copies.select("digest", "first")), 1_000_000)
    size = F.octet_length("text")
    marked = rows.join(copies, "digest", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    searched = (F.octet_length("text") >= LENGTH) & F.col("id").isNotNull() & ~F.col("copy")
    total = rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
    count = max(1, -(-total // batch_bytes))
    batches = marked.filter(searched).select(F.pmod(F.xxhash64("id", "digest"), F.lit(count)).alias("batch"), "id", "text")
    listed = batches.groupBy("batch").applyInArrow(list_anchors(count), _sql(_ANCHORS))
    kept = listed.groupBy("shard").applyInArrow(keep_anchors, _sql(_KEPT))
    # as many batches in a group as groups, but FREQUENT at least
    groups = max(1, min(-(-count // FREQUENT), int(count**0.5)))
    contexts = batches.groupBy("batch").cogroup(kept.groupBy("batch")).applyInArrow(cut_contexts(count, groups), _sql(_CONTEXTS))
    for _ in range(2):
        contexts = contexts.groupBy("level", "number").applyInArrow(settle, _sql(_CONTEXTS))
    verdicts = contexts.select("batch", "verdicts")
    return marked.filter(~searched).select("id", "text", "copy"), batches, verdicts


def repeated_passages(docs: DataFrame, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A text equal to that of a smaller id goes whole if it has LENGTH bytes. Null and empty texts
    have no bytes; texts under LENGTH bytes stay; rows of one id don't count as smaller than each
    other and equal ones have equal results; a row with a null id loses nothing and costs no other
    row anything; an empty table gives no rows; ids that aren't whole numbers raise ValueError. Other
    columns aren't read."""
    decided, batches, verdicts = _searched(docs, batch_bytes, id_col, text_col)
    size = F.octet_length("text").cast("long")
    gone = F.col("copy") & (size >= LENGTH)
    plain = decided.select(
        F.col("id").alias("doc_id"),
        size.alias("n_bytes"),
        F.when(gone, size).otherwise(F.lit(0)).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(F.when(gone, F.lit("")).otherwise(F.col("text")), 256).alias("kept_sha256"),
    )
    rest = batches.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.unionByName(rest)


def without_repeats(docs: DataFrame, batch_bytes: int = BATCH_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the bytes of the text that stay (a passage may begin or end within a character)."""
    decided, batches, verdicts = _searched(docs, batch_bytes, id_col, text_col)
    plain = decided.select(F.col("id").alias("doc_id"), F.when(F.col("copy") & (F.octet_length("text") >= LENGTH), F.lit("")).otherwise(F.col("text")).cast("binary").alias("kept"))
    return plain.unionByName(batches.groupBy("batch").cogroup(verdicts.groupBy("batch")).applyInArrow(kept_texts, "doc_id long, kept binary"))


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int, int, str]]:
    """The same by a table of all strings, for tests."""
    least: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - LENGTH + 1 if i is not None else 0):
            s = t[p : p + LENGTH]
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - LENGTH + 1 if i is not None else 0):
            if least[t[p : p + LENGTH]] < i:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


#: DuckDB's form of repeated_passages(), for unique ids.
PASSAGES_SQL = f"""
WITH t AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, b[i:i + {LENGTH - 1}] AS s FROM (SELECT doc_id, b, unnest(range(1, n - {LENGTH - 2})) AS i FROM t WHERE doc_id IS NOT NULL)),
m AS (SELECT s, min(doc_id) AS least FROM s GROUP BY s HAVING min(doc_id) < max(doc_id)),
h AS (SELECT s.doc_id, s.i FROM s JOIN m ON m.s = s.s AND m.least < s.doc_id),
g AS (SELECT doc_id, i, lag(i) OVER w AS last, lead(i) OVER w AS next FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, sum(least({LENGTH}, coalesce(next - i, {LENGTH})))::BIGINT AS n_removed, count(CASE WHEN last IS NULL OR i > last + {LENGTH} THEN 1 END) AS n_spans FROM g GROUP BY 1),
o AS (SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + {LENGTH} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, min(i) AS x, max(i) + {LENGTH} AS y FROM o GROUP BY doc_id, span),
k AS (SELECT doc_id, coalesce(lag(y) OVER (PARTITION BY doc_id ORDER BY x), 1) AS x, x - 1 AS y FROM spans UNION ALL SELECT doc_id, max(y), max(n) FROM spans JOIN t USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(b[x:y]), '' ORDER BY x) AS kept FROM k JOIN t USING (doc_id) WHERE y >= x GROUP BY doc_id)
SELECT t.doc_id, t.n::BIGINT AS n_bytes, coalesce(r.n_removed, 0)::BIGINT AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN r.doc_id IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(kept.kept, ''))) END AS kept_sha256
FROM t LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
