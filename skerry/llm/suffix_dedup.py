"""Suffix-array dedup: remove what a 100-byte string repeats from earlier on.

Every byte that is covered by a 100-byte string which also starts earlier (in a
document with a smaller id, or further up in the same one) is removed.

Suffixes are not shuffled one by one.  A window of 100 bytes has an anchor: the
21-byte string in it with the smallest hash, the leftmost of equals.  Equal
windows have equal anchors at equal places, so windows meet by their anchors, and
consecutive windows of one anchor travel as one row, a run.  Hashes only say what
meets; bytes are compared before anything is removed:

1. within a batch of texts the runs of equal anchors are sorted as suffixes; of
   equal runs the earliest stays, the others repeat it whole.  So copies by the
   thousand send few rows;
2. runs whose anchor is left more than once get their bytes and meet again, and are
   sorted in the same way; of those that differ, all windows are sorted;
3. an anchor with more than ``HOT`` runs is split: its runs are cut into parts where the
   anchor's place in the window passes a multiple of ``BLOCKS[0]``, and meet by the anchor
   and by the bytes that all windows of such a part share.  Where these are still more
   than ``HOT``, as where a passage stands in as many different texts, they are compared
   some thousand at a time: a part that repeats an earlier one whole is done with, the
   others are cut to the next of ``BLOCKS`` and meet again.  Each time the parts that reach
   beyond the passage go to keys of their own, and those within it become fewer by the
   thousand; of parts of one window the earliest is a minimum by their bytes.  Keys that
   very many runs share are dealt out by document first, and come together by sixteens.
   So no group is held or compared whole, whatever its size.

The sort is deep-shallow: a multikey quicksort to a shallow depth, then blind tries
for the groups with longer common prefixes; equal neighbours repeat the earliest.

Defined cases: a null text is empty; a null ``doc_id`` comes before all others;
what starts at the same place of the same ``doc_id`` is not earlier, so rows that
repeat an id and text keep what no other place has, and get the same result; other
texts of the same id get their own; texts under 100 bytes lose nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, materialize, partitions, read_table, slices

LENGTH = 100
GRAM = 21
SHALLOW = 24
#: An anchor with more runs than this is split by what stands around it.
HOT = 1_000
#: Windows of a part, from round to round.
BLOCKS = (20, 10, 5, 2, 1)
#: A key gets a salt for so many times HOT rows; salts come together by MERGED.
DEALT, MERGED = 8, 16
#: Bytes of text whose runs are compared within a batch.
SLICE = 4_000_000
NO_ID = -(1 << 63)
_B1 = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Roller:
    """Hashes of any substrings of a buffer, from prefix sums modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        n = len(data) + 1
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = max(n, 1 << 16)
            one = np.ones(size, np.uint64)
            up, down = one.copy(), one.copy()
            up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
            self._powers[base] = (np.cumprod(up), np.cumprod(down))
        self.up, self.down = (p[:n] for p in self._powers[base])
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def anchored(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text index, first start, last start (both in
    the text), anchor's place, anchor hash."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, none.astype(np.uint64)
    one = Roller(data, _B1)
    h = one.hashes(slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))
    # the hash's upper half and the place: a minimum is the leftmost of the smallest
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    places, reach = length - gram + 1, 1
    while 2 * reach <= places:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < places:
        low = np.minimum(low[: -(places - reach)], low[places - reach:])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
    owner = np.repeat(np.arange(len(texts)), sizes)[:n]
    inside = np.arange(n) + length <= first[owner + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    start = np.flatnonzero(new & inside)
    stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
    at, text = anchor[start], owner[start]
    base = first[text]
    return text, start - base, stop - base, at - base, h[at]


#: place of a run (kind 0): the anchor's place, how far before it the first window starts,
#: and how many more there are, 8 bits each; of a span (kind 1): start and end, 32 bits each.
ROWS = "kind byte, anchor long, doc long, sig int, place long"
SPANS = "doc long, sig int, start long, stop long"


def _batch(kind: int, anchor: np.ndarray, doc: np.ndarray, sig: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    columns = [np.full(len(doc), kind, np.int8), anchor, doc, sig, place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "anchor", "doc", "sig", "place"])


def merged(doc: np.ndarray, sig: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of intervals of each document and text."""
    if not len(doc):
        return doc, sig, start, end
    order = np.lexsort((start, sig, doc))
    doc, sig, start, end = doc[order], sig[order], start[order], end[order]
    group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (sig[1:] != sig[:-1]))])
    shift = group * (int(end.max()) + 1)  # one running maximum for all documents
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], sig[new], start[new], (reach - shift)[last]


def _later(leads: np.ndarray, doc: np.ndarray, sig: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order, each behind the one that leads its group of equals: which
    start later than that one, and which repeat its very document, text and place."""
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))
    same = (doc == doc[lead]) & (start == start[lead])
    return ~same, same & ~leads & (sig == sig[lead])


def _settled_runs(data: bytes, place: np.ndarray, bucket: np.ndarray, doc: np.ndarray, sig: np.ndarray, start: np.ndarray, stop: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the runs that repeat an earlier one whole, and of those that stay.
    bucket: equal for runs that have their anchor at one place and are of one length.
    Runs are equal if their first windows are, and their last ones."""
    first, words = np.lexsort((sig, start, doc)), words_of(data)
    order, equal = deep_shallow_sort(data, place[first], bucket[first], length, words=words)
    order = first[order]
    again, equal = deep_shallow_sort(data, (place + stop - start)[order], np.cumsum(~equal), length, words=words)
    order = order[again]
    later, copy = _later(~equal, doc[order], sig[order], start[order])
    return order[later], order[~later & ~copy]


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """A number for each distinct row of keys."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def segments(texts: list[bytes], length: int, limit: int = SLICE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text's index, first byte, bytes), each of about ``limit`` bytes in
    all.  Long texts are cut so that each window is in one segment."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), limit):
            held.append((i, at, t[at:at + limit + length - 1]))
            size += len(held[-1][2])
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            docs, sigs = b.column("doc").to_numpy(), b.column("sig").to_numpy()
            for held in segments([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()], length):
                yield from _runs_of(held, docs, sigs, length)

    return run


def _runs_of(held: list[tuple[int, int, bytes]], docs: np.ndarray, sigs: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    text, start, stop, at, anchor = anchored([t for *_, t in held], length)
    if not len(text):
        return
    offset = np.concatenate([[0], np.cumsum([len(t) for *_, t in held])])[text]
    place, anchor = offset + start, anchor.view(np.int64)
    base = np.array([a for _, a, _ in held], np.int64)[text]
    own = np.array([i for i, *_ in held])[text]
    doc, sig, start, stop, at = docs[own], sigs[own], start + base, stop + base, at + base
    bucket = _numbered(anchor, at - start, stop - start)
    several = np.bincount(bucket)[bucket] > 1
    some = np.flatnonzero(several)
    gone, stay = _settled_runs(b"".join([t for *_, t in held]), place[some], bucket[some], doc[some], sig[some], start[some], stop[some], length)
    gone, stay = some[gone], np.concatenate([np.flatnonzero(~several), some[stay]])
    yield _batch(0, anchor[stay], doc[stay], sig[stay], (at << 16 | (at - start) << 8 | stop - start)[stay])
    d, g, s, e = merged(doc[gone], sig[gone], start[gone], stop[gone] + length)
    yield _batch(1, d * 0x9E3779B1 % 1000003, d, g, s << 32 | e)


# -- deep-shallow suffix sorting ------------------------------------------------------


def words_of(data: bytes) -> np.ndarray:
    """Eight bytes from each place of ``data`` on, as big-endian numbers; zeros behind its end."""
    padded = data + b"\0" * 16
    out = np.empty(len(data) + 8, np.uint64)
    for i in range(8):
        own = out[i::8]
        own[:] = np.frombuffer(padded, ">u8", len(own), i)
    return out


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within their buckets up to ``depth`` bytes, and group
    numbers: suffixes that agree so far share one.

    Ternary partition by a pivot's key, all groups at once: a group becomes what is
    less, equal and greater; what is equal goes on with the next key.  A key is
    eight bytes, as a number.  Equal suffixes keep their given order."""
    n = len(starts)
    order = np.argsort(bucket, kind="stable")
    new = np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]) if n else np.zeros(0, bool)
    deep = np.zeros(n, np.int64)  # at a group's first place: bytes in which it agrees
    while True:
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, n))
        open_ = (size > 1) & (deep[cut] < depth)
        if not open_.any():
            return order, np.cumsum(new) - 1
        cut, size = cut[open_], size[open_]
        group = np.repeat(np.arange(len(cut)), size)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = cut[group] + np.arange(len(group)) - begin[group]
        key = words[starts[order[place]] + deep[cut][group]]
        pivot = key[begin + size // 2][group]
        side = (key > pivot).astype(np.int64) - (key < pivot)
        target = np.empty(len(group), np.int64)
        level, done = deep[cut], cut.copy()  # done: where the next side of each group begins
        for v in (-1, 0, 1):
            on = side == v
            count = np.bincount(group[on], minlength=len(cut))
            rank = np.cumsum(on) - on
            target[on] = (done[group] + rank - rank[begin][group])[on]
            some = np.flatnonzero(count)
            new[done[some]] = True
            deep[done[some]] = level[some] + (0 if v else 8)
            done = done + count
        order[target] = order[place]


class _Node:
    __slots__ = ("skip", "children", "suffix")

    def __init__(self, skip: int, suffix: int) -> None:
        self.skip, self.suffix = skip, suffix  # skip: the byte that branches, the limit for leaves
        self.children: dict[int, _Node] | None = None


def blind_trie_order(data: bytes, starts: list[int], depth: int, limit: int) -> tuple[list[int], list[int]]:
    """Order of suffixes that agree in ``depth`` bytes, compared up to ``limit``, and
    the common prefix of each with the one before it.  The trie keeps branching
    bytes alone: a suffix goes down blindly, is compared once with the leaf that it
    reaches, and is put in where they part.  Equal suffixes keep their given order."""
    root: _Node | None = None
    equal: dict[int, list[int]] = {}
    numbers = [int.from_bytes(data[s + depth:s + limit]) for s in starts]  # bytes part where numbers first differ
    for i, s in enumerate(starts):
        if root is None:
            root = _Node(limit, i)
            equal[i] = [i]
            continue
        node = root
        while node.children is not None:
            node = node.children.get(data[s + node.skip]) or next(iter(node.children.values()))
        o = starts[node.suffix]
        common = limit - ((numbers[i] ^ numbers[node.suffix]).bit_length() + 7) // 8
        if common == limit:
            equal[node.suffix].append(i)
            continue
        equal[i] = [i]
        parent, node, byte = None, root, 0
        while node.children is not None and node.skip < common:
            parent, byte = node, data[s + node.skip]
            node = node.children[byte]
        if node.children is not None and node.skip == common:
            node.children[data[s + common]] = _Node(limit, i)
            continue
        fork = _Node(common, i)
        fork.children = {data[o + common]: node, data[s + common]: _Node(limit, i)}
        if parent is None:
            root = fork
        else:
            parent.children[byte] = fork
    order: list[int] = []
    common_with_last: list[int] = []
    stack: list[tuple[_Node, int]] = [(root, depth)] if root else []
    while stack:
        node, common = stack.pop()
        if node.children is None:
            same = equal[node.suffix]
            order += same
            common_with_last += [common] + [limit] * (len(same) - 1)
        else:
            parts = sorted(node.children.items())
            stack += [(child, node.skip if j else common) for j, (_, child) in reversed(list(enumerate(parts)))]
    return order, common_with_last


def deep_shallow_sort(data: bytes, starts: np.ndarray, bucket: np.ndarray, limit: int, shallow: int = SHALLOW, words: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes within their buckets up to ``limit`` bytes, and whether each
    equals the one before it.  Equal suffixes keep their given order.  words: those of
    ``data``, if they are there already."""
    words = words_of(data) if words is None else words
    shallow = min(shallow, limit // 8 * 8)
    order, group = multikey_quicksort(words, starts, bucket, shallow)
    equal = np.concatenate([[False], group[1:] == group[:-1]]) if len(group) else np.zeros(0, bool)
    # groups whose suffixes all go on alike need no trie
    alike = equal.copy()
    at = np.flatnonzero(alike)
    for d in range(shallow, limit, 8):
        if not len(at):
            break
        d = min(d, limit - 8)
        differ = words[starts[order[at]] + d] != words[starts[order[at - 1]] + d]
        alike[at[differ]] = False
        at = at[~differ]
    broken = np.unique(group[equal & ~alike])
    equal &= alike
    if len(broken):
        lo, hi = np.searchsorted(group, broken), np.searchsorted(group, broken, side="right")
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            members = order[a:b]
            sub, common = blind_trie_order(data, starts[members].tolist(), shallow, limit)
            order[a:b] = members[sub]
            equal[a:b] = np.array(common) >= limit
            equal[a] = False
    return order, equal


#: Rows that meet by ``anchor`` and ``salt``.  block: windows of a part at most, 0 for whole
#: runs; salts: how many the key is dealt out to; origin: the anchor's own hash.
PARTS = "anchor long, salt int, salts int, block int, origin long, doc long, sig int, place long, bytes binary"
_PARTS = pa.schema([("anchor", pa.int64()), ("salt", pa.int32()), ("salts", pa.int32()), ("block", pa.int32()), ("origin", pa.int64()), ("doc", pa.int64()), ("sig", pa.int32()), ("place", pa.int64()), ("bytes", pa.binary())])
#: What a round finds: a span, or, where ``start`` is null, a part that must meet others.
FOUND = f"start long, stop long, {PARTS}"
_FOUND = pa.schema([("start", pa.int64()), ("stop", pa.int64()), *_PARTS])


def _salted(doc: np.ndarray, salts: np.ndarray) -> np.ndarray:
    return (doc.astype(np.uint64) * np.uint64(_B1) >> np.uint64(33)).astype(np.int64) % salts


def _divided(origin: list[int], block: list[int], data: list[bytes], lo: list[int], hi: list[int], at: list[int], length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(row, key, first window, last window, bytes) of the parts of rows, each a part for
    each block of places that the anchor has in its windows; the key is of the anchor and
    of the bytes that all windows of such a block share."""
    for i, (o, width, b, first, last, a) in enumerate(zip(origin, block, data, lo, hi, at, strict=True)):
        for k in range((a - last) // width, (a - first) // width + 1):
            x, y = max(first, a - k * width - width + 1), min(last, a - k * width)
            shared = b[a - k * width - first : a - k * width - width + 1 + length - first]
            yield i, xxhash.xxh64_intdigest(shared, (o + k) & _MASK) - (1 << 63), x, y, b[x - first : y + length - first]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, sorted by anchor, of anchors that have several, and whether these are more
    than HOT; no more than HOT rows of an anchor are held."""
    held: list[pa.RecordBatch] = []
    seen: tuple[int | None, bool] = None, False  # the last anchor, and whether it is known to be hot

    def told(rows: pa.RecordBatch, hot: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(hot)], [*rows.schema.names, "hot"])

    def judged(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal seen
        (b,) = rows.combine_chunks().to_batches()
        anchor = b.column("anchor").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        counts = np.diff(starts, append=len(anchor))
        hot = (counts > HOT) | ((anchor[starts] == seen[0]) & seen[1] if seen[0] is not None else np.zeros(len(starts), bool))
        done = len(anchor) if last else int(starts[-1])
        if not last and hot[-1]:
            done = len(anchor)  # what follows of a hot anchor need not wait
        keep = np.repeat((counts > 1) | hot, counts)[:done] | (b.column("kind").to_numpy()[:done] == 1)
        seen = int(anchor[-1]), bool(hot[-1])
        if done:
            yield told(b.slice(0, done), np.repeat(hot, counts)[:done]).filter(pa.array(keep))
        held[:] = [b.slice(done)] if done < len(anchor) else []

    for b in batches:
        if b.num_rows:
            held.append(b)
            yield from judged(pa.Table.from_batches(held), False)
    if held:
        yield from judged(pa.Table.from_batches(held), True)


def _cut_contexts(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            runs = b.column("runs")
            text = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
            anchor, place, salts = (runs.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("anchor", "place", "salts"))
            doc, sig = (b.column(c).to_numpy()[text] for c in ("doc", "sig"))
            at = place >> 16
            start = at - (place >> 8 & 255)
            stop = start + (place & 255)
            pieces = [texts[i][x:y] for i, x, y in zip(text.tolist(), start.tolist(), (stop + length).tolist(), strict=True)]
            hot = salts > 0
            block = np.where(hot, BLOCKS[0], 0)
            yield _parts_batch(anchor, np.maximum(salts, 1), block, anchor, doc, sig, start, stop, at, pieces, hot, length)

    return run


def _parts_batch(key: np.ndarray, salts: np.ndarray, block: np.ndarray, origin: np.ndarray, doc: np.ndarray, sig: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, pieces: list[bytes], cut: np.ndarray, length: int, schema: pa.Schema = _PARTS) -> pa.RecordBatch:
    """Rows of PARTS, or of FOUND, those of ``cut`` divided by their blocks."""
    stay, some = np.flatnonzero(~cut), np.flatnonzero(cut)
    new = [*_divided(origin[some].tolist(), block[some].tolist(), [pieces[i] for i in some.tolist()], start[some].tolist(), stop[some].tolist(), at[some].tolist(), length)]
    own, keys, lo, hi = np.array([x[:4] for x in new], np.int64).reshape(-1, 4).T
    row = np.concatenate([stay, some[own]])
    start, stop = np.concatenate([start[stay], lo]), np.concatenate([stop[stay], hi])
    columns = {
        "anchor": np.concatenate([key[stay], keys]), "salt": _salted(doc[row], salts[row]), "salts": salts[row], "block": block[row], "origin": origin[row],
        "doc": doc[row], "sig": sig[row], "place": at[row] << 16 | (at[row] - start) << 8 | stop - start,
    }
    arrays = {n: pa.array(c, _PARTS.field(n).type) for n, c in columns.items()} | {"bytes": pa.array([*(pieces[i] for i in stay.tolist()), *(x[4] for x in new)], pa.binary())}
    none = pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([arrays.get(n, none) for n in schema.names], schema=schema)


def bounded_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of rows sorted by anchor and salt, and which of their rows are of a group
    with more than HOT rows; such a group may come in several tables, others do not."""
    held: list[pa.RecordBatch] = []
    hot_key = None

    def keys(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return t.column("anchor").to_numpy(), t.column("salt").to_numpy()

    def judged(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        anchor, salt = keys(t)
        starts = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
        counts = np.diff(starts, append=len(anchor))
        hot = counts > HOT
        hot[0] |= (anchor[0], salt[0]) == hot_key
        return t, np.repeat(hot, counts)

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b])
        anchor, salt = keys(t)
        last = anchor[-1], salt[-1]
        other = np.flatnonzero((anchor != last[0]) | (salt != last[1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield judged(t.slice(0, cut))
        if t.num_rows - cut > HOT or last == hot_key:
            hot_key = last
            yield judged(t.slice(cut))
            held = []
        else:
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield judged(pa.Table.from_batches(held))


def _sorted_windows(length: int) -> Callable:
    """Rows of FOUND of parts sorted by key and salt."""
    following = dict(zip(BLOCKS, (*BLOCKS[1:], BLOCKS[-1]), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, hot in bounded_groups(batches):
            key, salt, salts, block, origin, doc, sig, place = (t.column(c).to_numpy() for c in ("anchor", "salt", "salts", "block", "origin", "doc", "sig", "place"))
            at = place >> 16
            start = at - (place >> 8 & 255)
            stop = start + (place & 255)
            pieces = t.column("bytes").to_pylist()
            data = b"".join(pieces)
            offset = np.concatenate([[0], np.cumsum(stop - start + length)[:-1]])
            gone, stay = _settled_runs(data, offset, _numbered(key, salt, at - start, stop - start), doc, sig, start, stop, length)
            whole = (doc[gone], sig[gone], start[gone], stop[gone] + length)
            on = hot | (salts > 1)
            pending = stay[on[stay]]
            if len(pending):
                cut = hot[pending] & (block[pending] > 1)
                width = np.where(cut, np.vectorize(lambda n: following.get(n, n), otypes=[np.int64])(block[pending]), block[pending])
                less = np.where(cut, salts[pending], -(-salts[pending] // MERGED))
                yield _parts_batch(key[pending], less, width, origin[pending], doc[pending], sig[pending], start[pending], stop[pending], at[pending], [pieces[i] for i in pending.tolist()], cut, length, _FOUND)
            stay = stay[~on[stay]]
            # windows of the anchors that have several runs left
            number = _numbered(key, salt)
            stay = stay[np.bincount(number[stay], minlength=len(number) + 1)[number[stay]] > 1]
            counts = (stop - start + 1)[stay]
            row = np.repeat(stay, counts)
            step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            first = np.lexsort((sig[row], start[row] + step, doc[row]))  # the earliest of equals comes first
            row, step = row[first], step[first]
            place = start[row] + step
            # equal windows have their anchor at the same place
            order, equal = deep_shallow_sort(data, offset[row] + step, number[row] * (length + 1) + at[row] - place, length)
            row, place = row[order], place[order]
            later, _ = _later(~equal, doc[row], sig[row], place)
            row, place = row[later], place[later]
            d, g, s, e = merged(*(np.concatenate(x) for x in zip(whole, (doc[row], sig[row], place, place + length), strict=True)))
            spans = {"doc": pa.array(d), "sig": pa.array(g, pa.int32()), "start": pa.array(s), "stop": pa.array(e)}
            yield pa.RecordBatch.from_arrays([spans.get(f.name, pa.nulls(len(d), f.type)) for f in _FOUND], schema=_FOUND)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, sig, start, stop): byte intervals of ``docs`` (doc, sig, text) to be
    removed; they may overlap."""
    tasks = partitions(docs)
    runs = arrow_map(docs, _runs(length), ROWS).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    judged = materialize(arrow_map(runs, _met, f"{ROWS}, hot boolean"), "repeats")
    shared = judged.where("kind = 0 AND hot").groupBy("anchor").agg((F.floor(F.count("*") / (DEALT * HOT)) + 1).cast("int").alias("salts"))
    several = judged.where("kind = 0").join(shared, "anchor", "left").withColumn("salts", F.coalesce("salts", F.lit(0)))
    several = several.groupBy("doc", "sig").agg(F.collect_list(F.struct("anchor", "place", "salts")).alias("runs"))
    parts = arrow_map(docs.join(several, ["doc", "sig"]).select("doc", "sig", "text", "runs"), _cut_contexts(length), PARTS)
    found = judged.where("kind = 1").select("doc", "sig", F.shiftrightunsigned("place", 32).alias("start"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).alias("stop"))
    while True:
        met = parts.repartition(tasks, "anchor", "salt").sortWithinPartitions("anchor", "salt")
        told = materialize(arrow_map(met, _sorted_windows(length), FOUND), "spans")
        found = found.unionByName(told.where("start IS NOT NULL").select("doc", "sig", "start", "stop"))
        pending = told.where("start IS NULL").drop("start", "stop")
        if pending.isEmpty():
            return found
        found = found.unionByName(_later_windows(pending.where("block = 1"), length))
        parts = pending.where("block > 1")


def _later_windows(windows: DataFrame, length: int) -> DataFrame:
    """Spans of single windows that also start earlier, by a minimum of each window's
    bytes, which combines before it is shuffled, and a join that streams."""
    start = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    rows = windows.select("bytes", "doc", "sig", start.alias("start"))
    first = rows.groupBy("bytes").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = rows.join(first, "bytes").where(F.struct("doc", "start") > F.col("first"))
    return later.select("doc", "sig", "start", (F.col("start") + length).alias("stop"))


def _report(keep_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for doc, text, spans in zip(b.column("doc").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                text, kept, at, removed, n = text or b"", [], 0, 0, 0
                if spans:
                    s, e = (np.array([x[k] for x in spans], np.int64) for k in ("start", "stop"))
                    zero = np.zeros(len(s), np.int64)
                    *_, s, e = merged(zero, zero, s, e)
                    for x, y in zip(s.tolist(), e.tolist(), strict=True):
                        kept.append(text[at:x])
                        at, removed, n = y, removed + y - x, n + 1
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((None if doc == NO_ID else doc, len(text), removed, n, hashlib.sha256(left).hexdigest(), left if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """One row a document: sizes, the digest of what is kept, and the bytes kept.
    Texts are shuffled once: both joins with them deal them out alike."""
    sig = F.hash(F.coalesce("text", F.lit("")))  # rows of one id with other texts have spans of their own
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), sig.alias("sig"), "text")
    by_doc = repeated_spans(rows, length).groupBy("doc", "sig").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(by_doc, ["doc", "sig"], "left").select("doc", "text", "spans")
    return arrow_map(joined, _report(keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read_table(spark, sf_dir, "documents"), keep_text=False).drop("kept")
