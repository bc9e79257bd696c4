"""Removal of byte strings that occurred earlier, by merged Burrows-Wheeler transforms (operator 13).

A byte goes if a string of ``WINDOW`` bytes that covers it also starts earlier: in a document of smaller
id, or further up. Transforms of a whole corpus can't be held or merged in one place, so only
stretches that may repeat enter shards, dealt so that equal windows surely meet:

1. Each window has an anchor, its ``GRAM``-byte string of smallest hash; equal windows have equal
   anchors. Blocks of documents tell each share of hashes which anchors they have, once a block, and
   are told which of them stand more than once in the corpus. A whole copy of a text has no own anchors.
2. The windows under such an anchor make a stretch of bytes, dealt by anchor. Equal stretches of one
   block go once, the first of them; the others are repeats as a whole.
3. In a task, equal stretches of an anchor go once. All windows of a stretch differ, and a window reaches half of what
   it has besides the anchor to its left or to its right; so stretches stay out that share neither half with
   another of their anchor (``together``). The others are joined to shards of about ``SHARD`` bytes. A shard's suffixes are ordered once
   (to ``WINDOW`` bytes), which gives its transform. Shards are merged by refining their interleave: from
   the order to ``d`` bytes the transform's symbols of ``g`` bytes give the order to ``d + g``, no suffix
   is sorted again. Borders that a round adds are where the common prefix ends; the runs without border
   after the last round are the repeated intervals. In each, the first window stays.
4. Anchors of more than ``SALTED`` stretches are salted. Windows that are first in their salt go on as pieces: runs of windows
   whose anchor stands in the same of ``PARTS`` parts of them, so that all hold the same bytes around it. Equal windows are in
   pieces that hold the same; where a second salt has such a piece too, its windows meet by a 128-bit digest, one row a salt.
5. Spans go back to their blocks, packed by block, with each document's number in its block; the blocks cut the texts.

Texts are shuffled twice, by block, a hash of the row's id and text; no block holds more than its rows.
Null and empty texts have no bytes. Rows of one id with one text are one document, in one block; rows of one
id with different texts are in order of a hash of the text. Null ids come before all others. Ids are whole
numbers or text. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, small_batches, trim

WINDOW, GRAM = 100, 16
#: Bytes of text in a block, of stretches in a shard and of shards merged at a time, about.
BLOCK, SHARD, MERGED = 4 << 20, 1 << 17, 1 << 20
#: Anchors that a share of hashes has, stretches of an anchor without salts, about.
SHARE, SALTED = 500_000, 4096
#: Parts of a window by where its anchor stands: more of them are more pieces, but fewer windows that meet.
PARTS = 4
_FIRST = -(1 << 63)
#: Bits of a position within what is hashed or merged at a time.
_PLACE = 21


def _mixed(h: np.ndarray, eight: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ eight) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _hashed(text: bytes, gram: int) -> np.ndarray:
    """A hash of each ``gram``-byte string of a text."""
    n = len(text) - gram + 1
    eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,)).copy()
    h = np.zeros(n, np.uint64)
    for j in range(0, gram, 8):
        h = _mixed(h, eight[j : j + n])
    return h


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in order: their hashes, first window and number of windows."""
    hashes, starts, counts = [], [], []
    wide, step = window - gram + 1, 1 << (_PLACE - 1)
    for at in range(0, len(text) - window + 1, step):
        part = text[at : at + step + window - 1]
        h = _hashed(part, gram)
        n, low = len(h), np.uint64((1 << _PLACE) - 1)
        least, reach = (h & ~low) | np.arange(n, dtype=np.uint64), 1
        while 2 * reach <= wide:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < wide:
            least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hashes.append(h[place[first]])
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(place))))
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in ((hashes, np.uint64), (starts, np.int64), (counts, np.int64)))


def _steps(window: int) -> list[int]:
    """Bytes that each round adds to the order: doubled up to the window."""
    out = [min(4, window)]
    while sum(out) < window:
        out.append(min(sum(out), window - sum(out)))
    return out


def _symbols(text: np.ndarray, size: int) -> np.ndarray:
    """The (up to four) bytes at each place of a cyclic text as a number."""
    out = np.zeros(len(text), np.uint64)
    for j in range(size):
        out = out << np.uint64(8) | np.roll(text, -j)
    return out


class Shard:
    """A cyclic text and the order of its suffixes, to ``window`` bytes."""

    def __init__(self, text: bytes, window: int = WINDOW) -> None:
        self.text = np.frombuffer(text, np.uint8).astype(np.uint64)
        n, steps = len(text), _steps(window)
        bits, places = np.uint64(_PLACE), np.arange(n, dtype=np.uint64)
        key, depth = np.sort(_symbols(self.text, steps[0]) << bits | places), steps[0]
        for step in steps[1:]:
            order, head = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64), key >> bits
            rank = np.zeros(n, np.uint64)
            rank[order] = np.cumsum(np.concatenate(([False], head[1:] != head[:-1])), dtype=np.uint64)
            # what is ordered to ``depth`` bytes, at two places, orders ``step`` bytes more
            key = np.sort((rank << bits | np.roll(rank, -step)) << bits | places)
            depth += step
        self.order = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)

    def before(self, of_place: np.ndarray, step: int) -> np.ndarray:
        """The transform: for each suffix in order what stands ``step`` bytes before it."""
        return of_place[(self.order - step) % len(self.order)]


def merged(shards: list[Shard], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes: shard and place of each, and the length of the common prefix
    with the suffix before, as far as rounds tell (``window`` or more: ``window``)."""
    sizes = [len(s.order) for s in shards]
    bits, low = np.uint64(_PLACE + 4), np.uint64((1 << (_PLACE + 4)) - 1)
    total, offsets = sum(sizes), np.concatenate(([0], np.cumsum(sizes)))
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    group, common = np.zeros(total, np.int64), np.full(total, window, np.int64)
    depth, at = 0, np.arange(total)
    for step in _steps(window):
        if depth == 0:
            codes = [_symbols(s.text, step) for s in shards]
        else:
            # the groups of the interleave number what is equal to ``depth`` bytes; a shorter step takes the same
            own = np.empty(total, np.int64)
            own[at] = group
            codes = []
            for s, a, b in zip(shards, offsets[:-1], offsets[1:], strict=True):
                of_place = np.empty(b - a, np.uint64)
                of_place[s.order] = own[a:b]
                codes.append(of_place)
        symbols = np.concatenate([s.before(c, step) for s, c in zip(shards, codes, strict=True)])[at]
        key = np.sort(symbols << bits | np.arange(total, dtype=np.uint64))
        moved, symbol = (key & low).astype(np.int64), key >> bits
        source, came = source[moved], group[moved]
        border = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (came[1:] != came[:-1])))
        common[border & (common == window)] = depth
        group, depth = np.cumsum(border) - 1, depth + step
        # the next suffix of each shard, in the interleave's order
        at = np.empty(total, np.int64)
        at[np.argsort(source, kind="stable")] = np.arange(total)
    place = np.concatenate([s.order for s in shards])[at]
    return source, place, common


def repeated(stretches: list[bytes], group: list[int], window: int = WINDOW, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches in order, the windows (stretch, place) that stand before within the same group."""
    texts, held, size = [], [], 0
    for s in stretches:
        held.append(s)
        size += len(s)
        if size >= shard:
            texts.append(b"".join(held))
            held, size = [], 0
    if held:
        texts.append(b"".join(held))
    source, place, common = merged([Shard(t, window) for t in texts], window)
    base = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    lengths = np.array([len(s) for s in stretches])
    begins = np.cumsum(lengths) - lengths
    interval = np.cumsum(common < window)
    at = base[source] + place
    of = np.searchsorted(begins, at, side="right") - 1
    inside = at - begins[of]
    whole = inside <= lengths[of] - window
    interval, at, of, inside = (x[whole] for x in (interval, at, of, inside))
    mine = np.array(group)[of]
    order = np.lexsort((at, mine, interval))
    interval, mine, of, inside = (x[order] for x in (interval, mine, of, inside))
    again = np.concatenate(([False], (interval[1:] == interval[:-1]) & (mine[1:] == mine[:-1])))
    return of[again], inside[again]


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _texts(table: pa.Table, copies: pa.Table) -> Iterator[tuple]:
    """(number in the block, o, d, text) of a block's documents that are no copies, in order, each once."""
    gone, column = set(zip(copies["o"].to_pylist(), copies["d"].to_pylist(), strict=True)), table["text"]
    for i, (document, at) in enumerate(_numbered(table)):
        if document not in gone:
            yield i, *document, column[at].as_py()


def _numbered(table: pa.Table) -> list[tuple[tuple, int]]:
    """A block's documents (o, d) in order, each with its first row."""
    first: dict[tuple, int] = {}
    for at, document in enumerate(zip(table["o"].to_pylist(), table["d"].to_pylist(), strict=True)):
        first.setdefault(document, at)
    return sorted(first.items())


def _asked(shares: int, window: int, gram: int):
    """A block's anchors for each share of hashes, with the number of stretches."""

    def asked(table: pa.Table, copies: pa.Table) -> pa.Table:
        found = [anchors(text, window, gram)[0] for *_, text in _texts(table, copies)]
        hashes, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
        share = (hashes >> np.uint64(32)) % np.uint64(shares)
        order = np.argsort(share, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], share[order][1:] != share[order][:-1]))) if len(order) else []
        parts = np.split(order, starts[1:]) if len(order) else []
        block = table["block"][0].as_py() if len(table) else None
        columns = [pa.array(share[[p[0] for p in parts]] if parts else [], pa.int32()), pa.array([block] * len(parts), pa.int64())]
        columns += [pa.array([hashes[p].tobytes() for p in parts], pa.binary()), pa.array([np.minimum(n[p], 1 << 30).astype("<u4").tobytes() for p in parts], pa.binary())]
        trim()
        return pa.table(columns, names=["share", "block", "hashes", "n"])

    return asked


def _answered(table: pa.Table) -> pa.Table:
    """To each block those of its anchors that stand twice or more, with the number of salts."""
    hashes = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
    every, n = np.concatenate(hashes), np.concatenate([np.frombuffer(x, "<u4") for x in table["n"].to_pylist()])
    distinct, of = np.unique(every, return_inverse=True)
    total = np.bincount(of, weights=n).astype(np.int64)
    wanted, salts, at = (total > 1)[of], -(-total // SALTED), 0
    out: tuple[list, list] = ([], [])
    for h in hashes:
        mine = wanted[at : at + len(h)]
        out[0].append(h[mine].tobytes())
        out[1].append(salts[of[at : at + len(h)]][mine].astype("<u4").tobytes())
        at += len(h)
    return pa.table([table["block"], pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())], names=["block", "hashes", "salts"])


#: A stretch; where the anchor is null, a block's spans (packed) that are known to go.
_STRETCH = "anchor long, salt long, salted boolean, block long, o {o}, d long, start long, i int, bytes binary"


def _packed(i: np.ndarray, first: np.ndarray, stop: np.ndarray) -> bytes:
    return np.stack([i, first, stop], 1).astype("<u4").tobytes()


def _stretched(window: int, gram: int):
    def stretched(table: pa.Table, told: pa.Table) -> pa.Table:
        is_answer = pc.is_valid(told["hashes"])
        answers, copies = told.filter(is_answer), told.filter(pc.invert(is_answer))
        wanted = np.frombuffer(b"".join(answers["hashes"].to_pylist()), "<u8")
        salts = np.frombuffer(b"".join(answers["salts"].to_pylist()), "<u4")
        order = np.argsort(wanted)
        wanted, salts = wanted[order], salts[order]
        parts, seen, of, own, known = [], set(), ([], []), [], []
        for i, o, d, text in _texts(table, copies) if len(wanted) else ():
            hashes, starts, counts = anchors(text, window, gram)
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            use = np.flatnonzero(wanted[at] == hashes)
            first, stop = starts[use], starts[use] + counts[use] + window - 1
            new = np.zeros(len(use), bool)
            for k, (a, b) in enumerate(zip(first.tolist(), stop.tolist(), strict=True)):
                # a later equal stretch is a repeat as a whole
                if (part := text[a:b]) not in seen:
                    seen.add(part)
                    parts.append(part)
                    new[k] = True
            known.append((np.full(len(use), i), first, stop) if not new.any() else (np.full((~new).sum(), i), first[~new], stop[~new]))
            n = salts[at[use[new]]].astype(np.int64)
            salt = np.zeros(len(n), np.int64)
            for k in np.flatnonzero(n > 1).tolist():
                salt[k] = xxhash.xxh32_intdigest(f"{o} {d} {first[new][k]}") % n[k]
            own.append((hashes[use[new]].view(np.int64), salt, n > 1, np.full(len(n), d), first[new], np.full(len(n), i, np.int32)))
            of[0].append(o)
            of[1].append(len(n))
        trim()
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), table["o"].type, pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = [c.split(" ")[0] for c in _STRETCH.split(", ")]
        if not own:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        anchor, salt, salted, d, start, number = map(np.concatenate, zip(*own, strict=True))
        block = table["block"][0].as_py()
        o = pa.array(of[0], kinds[4]).take(pa.array(np.repeat(np.arange(len(of[0])), of[1])))
        found = pa.table([pa.array(x, k) for x, k in zip((anchor, salt, salted, np.full(len(anchor), block), o, d, start, number, parts), kinds, strict=True)], names=names)
        i, first, stop = map(np.concatenate, zip(*known, strict=True))
        if not len(i):
            return found
        rest = pa.table([pa.array([x], k) for x, k in zip((None, block, None, block, None, None, None, None, _packed(i, first, stop)), kinds, strict=True)], names=names)
        return pa.concat_tables([found, rest])

    return stretched


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary column, where each value begins and its length."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at[:-1] - at[0], np.diff(at)


def _anchored(text: np.ndarray, begins: np.ndarray, lengths: np.ndarray, anchor: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches and the place of each one's anchor."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    hits = np.flatnonzero(_hashed(text.tobytes(), gram).view(np.int64) == anchor[row][: len(text) - gram + 1])
    of, inside = row[hits], hits - begins[row[hits]]
    within = (inside >= lengths[of] - window) & (inside <= window - gram)
    # all windows of the stretch hold it, and of several the first is the anchor
    of, first = np.unique(of[within], return_index=True)
    return of, inside[within][first]


def _held(text: np.ndarray, at: np.ndarray, size: int, h: np.ndarray) -> np.ndarray:
    """A hash of the ``size`` bytes at each place, that goes on from ``h``."""
    met = np.zeros((len(at), -(-size // 8) * 8), np.uint8)
    met[:, :size] = np.lib.stride_tricks.sliding_window_view(text, size)[at]
    for eight in met.view("<u8").T:
        h = _mixed(h, eight)
    return h


def together(column: pa.Array, anchor: np.ndarray, group: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which of different stretches may have a window that another of their group has.

    A window that starts ``half`` bytes or more before its anchor holds those and the anchor, another one holds the anchor
    and what follows up to the window's length. Stretches that share neither have no window in common.
    """
    text, begins, lengths = _bytes(column)
    of, inside = _anchored(text, begins, lengths, anchor, window, gram)
    half = (window - gram + 1) // 2
    back, ahead = inside >= half, inside - (lengths[of] - window) < half
    out = np.ones(len(lengths), bool)
    out[of] = False
    for some, size, shift in ((back, half + gram, -half), (ahead, window - half + 1, 0)):
        if not some.any():
            continue
        h = _held(text, begins[of[some]] + inside[some] + shift, size, group[of[some]].astype(np.uint64))
        # two that differ with one hash only go to the shards in vain
        _, key, n = np.unique(h, return_inverse=True, return_counts=True)
        out[of[some]] |= n[key] > 1
    return out


def parted(column: pa.Array, anchor: np.ndarray, of: np.ndarray, inside: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Pieces of stretches without the windows (of, inside): stretch, first window, number of windows, and a hash of what all windows
    of that part hold. Equal windows have equal hashes."""
    text, begins, lengths = _bytes(column)
    place, wide = _anchored(text, begins, lengths, anchor, window, gram)[1], -(-(window - gram + 1) // PARTS)
    n = lengths - window + 1
    ahead = np.cumsum(n) - n
    stays = np.ones(n.sum(), bool)
    stays[ahead[of] + inside] = False
    row = np.repeat(np.arange(len(n)), n)[stays]
    at = np.flatnonzero(stays) - ahead[row]
    part = (place[row] - at) // wide
    edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (part[1:] != part[:-1])))) if len(row) else row
    size, row, at, part = np.diff(np.append(edge, len(row))), row[edge], at[edge], part[edge]
    return row, at, size, _held(text, begins[row] + place[row] - part * wide, window - wide + 1, anchor[row].astype(np.uint64)).view(np.int64)


#: A piece of windows that are first in their salt; where the part is null, spans of a block (packed) that go.
_PIECE = "block long, o {o}, d long, i int, first long, salt long, part long, bytes binary"
#: Spans of a block, packed (no digest), or a window.
_FOUND = "block long, o {o}, d long, i int, first long, digest binary, spans binary"


def _pieces(window: int, gram: int, shard: int):
    """Stretches in order of (anchor, salt, document, place): spans of repeated windows and, of salted anchors,
    the windows that are first here, in pieces."""

    def resolve(table: pa.Table) -> pa.RecordBatch:
        column = table["bytes"].combine_chunks()
        anchor, salt, block, d, start, number = (table[c].to_numpy() for c in ("anchor", "salt", "block", "d", "start", "i"))
        lengths = _bytes(column)[2]
        group = np.cumsum(np.concatenate(([False], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))))
        value = column.dictionary_encode().indices.to_numpy()
        # equal stretches of a group: the first stays, the others go as a whole
        kept = np.sort(np.unique(group * (len(value) + 1) + value, return_index=True)[1])
        again = np.delete(np.arange(len(value)), kept)
        spans = [(again, start[again], start[again] + lengths[again])]
        alone = np.bincount(group[kept])[group[kept]] == 1
        some = kept[~alone]
        if len(some):
            some = some[together(column.take(pa.array(some)), anchor[some], group[some], window, gram)]
        of = inside = np.zeros(0, np.int64)
        if len(some):
            of, inside = repeated(column.take(pa.array(some)).to_pylist(), group[some].tolist(), window, shard)
            order = np.lexsort((inside, of))
            of, inside = some[of[order]], inside[order]
            edge = np.flatnonzero((of[1:] != of[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1 if len(of) else of
            if len(of):
                a, b = np.concatenate(([0], edge)), np.concatenate((edge, [len(of)])) - 1
                spans.append((of[a], start[of[a]] + inside[a], start[of[a]] + inside[b] + window))
        of_span, first, stop = map(np.concatenate, zip(*spans, strict=True))
        order = np.argsort(block[of_span], kind="stable")
        of_span, first, stop = of_span[order], first[order], stop[order]
        cuts = np.flatnonzero(np.diff(block[of_span])) + 1
        packed = [_packed(number[x], y, z) for x, y, z in zip(*(np.split(v, cuts) for v in (of_span, first, stop)), strict=True)] if len(of_span) else []
        blocks = block[of_span[np.concatenate(([0], cuts))]] if len(of_span) else of_span
        salted = kept[table["salted"].to_numpy()[kept]]
        at = first = part = np.zeros(0, np.int64)
        parts: list[bytes] = []
        if len(salted):
            texts, mine = column.take(pa.array(salted)), np.isin(of, salted)
            row, first, size, part = parted(texts, anchor[salted], np.searchsorted(salted, of[mine]), inside[mine], window, gram)
            text, begins, _ = _bytes(texts)
            whole, a = text.tobytes(), begins[row] + first
            parts = [whole[x:y] for x, y in zip(a.tolist(), (a + size + window - 1).tolist(), strict=True)]
            at = salted[row]
        rows = len(blocks)
        both = lambda v, k: pa.concat_arrays([pa.nulls(rows, k), v.cast(k)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((blocks, block[at])).astype(np.int64)),
                both(table["o"].combine_chunks().take(pa.array(at)), table["o"].type),
                both(pa.array(d[at]), pa.int64()),
                both(pa.array(number[at]), pa.int32()),
                both(pa.array(start[at] + first), pa.int64()),
                both(pa.array(salt[at]), pa.int64()),
                both(pa.array(part), pa.int64()),
                pa.array(packed + parts, pa.binary()),
            ],
            [c.split(" ")[0] for c in _PIECE.split(", ")],
        )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            is_known = pc.is_null(batch["anchor"])
            if known := pc.sum(is_known).as_py():
                spans = batch.filter(is_known)
                kinds = (batch["o"].type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([spans["block"], *(pa.nulls(known, k) for k in kinds), spans["bytes"]], [c.split(" ")[0] for c in _PIECE.split(", ")])
                batch = batch.filter(pc.invert(is_known))
            if not len(batch):
                continue
            held.append(batch)
            size += _bytes(batch["bytes"])[2].sum()
            if size >= MERGED:
                table = pa.Table.from_batches(held)
                anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
                # the last group may go on
                new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1]))
                if len(new):
                    yield resolve(table.slice(0, new[-1] + 1))
                    held = table.slice(new[-1] + 1).combine_chunks().to_batches()
                    size = sum(_bytes(x["bytes"])[2].sum() for x in held)
                    del table
                    trim()
        if held:
            yield resolve(pa.Table.from_batches(held))

    return pieces


def _windows(window: int):
    """Pieces to their windows, a row each; spans stay as they are."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_spans = pc.is_null(batch["part"])
            texts = batch["bytes"].to_pylist()
            n = np.array([1 if s else len(x) - window + 1 for s, x in zip(is_spans.to_pylist(), texts, strict=True)], np.int64)
            row = pa.array(np.repeat(np.arange(len(n)), n))
            inside = pa.array(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            digests = [None if s else xxhash.xxh3_128_digest(x[j : j + window]) for s, x, k in zip(is_spans.to_pylist(), texts, n.tolist(), strict=True) for j in range(k)]
            spans = pc.if_else(is_spans, batch["bytes"], pa.scalar(None, pa.binary())).take(row)
            columns = [*(batch[c].take(row) for c in ("block", "o", "d", "i")), pc.add(batch["first"].take(row), inside), pa.array(digests, pa.binary()), spans]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _FOUND.split(", ")])

    return windows


def _resolved(window: int, gram: int, shard: int):
    """Pieces and all their windows in one go, where no other salt is asked which pieces it has."""
    pieces, windows = _pieces(window, gram, shard), _windows(window)
    return lambda batches: windows(pieces(batches))


def _united(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and the one after of a block's spans, those that touch or overlap as one, in order."""
    i, first, stop = np.frombuffer(b"".join(packed), "<u4").reshape(-1, 3).astype(np.int64).T
    order = np.argsort(i << 32 | first)
    head, reach = (i << 32 | first)[order], np.maximum.accumulate((i << 32 | stop)[order])
    new = np.flatnonzero(np.concatenate(([True], head[1:] > reach[:-1]))) if len(head) else order
    last = np.append(new[1:], len(head)) - 1 if len(head) else order
    return head[new] >> 32, head[new] & 0xFFFFFFFF, reach[last] & 0xFFFFFFFF


def dedup_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """key, n_bytes, n_removed, spans (first byte and the one after, maximal) and kept (binary) of every row."""
    if not 8 <= gram <= window or gram % 8:
        raise ValueError("gram is a multiple of 8, and no more than the window")
    spark = docs.sparkSession
    small_batches(spark)
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    o = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)) if whole else F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    of = "long" if whole else "string"
    raw = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    base = docs.select(o.alias("o"), F.xxhash64(raw).alias("d"), raw.alias("text"))

    # copies of a whole text: the groups' first document meets the others by a join that splits hot groups
    known = cut(base.select("o", "d", F.octet_length("text").alias("n")), "lengths")
    size = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # as a table, so that the join shuffles both sides and a hot group's rows can be split
    firsts = cut(known.groupBy("d", "n").agg(F.min("o").alias("least"), F.max("o").alias("most")).where("least <> most"), "firsts")
    copies = cut(known.join(firsts.hint("merge"), ["d", "n"]).where("o <> least").select("o", "d").distinct(), "copies")

    blocks, parts = max(1, -(-size // block_bytes)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = F.pmod(F.xxhash64("o", "d"), F.lit(blocks)).alias("block")
    of_block = copies.select(block, "o", "d")
    dealt = base.select(block, "o", "d", "text").repartition(parts, "block")

    shares = max(1, -(-size // (SHARE * (window - gram + 1) // 2)))
    asked = dealt.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(_asked(shares, window, gram), "share int, block long, hashes binary, n binary")
    answers = asked.groupBy("share").applyInArrow(_answered, "block long, hashes binary, salts binary")
    told = answers.unionByName(of_block, allowMissingColumns=True)
    stretches = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_stretched(window, gram), _STRETCH.format(o=of))
    order = ["anchor", "salt", "o", "d", "start"]
    # as tables: what a task merges is read three times, and a part of many pieces is split in the join
    pieces = cut(stretches.repartition(parts, "anchor", "salt").sortWithinPartitions(*order).mapInArrow(_pieces(window, gram, shard), _PIECE.format(o=of)), "pieces")
    first = pieces.where("part is not null")
    several = cut(first.groupBy("part").agg(F.min("salt").alias("least"), F.max("salt").alias("most")).where("least <> most").select("part"), "several")
    found = first.join(several.hint("merge"), "part").mapInArrow(_windows(window), _FOUND.format(o=of))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("o", "d", "first"))
    later = F.struct("i", "first", (F.col("first") + window).alias("stop"))
    again = found.withColumn("rank", rank).where("rank > 1").select("block", later.alias("later"))
    spans = pieces.where("part is null").select("block", F.col("bytes").alias("spans")).unionByName(again, allowMissingColumns=True)

    def remove(table: pa.Table, marks: pa.Table) -> pa.Table:
        windows = marks["later"].combine_chunks().drop_null().flatten()
        packed = [x for x in marks["spans"].to_pylist() if x is not None]
        i, first, stop = _united([*packed, _packed(*(x.to_numpy(zero_copy_only=False) for x in windows))])
        copied = {x for x in zip(marks["o"].to_pylist(), marks["d"].to_pylist(), strict=True) if x[0] is not None}
        documents = _numbered(table)
        cuts = np.searchsorted(i, np.arange(len(documents) + 1)).tolist()
        of_doc = {document: (a, b) for (document, _), a, b in zip(documents, cuts[:-1], cuts[1:], strict=True)}
        first, stop = first.tolist(), stop.tolist()
        out = []
        for at, document in enumerate(zip(table["o"].to_pylist(), table["d"].to_pylist(), strict=True)):
            body = table["text"][at].as_py()
            # a copy's bytes all go, if a window fits in
            a, b = of_doc[document]
            runs = ([(0, len(body))] if len(body) >= window else []) if document in copied else list(zip(first[a:b], stop[a:b], strict=True))
            kept = b"".join(body[a:b] for a, b in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(body)], strict=True))
            out.append((len(body), len(body) - len(kept), [{"first": a, "stop": b} for a, b in runs], kept))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])), pa.binary())
        trim()
        return pa.table([table["o"], *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["o", "n_bytes", "n_removed", "spans", "kept"])

    schema = f"o {of}, n_bytes long, n_removed long, spans array<struct<first: long, stop: long>>, kept binary"
    marked = spans.unionByName(of_block, allowMissingColumns=True)
    done = dealt.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(remove, schema)
    back = F.when(F.col("o") != _FIRST, F.col("o")) if whole else F.when(F.col("o") != "0", F.expr("substring(o, 2)"))
    return done.select(back.cast(docs.schema[key].dataType).alias(key), "n_bytes", "n_removed", "spans", "kept")
