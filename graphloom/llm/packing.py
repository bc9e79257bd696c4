"""Best-fit packing by a configuration linear program over the length histogram (operator 10).

Documents are tokenised once into pieces of at most the capacity; their histogram (a bin for each
length, so bounded by the capacity) goes to the driver. There the configuration program (fewest
patterns that cover all lengths) is solved by multiplicative weights: each round prices lengths,
a knapsack dynamic program finds the best pattern and the best with each given length, and those
near the optimum gain weight. The fractional solution is rounded up, fullest and most used patterns
first, until most of the demand is met; the rest, bins with room included, is filled best-fit,
longest first. Pieces then get their rank within their length, and rank maps to sequence and
offset through the list of patterns.

Lengths are hot keys (a third of all pieces may be full), so ranks are taken within (length, salt)
and offset by the counts of smaller salts. Null and empty texts are one piece of the end token.
Repeated rows are packed each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, giving_back, small_batches
from graphloom.llm.tokens import tokenizer

CAPACITY, END_ID = 2048, 0
#: Rounds of multiplicative weights; slack within which a pattern counts as near the best.
ROUNDS, SLACK, RATE = 40, 0.01, 0.5
#: Share of the demand that rounded patterns meet; best fit places the rest.
PLACED = 0.9
#: Rows that are ranked in one task at most, about.
RANKED = 256
#: Bytes of text that are tokenised together.
GATHERED = 2 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 [, ids]: whole documents, cut only where longer."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of about ``GATHERED`` bytes at a time: the more texts together, the fewer different words."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= GATHERED:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
        if sum(map(len, held)):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    @giving_back
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in gathered(b for b in batches if len(b)):
            at, out = [], []
            for i, ids in enumerate(tok.ids(batch["text"])):
                ids += END_ID.to_bytes(4, "little")
                for p in range(0, len(ids) // 4, capacity):
                    part = ids[4 * p : 4 * (p + capacity)]
                    at.append(i)
                    out.append((p // capacity, p, len(part) // 4, zlib.crc32(part), np.frombuffer(part, np.int32) if with_ids else None))
            columns = [batch["k"].take(pa.array(at, pa.int64()))]
            columns += [pa.array([x[j] for x in out], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            columns += [pa.array([x[4] for x in out], pa.list_(pa.int32()))] * with_ids
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"`{key}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(make, schema)


@dataclass
class Bins:
    """Bins with the same pieces, by room left: room -> list of [how many, lengths]."""

    capacity: int
    by_room: dict[int, list] = field(default_factory=dict)

    def add(self, n: int, lengths: tuple[int, ...]) -> None:
        self.by_room.setdefault(self.capacity - sum(lengths), []).append([n, lengths])

    def fill(self, counts: dict[int, int]) -> None:
        """Best fit for all pieces, longest first, many equal bins at a time."""
        for length in sorted(counts, reverse=True):
            n = counts[length]
            while n:
                room = min((r for r, groups in self.by_room.items() if r >= length and groups), default=None)
                if room is None:
                    per = self.capacity // length
                    if n >= per:
                        self.add(n // per, (length,) * per)
                        n %= per
                    if n:
                        self.add(1, (length,) * n)
                        n = 0
                    continue
                group = self.by_room[room][-1]
                used = min(n, group[0])
                group[0] -= used
                if not group[0]:
                    self.by_room[room].pop()
                self.add(used, (*group[1], length))
                n -= used

    def groups(self) -> list[tuple[int, tuple[int, ...]]]:
        return [(n, lengths) for room in sorted(self.by_room) for n, lengths in self.by_room[room] if n]

    def total(self) -> int:
        return sum(n for n, _ in self.groups())


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value for each room and the piece taken first there (0: none); ties to the longest."""
    best, first = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = value[c:0:-1] + best[:c]  # lengths c down to 1
        k = int(np.argmax(gain))
        if gain[k] > best[c - 1] and value[c - k] > 0:
            best[c], first[c] = gain[k], c - k
        else:
            best[c] = best[c - 1]
    return best, first


def solve_fractional(counts: dict[int, int], capacity: int, rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], float]:
    """Patterns with fractional use, and a lower bound on any number of bins (the best dual found)."""
    lengths = np.array(sorted(counts), np.int64)
    demand = np.array([counts[x] for x in lengths], float)
    price = lengths / capacity
    covered = np.zeros(len(lengths))
    use: dict[tuple[int, ...], float] = {}
    place = {int(x): i for i, x in enumerate(lengths)}
    bound = 0.0
    for _ in range(rounds):
        value = np.zeros(capacity + 1)
        value[lengths] = price
        best, first = knapsack(value, capacity)
        bound = max(bound, float(demand @ price) / best[capacity])
        # the best pattern with each length, all at once
        room, steps = capacity - lengths, [lengths]
        while True:
            # rooms where nothing is gained by the last unit fall to the next smaller one that takes a piece
            nxt = first[room]
            low = room.copy()
            while (stuck := (nxt == 0) & (low > 0)).any():
                low[stuck] -= 1
                nxt = first[low]
            if not nxt.any():
                break
            steps.append(nxt)
            room = np.where(nxt > 0, low - nxt, 0)
        worth = price + best[capacity - lengths]
        table = np.array(steps).T
        step = demand / rounds
        gained = np.zeros(len(lengths))
        for i in np.nonzero(worth >= (1 - SLACK) * best[capacity])[0]:
            pattern = tuple(sorted((int(x) for x in table[i] if x), reverse=True))
            if sum(pattern) > capacity:
                continue
            amount = step[i] / pattern.count(int(lengths[i]))
            use[pattern] = use.get(pattern, 0.0) + amount
            for x in pattern:
                gained[place[x]] += amount
        covered += gained / demand
        price = price * np.exp(-RATE * (covered - covered.mean()))
        price = price / price.max()
    return use, bound


def round_patterns(use: dict[tuple[int, ...], float], left: dict[int, int], bins: Bins) -> None:
    """Place whole bins of patterns while all their pieces are in demand; ``left`` becomes what is not placed.

    The fractional uses of a pattern are mostly below one, so they are rounded up, in order of the room
    they leave and of the use, largest first, until ``PLACED`` of the demand is met: the last patterns
    would take the short pieces that the rest needs to fill its bins.
    """
    size = sum(x * n for x, n in left.items())
    placed = 0
    for pattern, x in sorted(use.items(), key=lambda p: (-sum(p[0]), -p[1], p[0])):
        need = {length: pattern.count(length) for length in set(pattern)}
        n = min(math.ceil(x), *(left[length] // k for length, k in need.items()))
        if n > 0:
            bins.add(n, pattern)
            placed += n * sum(pattern)
            for length, k in need.items():
                left[length] -= n * k
        if placed >= PLACED * size:
            return


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, tuple[int, ...]]], float]:
    """(how many bins, their lengths) for all pieces, and the lower bound of the program."""
    left, bins = dict(counts), Bins(capacity)
    if n := left.pop(capacity, 0):
        bins.add(n, (capacity,))
    bound = 0.0
    if left:
        use, bound = solve_fractional(left, capacity)
        round_patterns(use, left, bins)
    bins.fill({x: n for x, n in left.items() if n})
    return bins.groups(), bound + counts.get(capacity, 0)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; the offsets of a sequence are gapless from 0."""
    pieces = cut(cut_pieces(docs, path or default_tokenizer(), capacity, key, text, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    groups, _ = plan_bins(counts, capacity) if counts else ([], 0.0)
    # runs of ranks of a length that fall to one slot of a group: (length, first rank) -> sequence, offset
    runs, taken, sequence = [], dict.fromkeys(counts, 0), 0
    for n, lengths in groups:
        offset = 0
        for x in lengths:
            runs.append((x, taken[x], sequence, offset))
            taken[x] += n
            offset += x
        sequence += n
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 4)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((table[:, 0] * (1 << 44) + table[:, 1], table))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        starts, rows = shared.value
        at = rows[np.searchsorted(starts, length.to_numpy() * (1 << 44) + rank.to_numpy(), side="right") - 1]
        return pd.DataFrame({"sequence_id": at[:, 2] + rank.to_numpy() - at[:, 1], "offset": at[:, 3]})

    # only lengths of many pieces have more than one salt
    sizes = spark.createDataFrame([(x, -(-n // RANKED)) for x, n in counts.items()], "length long, _salts long")
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), "_salts"))
    within = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")) - 1)
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n"))
    ranked = within.join(before.drop("_n"), ["length", "_salt"])
    placed = ranked.withColumn("_at", place("length", (F.col("_rank") + F.col("_before")).cast("long")))
    return placed.select(key, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "_at.sequence_id", "_at.offset")
