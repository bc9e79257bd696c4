"""Removal of word passages that occurred earlier, by suffix automata (operator 4).

A passage is a window of ``WINDOW`` consecutive words (runs of non-blanks, unchanged). A word goes
if a window that covers it also starts earlier: in a document of smaller id, or further up.

Each window has an anchor: its word 5-gram of smallest hash, the leftmost in a tie. Equal windows
have equal anchors, so windows need to be compared only under one anchor. The reference shards are
therefore dealt out by anchor instead of being broadcast to all documents (a corpus that is its own
reference has shards without bound, and every document would stream past each of them):

1. Anchors of all documents are counted; only those of two texts, or twice in one, can matter.
   Copies of a whole text count as one text: every window of a later copy is a repeat.
2. Segments, runs of windows under one such anchor, go to the anchor's shard in document order.
   There a suffix automaton of the segments so far is kept; each segment streams past it for its
   matching statistics, where a length of ``WINDOW`` or more marks a repeated window, and is then
   added to it. Memory is that of the shard's different segments.
3. Anchors of more than ``SHARD_ROWS`` segments are salted by document and place; windows that are new in
   their salt meet once more, by window, where each salt has sent a window at most once.
4. Spans go back to the documents, which are shuffled once.

Null and empty texts have no words. Rows of one id with one text are one document; rows of one id
with different texts are ordered by a hash of the text. Null ids come before all others.
Ids are whole numbers or text (ordered by its bytes). Columns other than those named are ignored, or come back where ``keep`` lists them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, giving_back, small_batches

WINDOW, GRAM = 20, 5
SHARD_ROWS = 2000
#: Tasks over which the copies of one text are dealt.
COPY_SALTS = 16
_FIRST = -(1 << 63)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class SuffixAutomaton:
    """Of several word sequences: the smallest automaton that reads all their passages."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, nxt: dict[bytes, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _fork(self, p: int, word: bytes) -> int:
        """The state that reads exactly the passages of p and the word."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[bytes]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._fork(last, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._fork(p, word)
            last = new

    def matching(self, words: list[bytes]) -> list[int]:
        """At each word the length of the longest passage of the automaton that ends there."""
        state = length = 0
        out = []
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            else:
                length = 0
            out.append(length)
        return out


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchors(words: list[bytes], known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each window the position of its anchor; the hashes of all 5-grams."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    grams = np.zeros(len(h) - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(GRAM):
            grams = (grams ^ h[j : j + len(grams)]) * np.uint64(0x9E3779B97F4A7C15)
            grams ^= grams >> np.uint64(31)
    wide = WINDOW - GRAM + 1
    of = np.arange(len(h) - WINDOW + 1)
    return of + np.argmin(np.lib.stride_tricks.sliding_window_view(grams, wide), axis=1), grams


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def without_spans(text: str | None, spans: list[dict[str, int]]) -> str | None:
    if not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    at, out = 0, []
    for s in spans:
        out.append(raw[at : starts[s["first"]]])
        at = starts[s["last"] + 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


@giving_back
def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _WordHash()
    for batch in batches:
        rows = []
        for text in batch["text"].to_pylist():
            words = split_words(text)
            digest = xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)
            if len(words) < WINDOW:
                rows.append((digest, len(words), [], [], []))
                continue
            at, grams = anchors(words, known)
            at = np.unique(at)
            hashes, n = np.unique(grams[at], return_counts=True)
            rows.append((digest, len(words), grams[at].view(np.int64), at.astype(np.int32), hashes[n > 1].view(np.int64)))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch["o"], batch["d"], *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["o", "d", "digest", "n_words", "hashes", "places", "again"])


@giving_back
def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts in order of (o, d); a repeated row is skipped."""
    known, before = _WordHash(), None
    for batch in batches:
        hashes, salts, hot, os, ds, firsts, texts = [], [], [], [], [], [], []
        wanted, ends = batch["wanted"].flatten(), batch["wanted"].offsets.to_pylist()
        places, counts = (wanted.field(i).to_numpy() for i in (0, 1))
        at0 = ends[0]
        for i, (o, d, text) in enumerate(zip(batch["o"].to_pylist(), batch["d"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            if (o, d) == before:
                continue
            before = (o, d)
            words = split_words(text)
            at, grams = anchors(words, known)
            mine = slice(ends[i] - at0, ends[i + 1] - at0)
            order = np.argsort(places[mine])
            place, count = places[mine][order], counts[mine][order]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            stops = np.append(starts[1:], len(at))
            found = np.searchsorted(place, at[starts])
            found[found == len(place)] = 0
            use = place[found] == at[starts]
            for h, n, start, stop in zip(grams[at[starts[use]]].view(np.int64).tolist(), count[found[use]].tolist(), starts[use].tolist(), stops[use].tolist(), strict=True):
                hashes.append(h)
                salts.append(xxhash.xxh32_intdigest(f"{o} {d} {start}") % n if n > 1 else 0)
                hot.append(n > 1)
                firsts.append(start)
                texts.append(b" ".join(words[start : stop + WINDOW - 1]))
            n = int(use.sum())
            os += [o] * n
            ds += [d] * n
        columns = (pa.array(hashes, pa.int64()), pa.array(salts, pa.int64()), pa.array(hot, pa.bool_()), pa.array(os, batch["o"].type), pa.array(ds, pa.int64()), pa.array(firsts, pa.int32()), pa.array(texts, pa.binary()))
        yield pa.RecordBatch.from_arrays(list(columns), ["anchor", "salt", "hot", "o", "d", "start", "words"])


_SEGMENT = "anchor long, salt long, hot boolean, o {o}, d long, start int, words binary"
_FOUND = "anchor long, o {o}, d long, first int, last int, window binary"


@giving_back
def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of (anchor, salt, document, place): spans of repeated windows (window null)
    and, of salted anchors, the windows that are new here."""
    group, seen, automaton, waiting = None, set(), None, None
    for batch in batches:
        a, os, ds, firsts, lasts, windows = [], [], [], [], [], []

        def put(anchor: int, o: int, d: int, first: int, last: int, window: bytes | None = None) -> None:
            a.append(anchor)
            os.append(o)
            ds.append(d)
            firsts.append(first)
            lasts.append(last)
            windows.append(window)

        columns = (batch[c].to_pylist() for c in ("anchor", "salt", "hot", "o", "d", "start", "words"))
        for anchor, salt, hot, o, d, start, text in zip(*columns, strict=True):
            if (anchor, salt) != group:
                group, seen, automaton, waiting = (anchor, salt), set(), None, None
            if text in seen:
                put(anchor, o, d, start, start + text.count(b" "))
                continue
            words = text.split(b" ")
            repeated = np.zeros(len(words) - WINDOW + 1, bool)
            if seen:
                if automaton is None:
                    automaton = SuffixAutomaton()
                    automaton.add(waiting)
                repeated = np.array(automaton.matching(words)[WINDOW - 1 :]) >= WINDOW
                if not repeated.all():
                    automaton.add(words)
            else:
                waiting = words
            seen.add(text)
            for x, y in _runs(repeated):
                put(anchor, o, d, start + x, start + y + WINDOW - 2)
            if hot:
                for i in np.flatnonzero(~repeated).tolist():
                    put(anchor, o, d, start + i, start + i + WINDOW - 1, b" ".join(words[i : i + WINDOW]))
        kinds = (pa.int64(), batch["o"].type, pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((a, os, ds, firsts, lasts, windows), kinds, strict=True)], ["anchor", "o", "d", "first", "last", "window"])


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, n_words, n_removed, spans (first and last word removed, merged), kept, and ``_row`` (a struct of ``keep``).

    ``kept`` is the text without the spans and the blanks after them, else unchanged (null for null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    extra = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None).cast("boolean")
    # an orderable id without nulls, which come first
    whole = isinstance(docs.schema[key].dataType, T.IntegralType)
    o = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)) if whole else F.coalesce(F.concat(F.lit("1"), F.col(key).cast("string")), F.lit("0"))
    of = "long" if whole else "string"
    base = docs.select(
        o.alias("o"),
        F.xxhash64(text).alias("d"), F.col(text).alias("text"), extra.alias("extra"),
    )
    known = cut(base.select("o", "d", "text").mapInArrow(_survey, f"o {of}, d long, digest long, n_words int, hashes array<long>, places array<int>, again array<long>"), "anchors")

    # the first of each group of copies goes to several tasks, over which the group's rows are dealt
    firsts = known.groupBy("digest", "n_words").agg(F.min(F.struct("o", "d")).alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "n_words", "least", F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("part"))
    part = F.pmod(F.xxhash64("o", "d"), F.lit(COPY_SALTS)).cast("int").alias("part")
    copies = known.select("o", "d", "digest", "n_words", part).join(firsts, ["digest", "n_words", "part"]).where(F.struct("o", "d") != F.col("least")).drop("part")
    copied = copies.where(F.col("n_words") >= WINDOW).select("o", "d", F.lit(0).alias("first"), (F.col("n_words") - 1).alias("last"))

    seen = known.select(F.explode("hashes").alias("hash"), "digest").unionByName(known.select(F.explode("again").alias("hash"), F.col("digest").bitwiseXOR(F.lit(1)).alias("digest")))
    counted = seen.groupBy("hash").agg(F.min("digest").alias("a"), F.max("digest").alias("b"), F.count("*").alias("n"))
    # as a table, so that the next join shuffles both sides and a hot anchor's rows can be split
    repeated = cut(counted.where("a <> b").select("hash", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("salts")), "repeated")
    placed = known.select("o", "d", F.inline(F.arrays_zip(F.col("hashes").alias("hash"), F.col("places").alias("place")))).toDF("o", "d", "hash", "place")
    wanted = placed.join(repeated, "hash").groupBy("o", "d").agg(F.collect_set(F.struct("place", "salts")).alias("wanted"))
    wanted = cut(wanted.join(copies.select("o", "d"), ["o", "d"], "left_anti"), "wanted")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base.repartition(parts, "o", "d")  # texts move once: both uses below read this exchange
    full = dealt.join(wanted.withColumnRenamed("o", "wo").withColumnRenamed("d", "wd"), (F.col("o") == F.col("wo")) & (F.col("d") == F.col("wd"))).drop("wo", "wd")
    # the rows of one text of one id come together; a merge join leaves them in this order already
    segments = full.sortWithinPartitions("o", "d").mapInArrow(_segments, _SEGMENT.format(o=of)).repartition(parts, "anchor", "salt").sortWithinPartitions("anchor", "salt", "o", "d", "start")
    found = segments.mapInArrow(_resolve, _FOUND.format(o=of))
    order = Window.partitionBy("anchor", "window", F.when(F.col("window").isNull(), F.struct("o", "d"))).orderBy("o", "d", "first")
    spans = found.withColumn("rank", F.row_number().over(order)).where("window is null or rank > 1").select("o", "d", "first", "last").unionByName(copied)
    of_doc = spans.groupBy("o", "d").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    joined = dealt.join(of_doc, ["o", "d"], "left")

    @giving_back
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            spans, ends = batch["spans"].flatten(), batch["spans"].offsets.to_pylist()
            first, last = (spans.field(i).to_numpy() for i in (0, 1))
            for i, body in enumerate(batch["text"].to_pylist()):
                words = split_words(body)
                depth = np.zeros(len(words) + 1, np.int64)
                mine = slice(ends[i] - ends[0], ends[i + 1] - ends[0])
                np.add.at(depth, first[mine], 1)
                np.add.at(depth, last[mine] + 1, -1)
                gone = np.cumsum(depth[:-1]) > 0
                merged = [{"first": a, "last": b - 1} for a, b in _runs(gone)]
                out.append((len(words), int(gone.sum()), merged, without_spans(body, merged)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.string())
            made = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["o"], batch["extra"], *made], ["o", "extra", "n_words", "n_removed", "spans", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    columns = {"o": base.schema["o"].dataType, "extra": base.schema["extra"].dataType, "n_words": T.LongType(), "n_removed": T.LongType(), "spans": span, "kept": T.StringType()}
    done = joined.select("o", "extra", "text", "spans").mapInArrow(remove, T.StructType([T.StructField(n, t) for n, t in columns.items()]))
    back = (F.when(F.col("o") != _FIRST, F.col("o")) if whole else F.when(F.col("o") != "0", F.expr("substring(o, 2)"))).cast(docs.schema[key].dataType).alias(key)
    return done.select(back, "n_words", "n_removed", "spans", "kept", *([F.col("extra").alias("_row")] if keep else []))
