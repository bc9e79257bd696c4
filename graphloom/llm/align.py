"""Alignment of two tokenizers over distinct segments (operator 11).

Tokenizer A is a byte-level BPE that splits at white space before it merges, B a sentencepiece BPE.
Neither can merge across the start of a run of white space: A by its split pattern, B because no piece
of its vocabulary holds a cut character after another one (``cut_characters`` reads this off
the vocabulary; a character that fails is not cut at). So a text's tokens are those of its segments.

1. Documents are split and gathered into blocks of about ``BLOCK`` bytes: a block has its distinct segments
   once, and its documents as codes into them.
2. Distinct segments of all blocks are dealt by hash. Each task meets a segment once a block, tokenises
   and aligns it the first time, and answers each block: token ids of both sides.
3. Blocks meet their answers. Documents are composed: tokens, groups, links; how many documents
   of the block hold an id pair linked.
4. Counts of pairs are summed over blocks, the highest count of each A id found, and both go back
   to the blocks (by a join, or to all tasks if they are few), which sum them over their documents' links.

A segment is dealt once a block at most, so the most frequent one is no hotter than others. A task of
step 2 holds the distinct segments of its share of hashes, a block its own. A document is one value, however long.

Null and empty texts, and texts that the tokens don't give back, have no tokens: zeros and ''. Rows are
documents one by one; repeated rows count each. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches, trim

#: Bytes of text in a block; distinct segments that a share of hashes has, about.
BLOCK, SHARE = 4 << 20, 200_000
#: Segments that are encoded as one text.
JOINED = 512
#: Id pairs (24 bytes each) that are sent to all tasks; more are joined to the blocks that have them.
PAIRS_HELD = 1_000_000
_CUTS = " \t\n"
_MARK = "▁"


def cut_characters(pieces: list[str]) -> str:
    """White space before which no vocabulary entry can reach back: it never holds it after another character."""
    return "".join(c for c in _CUTS if not any(re.search(f"[^{_MARK}]{_MARK}" if c == " " else f"(?s).{re.escape(c)}", p) for p in pieces))


def segment_pattern(cuts: str) -> re.Pattern[str]:
    """Segments of a text: a run of white space and what follows, up to the next run that starts with a cut character."""
    # without a cut character a text is one segment
    return re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+" if cuts else r"(?s).+")


def _byte_level() -> dict[str, int]:
    """Characters that byte-level vocabularies write for bytes: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


#: Of a segment: tokens of A, of B, their ids, and for each byte where a token ends which side ends there.
Aligned = tuple[int, int, bytes, bytes]
BOTH, ONLY_A, ONLY_B = 0, 1, 2


class _Codes(dict):
    """Numbers of segments in order of their first use."""

    def __missing__(self, segment: str) -> int:
        self[segment] = found = len(self)
        return found


class Pair:
    """Both tokenizers; ids and lengths of their tokens in bytes."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size, byte = self.b.vocab_size(), _byte_level()
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.length_a, self.length_b = (np.array([len(x) for x in xs], np.int64) for xs in (self.bytes_a, self.bytes_b))
        self.cuts = cut_characters(pieces)
        self.segments = segment_pattern(self.cuts)
        self.lone = self.b.piece_to_id(_MARK)
        ids = range(max(len(self.bytes_a), size))
        #: Ids as text within a group, at the end of its A side, and at its end.
        self.names = np.array([f"{i}{mark}" for mark in ",|;" for i in ids], object)

    def _b(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts as they are: B writes a space before each, which stands for theirs or is dropped."""
        found = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        out = []
        for text, ids in zip(texts, found, strict=True):
            if not text.startswith(" "):
                ids = ids[1:] if ids[:1] == [self.lone] else [-1]
            elif text == " ":
                ids = [self.lone]
            out.append(ids)
        return out

    def _run(self, raw: list[bytes], a: list[int], b: list[int]) -> list[Aligned] | None:
        """Segments that were encoded as one text; None where the tokens don't give it back."""
        if -1 in b or (whole := b"".join(raw)) != b"".join([self.bytes_a[i] for i in a]) or whole != b"".join([self.bytes_b[i] for i in b]):
            return None
        ends = np.cumsum([len(x) for x in raw])
        a, b = np.array(a, "<i4"), np.array(b, "<i4")
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        every = np.union1d(ends_a, ends_b)
        steps = np.where(np.isin(every, ends_a, assume_unique=True), np.where(np.isin(every, ends_b, assume_unique=True), BOTH, ONLY_A), ONLY_B).astype("u1").tobytes()
        cuts = [np.append(0, np.searchsorted(x, ends, side="right")).tolist() for x in (ends_a, ends_b, every)]
        a, b = a.tobytes(), b.tobytes()
        return [(q - p, s - r, a[4 * p : 4 * q] + b[4 * r : 4 * s], steps[t:u]) for (p, q), (r, s), (t, u) in zip(*(zip(c, c[1:], strict=False) for c in cuts), strict=True)]

    def encode(self, segments: list[str]) -> list[Aligned]:
        """Of each segment the ids of both sides and the steps; nothing where the tokens don't give the segment back."""
        out: list[Aligned] = [(0, 0, b"", b"")] * len(segments)
        # a segment that ends in white space may not be followed by another
        alone = [[i] for i, s in enumerate(segments) if s[-1].isspace()]
        tied = [i for i, s in enumerate(segments) if not s[-1].isspace()]
        todo = [tied[at : at + JOINED] for at in range(0, len(tied), JOINED)] + alone
        while todo:
            texts = ["".join([segments[i] for i in run]) for run in todo]
            ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            left = []
            for run, a, b in zip(todo, ids_a, self._b(texts), strict=True):
                found = self._run([segments[i].encode() for i in run], a, b)
                if found is None:
                    left += [[i] for i in run] if len(run) > 1 else []
                else:
                    for i, x in zip(run, found, strict=True):
                        out[i] = x
            todo = left
        return out

    def texts(self, a: np.ndarray, b: np.ndarray, common: np.ndarray, steps: np.ndarray, per_segment: np.ndarray) -> list[str]:
        """The groups of segments one after another as ``a1,a2|b1;``."""
        group = np.cumsum(common) - common
        in_a, in_b = steps != ONLY_B, steps != ONLY_A
        order = np.argsort(np.concatenate((group[in_a] * 2, group[in_b] * 2 + 1)), kind="stable")
        size = len(self.names) // 3
        which = np.concatenate((a + size * common[in_a], b + 2 * size * common[in_b]))
        names = self.names[which[order]].tolist()
        ends = np.cumsum(per_segment).tolist()
        return ["".join(names[p:q]) for p, q in zip([0, *ends[:-1]], ends, strict=True)]


_LOADED: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One a worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Pair(path_a, path_b)
    return _LOADED[path_a, path_b]


def _packed(values: np.ndarray | bytes) -> bytes:
    """Compressed; whole numbers byte plane by byte plane, as most have zeros above."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values, "<i4").view("u1").reshape(-1, 4).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _raw(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if len(data) > 8 else b""


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_raw(data), "u1").reshape(4, -1).T).view("<i4").ravel()


def _split(raw: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [raw[p:q] for p, q in zip([0, *ends[:-1]], ends, strict=True)]


_BLOCKS = "block long, k array<{k}>, n array<int>, codes binary, n_segments long, segments binary, lengths binary"


def _gather(path_a: str, path_b: str, block_bytes: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, made = pair(path_a, path_b).segments.findall, 0
        keys, n, codes, known, held, k_type = [], [], [], _Codes(), 0, None

        def block() -> pa.RecordBatch:
            segments = [s.encode() for s in known]
            columns = [
                pa.array([(TaskContext.get().partitionId() << 33) + made], pa.int64()), pa.array([keys], pa.list_(k_type)), pa.array([n], pa.list_(pa.int32())),
                pa.array([_packed(np.concatenate(codes) if codes else np.zeros(0, np.int32))]), pa.array([len(segments)], pa.int64()),
                pa.array([_packed(b"".join(segments))]), pa.array([_packed(np.array([len(s) for s in segments], np.int32))]),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "k", "n", "codes", "n_segments", "segments", "lengths"])

        for batch in batches:
            k_type = batch["k"].type
            for key, text in zip(batch["k"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = split(f" {text}") if text else []
                keys.append(key)
                n.append(len(found))
                codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held += len(text or "")
                if held >= block_bytes:
                    yield block()
                    made += 1
                    keys, n, codes, known, held = [], [], [], _Codes(), 0
                    trim()
        if keys:
            yield block()

    return gather


def _asked(shares: int):
    """For each share of hashes a block's segments: their codes, their bytes."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data, lengths in zip(batch["block"].to_pylist(), batch["segments"].to_pylist(), batch["lengths"].to_pylist(), strict=True):
                lengths = _unpacked(lengths)
                if not len(lengths):
                    continue
                segments = _split(_raw(data), lengths)
                share = np.fromiter((xxhash.xxh64_intdigest(s) % shares for s in segments), np.int64, len(segments))
                order = np.argsort(share, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], share[order][1:] != share[order][:-1])))
                parts = np.split(order, starts[1:])
                columns = [
                    pa.array(share[order[starts]], pa.int32()), pa.array([block] * len(parts), pa.int64()), pa.array([_packed(np.diff(p, prepend=0)) for p in parts]),
                    pa.array([_packed(b"".join([segments[i] for i in p])) for p in parts]), pa.array([_packed(lengths[p]) for p in parts]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["share", "block", "codes", "segments", "lengths"])

    return asked


def _answered(path_a: str, path_b: str):
    """Rows in order of the share: the tokens of each segment, which is tokenised and aligned when first met."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, share, known = pair(path_a, path_b), None, {}
        for batch in batches:
            counts, ids, steps = [], [], []
            for mine, data, lengths in zip(batch["share"].to_pylist(), batch["segments"].to_pylist(), batch["lengths"].to_pylist(), strict=True):
                if mine != share:
                    share, known = mine, {}
                segments = _split(_raw(data), _unpacked(lengths))
                new = [s for s in segments if s not in known]
                known.update(zip(new, both.encode([s.decode() for s in new]), strict=True))
                n_a, n_b, own, ends = zip(*map(known.__getitem__, segments), strict=True)
                counts.append(_packed(np.array([n_a, n_b, list(map(len, ends))], np.int32)))
                ids.append(_packed(np.frombuffer(b"".join(own), "<i4")))
                steps.append(_packed(b"".join(ends)))
            yield pa.RecordBatch.from_arrays([batch["block"], batch["codes"], *(pa.array(x, pa.binary()) for x in (counts, ids, steps))], ["block", "codes", "counts", "ids", "steps"])

    return answered


_COMPOSED = "block long, k array<{k}>, n array<int>, codes binary, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, pair array<long>, docs array<long>, link_of binary, link_pair binary"


def _composed(path_a: str, path_b: str):
    """A block with its answers: the documents without counts, its id pairs (A id << 32 | B id) and how many documents have each."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch[c][i] for c in batch.schema.names}
                n, codes, size = np.array(row["n"].as_py(), np.int64), _unpacked(row["codes"].as_py()), row["n_segments"].as_py()
                counts, ids, ends = np.zeros((size, 3), np.int64), [b""] * size, [b""] * size
                for part in row["answers"].as_py() or []:
                    at = np.cumsum(_unpacked(part["codes"]))
                    counts[at] = _unpacked(part["counts"]).reshape(3, -1).T
                    own = _split(_unpacked(part["ids"]).tobytes(), counts[at, :2].sum(axis=1) * 4)
                    for c, x, y in zip(at.tolist(), own, _split(_raw(part["steps"]), counts[at, 2]), strict=True):
                        ids[c], ends[c] = x, y
                flat, steps, n_links = np.frombuffer(b"".join(ids), "<i4"), np.frombuffer(b"".join(ends), "u1"), counts[:, 2]
                side = np.repeat(np.tile([True, False], size), counts[:, :2].ravel())
                a, b, common = flat[side].astype(np.int64), flat[~side].astype(np.int64), steps == BOTH
                text = both.texts(a, b, common, steps, counts[:, :2].sum(axis=1))
                link_a, link_b = (x[np.cumsum(m) - m] for x, m in ((a, steps != ONLY_B), (b, steps != ONLY_A)))
                link_of = np.repeat(np.arange(size), n_links)
                groups = np.bincount(link_of[common], minlength=size)
                pairs, link_pair = np.unique(link_a << 32 | link_b, return_inverse=True)
                link_starts, good = np.cumsum(n_links) - n_links, counts[:, 0] > 0
                doc_ends, docs, out = np.cumsum(n), np.zeros(len(pairs), np.int64), [[], [], [], [], []]
                for stop, m in zip(doc_ends.tolist(), n.tolist(), strict=True):
                    mine = codes[stop - m : stop]
                    if not m or not good[mine].all():
                        made = (0, 0, 0, 0, "")
                    else:
                        made = (counts[mine, 0].sum(), counts[mine, 1].sum(), groups[mine].sum(), n_links[mine].sum(), hashlib.sha256("".join(map(text.__getitem__, mine.tolist()))[:-1].encode()).hexdigest())
                        # runs of links of the document's different segments
                        distinct = np.unique(mine)
                        many = n_links[distinct]
                        places = np.repeat(link_starts[distinct] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
                        docs[np.unique(link_pair[places])] += 1
                    for column, value in zip(out, made, strict=True):
                        column.append(value)
                held = docs > 0
                lists = [pa.array([x], pa.list_(pa.string() if j == 4 else pa.int64())) for j, x in enumerate(out)]
                columns = [
                    batch["block"].slice(i, 1), batch["k"].slice(i, 1), batch["n"].slice(i, 1), batch["codes"].slice(i, 1), *lists,
                    pa.array([pairs[held]], pa.list_(pa.int64())), pa.array([docs[held]], pa.list_(pa.int64())),
                    pa.array([_packed(n_links.astype(np.int32))]), pa.array([_packed(link_pair.astype(np.int32))]),
                ]
                # a pair that no whole document has keeps its place by its number in the full list
                if not held.all():
                    renumbered = np.cumsum(held) - 1
                    renumbered[~held] = -1
                    columns[-1] = pa.array([_packed(renumbered[link_pair].astype(np.int32))])
                yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _COMPOSED.split(", ")])
                trim()

    return composed


def _finished(held: tuple[np.ndarray, np.ndarray, np.ndarray] | None):
    """A composed block with its pairs' counts, its own or those ``held`` for all: sums over each document's links."""

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                pairs = np.array(batch["pair"][i].as_py(), np.int64)
                if held:
                    at = np.searchsorted(held[0], pairs)
                    counted = [x[at] for x in held[1:]]
                else:
                    rows = batch["counted"][i].as_py() or []
                    order = np.argsort(np.array([x["pair"] for x in rows], np.int64))
                    counted = [np.array([x[c] for x in rows], np.int64)[order] for c in ("docs", "best")]
                # a link that no whole document has counts for none
                total = [np.concatenate(([0], np.cumsum(np.append(x, 0)[link_pair]))) for link_pair in [_unpacked(batch["link_pair"][i].as_py())] for x in counted]
                ends = np.cumsum(_unpacked(batch["link_of"][i].as_py()))
                codes, n = _unpacked(batch["codes"][i].as_py()), np.array(batch["n"][i].as_py(), np.int64)
                sums = [np.concatenate(([0], np.cumsum(np.diff(t[ends], prepend=0)[codes]))) for t in total]
                stops, whole = np.cumsum(n), np.array([x != "" for x in batch["digest"][i].as_py()], bool)
                count_sum, n_best = (np.where(whole, s[stops] - s[stops - n], 0) for s in sums)
                flat = [batch[c].slice(i, 1).flatten() for c in ("k", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*flat, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), batch["digest"].slice(i, 1).flatten()], ["k", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return finished


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, share: int = SHARE, pairs_held: int = PAIRS_HELD) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    return aligned_tables(docs, path_a, path_b, key, text, block_bytes, share, pairs_held)[0]


def aligned_tables(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, share: int = SHARE, pairs_held: int = PAIRS_HELD) -> tuple[DataFrame, DataFrame]:
    """The documents as ``align`` gives them, and the id pairs: a, b, docs (that hold them linked), best (1 if no other pair of a has more)."""
    default_a, default_b = default_tokenizers() if not (path_a and path_b) else (path_a, path_b)
    paths = (path_a or default_a, path_b or default_b)
    spark = docs.sparkSession
    small_batches(spark)
    k = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    blocks = cut(rows.mapInArrow(_gather(*paths, block_bytes), _BLOCKS.format(k=k)), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n_segments"), F.lit(0))).first()[0]
    shares = max(1, -(-size // share))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = blocks.select("block", "segments", "lengths").mapInArrow(_asked(shares), "share int, block long, codes binary, segments binary, lengths binary")
    dealt = asked.repartition(max(1, min(parts, shares)), "share").sortWithinPartitions("share", "block")
    answers = dealt.mapInArrow(_answered(*paths), "block long, codes binary, counts binary, ids binary, steps binary")
    of_block = answers.groupBy("block").agg(F.collect_list(F.struct("codes", "counts", "ids", "steps")).alias("answers"))
    met = blocks.select("block", "k", "n", "codes", "n_segments").join(of_block, "block", "left")
    composed = cut(met.mapInArrow(_composed(*paths), _COMPOSED.format(k=k)), "composed")

    held = composed.select("block", F.inline(F.arrays_zip("pair", "docs")))
    counts = held.groupBy("pair").agg(F.sum("docs").alias("docs"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = cut(counts.withColumn("best", (F.col("docs") == most).cast("int")), "pairs")
    schema = f"k {k}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    if counts.count() <= pairs_held:
        known = counts.orderBy("pair").toArrow()
        shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy().astype(np.int64) for c in ("pair", "docs", "best")))
        done = composed.drop("docs").mapInArrow(lambda batches: _finished(shared.value)(batches), schema)
    else:
        counted = held.select("block", "pair").join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "docs", "best")).alias("counted"))
        done = composed.drop("docs").join(counted, "block", "left").mapInArrow(_finished(None), schema)
    done = done.withColumnRenamed("k", key)
    ids = counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "docs", "best")
    return done, ids
