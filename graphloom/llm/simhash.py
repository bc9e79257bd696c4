"""SimHash near-duplicates by a binary trie self-join (operator 6).

Fingerprints link within ``max_bits`` differing bits. The trie of all fingerprints is dealt out in
subtrees: of ``b`` blocks of bits at most ``max_bits`` can differ, so two linked fingerprints agree
on some choice of ``b - max_bits`` blocks; each choice is a table, its bits the key. In a subtree
the trie is joined with itself: pairs of nodes go down together, add up their differing bits and
are dropped beyond the budget. ``b`` grows with the number of rows, so that subtrees stay small.

A subtree yields a spanning forest of its links, never all pairs, so connectivity is whole and the
rows grow with the input. Equal fingerprints (or texts) are one row before the join, whatever their
number; components are found in tables (see ``components``).

``near_duplicates`` is the contract's: all shingles count with repeats, any 64-bit distance up to
``max_bits`` links. ``duplicate_groups`` is for filtering by five-word shingles at a similarity of
0.8: candidates share the least hashes of the set of shingles in one of ``BANDS`` bands (a pair at
0.8 is missed by all with probability 0.0002); pairs whose long SimHashes are far apart are passed
over, and of the others the exact similarity of the sets decides.

Null and empty texts have the fingerprint zero and are linked like others. Texts of fewer words
than a shingle are one shingle. Repeated rows stay, each with the class of its text. Null ids form
a class only by their text. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, giving_back, small_batches
from graphloom.llm.components import components
from graphloom.session import ship

SEED = 42
#: Wanted rows of a subtree; rows joined in one go in a worker; node pairs expanded in one go.
SUBTREE, BUFFER, CHUNK = 256, 60_000, 1 << 20
BUFFER_BYTES = 64 << 20
#: Of duplicate_groups: bands a text, least hashes in a band, 64-bit words of the long SimHash, share
#: of its bits beyond which sets of at least ``LEAST`` shingles are not compared (0.8 is at 0.15, by
#: the angle between the sets, and the estimate spreads by 0.016: five times that is left).
BANDS, BAND_ROWS, LONG_WORDS, LONG_SHARE, LEAST = 16, 4, 8, 0.23, 64


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        bits = np.unpackbits(hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash over XXH64 of the text's shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    found = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]
    return majority(np.array(found, dtype=np.uint64))


def _block_tables(rows: int, max_bits: int) -> list[tuple[int, ...]]:
    """Masks of the tables: the fewest blocks for which a subtree has about ``SUBTREE`` rows."""
    for blocks in range(max_bits + 1, max_bits + 5):
        if rows / 2 ** (64 * (blocks - max_bits) / blocks) <= SUBTREE:
            break
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(c) for c in combinations(masks, blocks - max_bits)]


class Forest:
    """Disjoint sets over rows, joined many pairs at a time; a set's label is its first row."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.label[a] != self.label[b]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.label[a], self.label[b]
            low = np.minimum(x, y)
            np.minimum.at(self.label, x, low)
            np.minimum.at(self.label, y, low)
            while (up := self.label[self.label] != self.label).any():
                self.label[up] = self.label[self.label[up]]
            keep = self.apart(a, b)
            a, b = a[keep], b[keep]


def _products(alo, ahi, blo, bhi) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs of node pairs; of a node with itself each pair once."""
    na, nb = ahi - alo, bhi - blo
    size = na * nb
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    i, j = alo[of] + k // nb[of], blo[of] + k % nb[of]
    keep = (alo[of] != blo[of]) | (i < j)
    return i[keep], j[keep]


def trie_join(fp: np.ndarray, bounds: np.ndarray, max_bits: int, use) -> None:
    """Join the trie of each run ``bounds[k]:bounds[k + 1]`` of ascending fingerprints with itself.

    ``use(i, j)`` gets the rows of pairs within the budget, in pieces of bounded size.
    """
    zeros: dict[int, np.ndarray] = {}

    def split(bit: int) -> np.ndarray:
        if bit not in zeros:
            zeros[bit] = np.concatenate(([0], np.cumsum((fp >> np.uint64(bit)) & np.uint64(1) == 0))).astype(np.int64)
        return zeros[bit]

    def compare(alo, ahi, blo, bhi) -> None:
        size = np.cumsum((ahi - alo) * (bhi - blo))
        for part in np.split(np.arange(len(size)), np.searchsorted(size, np.arange(CHUNK, size[-1] if len(size) else 0, CHUNK))):
            if len(part):
                i, j = _products(alo[part], ahi[part], blo[part], bhi[part])
                near = np.bitwise_count(fp[i] ^ fp[j]) <= max_bits
                use(i[near], j[near])

    lo, hi = bounds[:-1], bounds[1:]
    many = hi - lo > 1
    stack = [(63, np.stack([lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int64)]))]
    while stack:
        bit, front = stack.pop()
        alo, ahi, blo, bhi, _ = front
        small = (ahi - alo) * (bhi - blo) <= 64
        compare(*front[:4, small])
        front = front[:, ~small]
        if bit < 0:  # equal fingerprints, or such with all their differing bits
            for k in range(front.shape[1]):
                a0, a1, b0, b1, _ = front[:, k]
                for at in range(a0, a1, max(1, CHUNK // (b1 - b0))):
                    top = min(a1, at + max(1, CHUNK // (b1 - b0)))
                    i, j = (x.ravel() for x in np.meshgrid(np.arange(at, top), np.arange(b0, b1), indexing="ij"))
                    keep = (i < j) if a0 == b0 else slice(None)
                    use(i[keep], j[keep])
            continue
        if not front.shape[1]:
            continue
        if front.shape[1] > CHUNK:
            stack += [(bit, front[:, at : at + CHUNK // 2]) for at in range(0, front.shape[1], CHUNK // 2)]
            continue
        alo, ahi, blo, bhi, err = front
        z = split(bit)
        amid, bmid, same = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo], alo == blo
        below = np.concatenate([
            np.stack([alo, amid, blo, bmid, err]), np.stack([amid, ahi, bmid, bhi, err]),
            np.stack([alo, amid, bmid, bhi, err + 1]), np.stack([amid, ahi, blo, bmid, err + 1])[:, ~same],
        ], axis=1)
        alo, ahi, blo, bhi, err = below
        stack.append((bit - 1, below[:, (alo < ahi) & (blo < bhi) & (err <= max_bits) & ~((alo == blo) & (ahi - alo == 1))]))


def linked(nodes: DataFrame, fingerprints: list[str], max_bits: int) -> DataFrame:
    """src, dst: a spanning forest, by subtree, of the links between ``nodes`` (id, fingerprints)."""
    ship(nodes.sparkSession)
    rows = nodes.count()
    masks = _block_tables(rows, max_bits)
    if len(fingerprints) * len(masks) * rows == 0:
        return nodes.sparkSession.createDataFrame([], "src long, dst long")
    keyed = [F.struct(F.xxhash64(F.lit(t), F.lit(k), F.col(f).bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)))).alias("key"), F.col(f).alias("fp")) for t, f in enumerate(fingerprints) for k, m in enumerate(masks)]
    dealt = nodes.select("id", F.inline(F.array(*keyed)))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * len(keyed) / 2_000_000))
    dealt = dealt.repartition(parts, "key").sortWithinPartitions("key")

    def flush(table: pa.Table) -> pa.RecordBatch:
        key = table["key"].to_numpy()
        fp = table["fp"].to_numpy().view(np.uint64)
        order = np.lexsort((fp, key))
        key, fp, ids = key[order], fp[order], table["id"].to_numpy()[order]
        forest = Forest(len(key))

        def use(i: np.ndarray, j: np.ndarray) -> None:
            for at in range(0, len(i), CHUNK // 8):
                forest.join(i[at : at + CHUNK // 8], j[at : at + CHUNK // 8])

        trie_join(fp, _runs_of(key), max_bits, use)
        moved = np.nonzero(forest.label != np.arange(len(key)))[0]
        return pa.RecordBatch.from_pydict({"src": ids[moved], "dst": ids[forest.label[moved]]})

    return dealt.mapInArrow(giving_back(lambda batches: _by_key(batches, flush)), "src long, dst long")


def _runs_of(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]))


def _by_key(batches: Iterator[pa.RecordBatch], flush) -> Iterator[pa.RecordBatch]:
    """``flush`` of whole runs of ``key``, a buffer at a time."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        held.append(batch)
        n, size = n + len(batch), size + batch.nbytes
        if n < BUFFER and size < BUFFER_BYTES:
            continue
        table = pa.Table.from_batches(held)
        key = table["key"].to_numpy()
        whole = int(np.searchsorted(key, key[-1]))  # the last run may go on
        if whole:
            yield flush(table.slice(0, whole))
            table = table.slice(whole).combine_chunks()
        held, n, size = table.to_batches(), len(table), table.nbytes
    if n:
        yield flush(pa.Table.from_batches(held))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """key, fp (the 64 bits as a long), component (the smallest key reachable by links)."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    @giving_back
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch["text"].to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array(found.view(np.int64))], [key, "fp"])

    seen = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(prints, f"`{key}` {kind.simpleString()}, fp long")
    seen = cut(seen, "fingerprints")
    classes = cut(seen.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    found = components(linked(classes.select(F.col("fp").alias("id"), "fp"), ["fp"], max_bits))
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    least = joined.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("first").alias("least"))
    of_print = joined.join(least, "component", "left").select("fp", F.coalesce("least", "first").alias("component"))
    return seen.join(of_print, "fp").select(key, "fp", "component")


_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(seed * 0x5851F42D4C957F2D & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, SEED)
        return found


_BAND = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(2 * BANDS * BAND_ROWS)], np.uint64).reshape(2, -1, 1)


def shingle_set(words: list[bytes], shingle: int, known: _WordHash) -> np.ndarray:
    """Ascending hashes of the text's shingles, each once."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    s = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(min(shingle, len(h))):
            s = (s ^ h[j : j + n]) * _ODD
            s ^= s >> np.uint64(31)
    return np.unique(s)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: two sets share it with probability similarity ** BAND_ROWS."""
    flip, odd = _BAND
    least = np.full(BANDS * BAND_ROWS, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1 << 14):
            least = np.minimum(least, ((shingles[at : at + (1 << 14)] ^ flip) * odd).min(axis=1))
        key = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, BAND_ROWS).T:
            key = _mix(key * _ODD ^ column, 7)
    return key


def split_lower(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the similarity of two sets (ascending) is 0.8 or more, in whole numbers."""
    if len(a) > len(b):
        a, b = b, a
    both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
    return 9 * both >= 4 * (len(a) + len(b))


def near_members(table: pa.Table) -> pa.RecordBatch:
    """src, dst: a spanning forest of the links in each bucket (rows of one key)."""
    ids, bounds = table["id"].to_numpy(), _runs_of(table["key"].to_numpy())
    long = np.frombuffer(b"".join(table["long"].to_pylist()), np.uint64).reshape(len(ids), -1)
    bits = int(LONG_SHARE * 64 * LONG_WORDS)
    sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
    n = np.array([len(x) for x in sets])
    src, dst = [], []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        forest = Forest(hi - lo)
        for i in range(hi - lo - 1):
            j = i + 1 + np.nonzero(forest.label[i + 1 :] != forest.label[i])[0]
            low, high = np.minimum(n[lo + i], n[lo + j]), np.maximum(n[lo + i], n[lo + j])
            j = j[(5 * low >= 4 * high) & ((low < LEAST) | (np.bitwise_count(long[lo + i] ^ long[lo + j]).sum(axis=1, dtype=np.int64) <= bits))]
            met = {}
            for k, of in zip(j.tolist(), forest.label[j].tolist(), strict=True):
                if of not in met and similar(sets[lo + i], sets[lo + k]):
                    met[of] = k
            forest.join(np.full(len(met), i), np.array(list(met.values()), np.int64))
        moved = np.nonzero(forest.label != np.arange(hi - lo))[0]
        src.append(ids[lo + moved])
        dst.append(ids[lo + forest.label[moved]])
    return pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)})


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """key, component: groups of texts that are equal (by lower-cased words) or similar by 0.8 and more."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[key].dataType

    @giving_back
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            out = []
            for t in batch["text"].to_pylist():
                words = split_lower(t)
                digest = xxhash.xxh128_digest(b" ".join(words))
                if not words:
                    out.append((digest, [], b""))
                    continue
                s = shingle_set(words, shingle, known)
                long = b"".join(majority(_mix(s, 101 + i)).to_bytes(8, "little") for i in range(LONG_WORDS))
                out.append((digest, band_keys(s).view(np.int64), long))
            yield pa.RecordBatch.from_arrays([batch["k"], pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.binary())], [key, "digest", "bands", "long"])

    seen = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(sketch, f"`{key}` {kind.simpleString()}, digest binary, bands array<long>, long binary")
    seen = cut(seen, "sketches")
    # ids that are no whole numbers are joined by their hashes
    whole = isinstance(kind, T.IntegralType)
    number = F.col("least").cast("long") if whole else F.xxhash64(F.col("least").cast("string"))
    nodes = seen.groupBy("digest").agg(F.min(key).alias("least"), F.min("bands").alias("bands"), F.min("long").alias("long"))
    nodes = cut(nodes.withColumn("id", F.when(F.col("least").isNotNull(), number)), "texts")
    placed = nodes.where(F.col("id").isNotNull()).select(F.explode("bands").alias("key"), "id", "digest", "long")
    # buckets of the same texts are one; those of one text have no pair
    filled = placed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("digest")).alias("x")).where("n > 1")
    buckets = cut(filled.groupBy("n", "x").agg(F.min("key").alias("key")).select("key"), "buckets")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(placed.join(buckets, "key").select("key", "id", "digest", "long"), "members")

    @giving_back
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHash()
        for batch in batches:
            texts = [split_lower(t) for t in batch["text"].to_pylist()]
            sets = [shingle_set(words, shingle, known).tobytes() if words else b"" for words in texts]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(b" ".join(words)) for words in texts], pa.binary()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    of_row = F.col(key).cast("long") if whole else F.xxhash64(F.col(key).cast("string"))
    wanted = docs.select(of_row.alias("id"), F.col(text).alias("text")).join(found.select("id").distinct(), "id", "left_semi")
    sets = wanted.select("text").mapInArrow(gather, "digest binary, shingles binary").groupBy("digest").agg(F.min("shingles").alias("shingles"))
    members = found.join(sets, "digest").select("key", "id", "long", "shingles").repartition(parts, "key").sortWithinPartitions("key", "id")
    linked_ids = components(members.mapInArrow(lambda batches: _by_key(batches, near_members), "src long, dst long"))
    of_text = nodes.select("digest", "id", "least").join(linked_ids.withColumnRenamed("node", "id"), "id", "left")
    if not whole:
        firsts = of_text.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("least").alias("first"))
        of_text = of_text.join(firsts, "component", "left").withColumn("component", F.col("first"))
    of_text = of_text.select("digest", F.coalesce("component", "least").alias("component"))
    return seen.select(key, "digest").join(of_text, "digest").select(key, "component")
