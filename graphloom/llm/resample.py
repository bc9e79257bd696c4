"""Importance resampling towards a target corpus over bucket-partitioned inverted postings (operator 12).

Features are runs of 1 to ``grams`` consecutive words; a feature's bucket is the crc32 of its bytes
modulo ``buckets``. A document is drawn with a probability that grows with the ratio of the target's
and its own corpus's likelihood, as the highest scores of weight plus Gumbel noise (no replacement).

1. One pass counts each document's features and inverts a run of documents at a time: a posting
   list for each bucket (documents, counts) and a row for each document, in one written table.
2. Posting lists are shuffled by bucket and part, a hash of the run they come from, so that a word of
   all documents is no hot key: no list is longer than a run, and parts are dealt over all tasks.
3. Each part sums its own lists' counts; with the target's counts of the same bucket, which meet
   them there, they give the bucket's gain. Only sums, one a part, leave the bucket.
4. Postings times gain are contributions, summed by document (first within each task).
5. Documents are sorted by range of their score; a rank is the place in the range after the sizes
   of the ranges before. Nothing is ranked in one task.

Null and empty texts have no words; their weight is 0 and they are never drawn where ``min_words`` is
over 0. Rows are documents one by one, repeated rows included; a null id takes the noise of the empty
id and comes last in ties; rows of one id and one score are in order of their features' number. An
empty table gives an empty result, an empty target takes part with no features. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, small_batches

BUCKETS, GRAMS, PERCENT, MIN_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Documents, and postings, that are inverted together, at most (a single document may have more).
RUN_DOCS, RUN_POSTINGS = 16_384, 1_000_000
#: Entries of a worker's table of known features.
CACHE = 300_000
#: A-Z as a-z, all that is no part of a word as a space.
_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """Runs outside ASCII punctuation, space and control characters, A-Z lower-cased."""
    return (text or b"").translate(_BYTES).split()


class _Bucket(dict):
    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def inverted(docs: DataFrame, key: str, text: str, buckets: int, grams: int) -> DataFrame:
    """For each row: row, k, n_words, n_features; for each bucket of a run of rows: bucket, s, docs, counts."""
    kind = docs.schema[key].dataType
    names = ["row", "k", "n_words", "n_features", "bucket", "s", "docs", "counts"]

    def lists(rows: list[np.ndarray], of: list[np.ndarray], k_type: pa.DataType) -> pa.RecordBatch:
        # a stable sort by bucket keeps a list's documents in order
        row, bucket = np.concatenate(rows), np.concatenate(of)
        order = np.argsort(bucket, kind="stable")
        row, bucket = row[order], bucket[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]))))
        row, bucket, count = row[first], bucket[first], np.diff(np.append(first, len(row))).astype(np.int32)
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        ends, n = pa.array(np.append(start, len(row)).astype(np.int32)), len(start)
        nothing = [pa.nulls(n, t) for t in (pa.int64(), k_type, pa.int64(), pa.int64())]
        sums = np.add.reduceat(count.astype(np.int64), start)
        return pa.RecordBatch.from_arrays([*nothing, pa.array(bucket[start]), pa.array(sums), pa.ListArray.from_arrays(ends, row), pa.ListArray.from_arrays(ends, count)], names)

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Bucket(buckets)
        rows, of, docs_held, held, k_type = [], [], 0, 0, None
        for batch in batches:
            n_words, n_features, k_type = [], [], batch["k"].type
            for row, raw in zip(batch["row"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = split_words(raw)
                found = list(map(known.__getitem__, words))
                for n in range(2, grams + 1):
                    found += [known[b" ".join(words[i : i + n])] for i in range(len(words) - n + 1)]
                n_words.append(len(words))
                n_features.append(len(found))
                if found:
                    of.append(np.array(found, np.int32))
                    rows.append(np.full(len(found), row, np.int64))
                docs_held, held = docs_held + 1, held + len(found)
                if docs_held >= RUN_DOCS or held >= RUN_POSTINGS:
                    if of:
                        yield lists(rows, of, k_type)
                    rows, of, docs_held, held = [], [], 0, 0
            m = len(batch)
            made = [pa.array(x, pa.int64()) for x in (n_words, n_features)]
            nothing = [pa.nulls(m, t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch["row"], batch["k"], *made, *nothing], names)
        if of:
            yield lists(rows, of, k_type)

    schema = f"row long, k {kind.simpleString()}, n_words long, n_features long, bucket int, s long, docs array<long>, counts array<int>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(invert, schema)


def _ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """k, n_features, weight, score, rank: 1 to ``drawn`` of the rows that may be drawn, in order."""
    order = [F.col("may").desc(), F.col("score").desc(), F.col("k").asc_nulls_last(), F.col("n_features").asc(), F.col("row").asc()]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(spread.select("k", "n_features", "weight", "score", "may", F.spark_partition_id().alias("part"), place.alias("place")), "ranked")
    # a row for each part
    before = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(before), "part").select("k", "n_features", "weight", "score", F.when(F.col("may") & (rank <= drawn), rank).alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, grams: int = GRAMS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED,
) -> DataFrame:
    """key, n_features, weight, score, rank of every row; rank is null for those not drawn."""
    if buckets < 1 or grams < 1 or not 0 <= percent <= 100:
        raise ValueError("buckets and grams are 1 or more, percent is 0 to 100")
    small_batches(docs.sparkSession)
    index = cut(inverted(docs, key, text, buckets, grams), "postings")
    each, may = index.where("bucket is null"), F.col("n_words") >= min_words
    sizes = each.agg(F.count("*").alias("n"), F.count_if(may).alias("may"), F.coalesce(F.sum("n_features"), F.lit(0)).alias("s")).first()
    aims = cut(inverted(target, target_text, target_text, buckets, grams).where("bucket is not null").groupBy("bucket").agg(F.sum("s").alias("t")), "target")
    t_all = aims.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]

    parts = max(1, -(-sizes["n"] // RUN_DOCS))
    part = F.pmod(F.xxhash64(F.col("docs")[0]), F.lit(parts)).cast("int").alias("part")
    lists = index.where("bucket is not null").select("bucket", part, "s", "docs", "counts")
    local = lists.groupBy("bucket", "part").agg(F.sum("s").alias("s"))
    # one row a bucket: the two corpora's counts meet
    both = local.groupBy("bucket").agg(F.sum("s").alias("s")).join(aims, "bucket", "left")
    likelier = (F.coalesce("t", F.lit(0)) + 1).cast("double") * F.lit(float(sizes["s"] + buckets))
    rarer = (F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets))
    gains = both.select("bucket", F.floor(F.lit(1000.0) * F.log(likelier / rarer)).cast("long").alias("gain"))
    of_part = local.select("bucket", "part").join(gains, "bucket")
    posted = lists.drop("s").join(of_part.hint("shuffle_hash"), ["bucket", "part"]).select("gain", F.inline(F.arrays_zip(F.col("docs").alias("row"), F.col("counts").alias("n"))))
    weights = posted.groupBy("row").agg(F.sum(F.col("n") * F.col("gain")).alias("w"))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    weight = F.coalesce("w", F.lit(0)).cast("long")
    scored = each.select("row", "k", "n_features", may.alias("may")).join(weights, "row", "left")
    scored = cut(scored.select("row", "k", "n_features", "may", weight.alias("weight"), (weight + noise).alias("score")), "scored")
    return _ranked(scored, percent * sizes["may"] // 100).withColumnRenamed("k", key)
