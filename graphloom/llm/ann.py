"""Approximate nearest neighbours: inverted file with product-quantised residuals (operator 2).

Coarse centroids and the codebooks of the residuals are fitted on a bounded sample (``SAMPLE``
vectors of smallest hash of their id, fewer where they are long); every valid vector is indexed:
list, residual code, original. A query probes the lists of largest inner product with it, as many
as hold nearly all true neighbours within the sample. In a
list, asymmetric distance tables (query part by codebook entry) score all codes; the best of each
block are scored again on the original vectors, in double precision, then all others whose score is
within the error of their code of the k-th best so far, and the best ``k`` of all blocks are the result.

Lists are dealt out in blocks of about ``BLOCK_ROWS`` rows and the queries of a block in chunks, so
a list that holds a third of all rows (copies of one vector) is many tasks. Equal codes and equal
scores go to the smaller id. Enough lists are probed to find ``k`` rows if there are so many.

Null vectors, zero vectors, vectors with null or non-finite components and vectors whose length is
not the most frequent one (the shorter in a tie) take no part, nor do null ids. Repeated ids are
separate candidates, but no row is a candidate of a query with its id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut
from graphloom.session import ship

#: Bounds of the fit: vectors, and their components altogether.
SAMPLE, SAMPLE_COMPONENTS = 8192, 1 << 21
MIN_LISTS, MAX_LISTS, ROWS_A_LIST = 64, 1024, 4096
#: Codes of a block scored exactly at first (2 k at least), and spreads of
#: the error within which the others follow; parts and entries of a code.
KEPT, SPREADS, PARTS, ENTRIES = 48, 3.0, 16, 256
#: Share of the sample's true neighbours that the probed lists must hold, and queries of the sample that tell it.
IN_LISTS, TRIED = 0.98, 512
#: Pairs scored exactly in one go.
PAIRS = 1 << 17
BLOCK_ROWS = 8192
#: Components of the queries that meet a block in one go.
CHUNK_COMPONENTS = 1 << 22


@dataclass
class Index:
    centroids: np.ndarray
    #: parts x entries x width
    books: np.ndarray
    dim: int
    #: Lists that a query probes.
    probes: int

    def padded(self, v: np.ndarray) -> np.ndarray:
        width = self.books.shape[0] * self.books.shape[2]
        return np.pad(v, ((0, 0), (0, width - v.shape[1])))

    def lists(self, v: np.ndarray) -> np.ndarray:
        return nearest_centroid(v, self.centroids)

    def codes(self, v: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = self.padded(v - self.centroids[lists])
        width = self.books.shape[2]
        return np.stack([nearest_centroid(residual[:, j * width : (j + 1) * width], b) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x entries: inner products of query parts with codebook entries."""
        parts, _, width = self.books.shape
        return np.einsum("qpw,pew->qpe", self.padded(q).reshape(len(q), parts, width), self.books)


def nearest_centroid(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(v[i : i + 8192] @ c.T - half, axis=1) for i in range(0, len(v), 8192)]) if len(v) else np.zeros(0, np.int64)


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        of = nearest_centroid(x, c)
        n = np.bincount(of, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, of, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit_index(sample: np.ndarray, rows: int, k: int = 20) -> Index:
    dim = sample.shape[1]
    lists = min(MAX_LISTS, max(MIN_LISTS, rows // ROWS_A_LIST), max(1, len(sample) // 8))
    centroids = k_means(sample, lists)
    residual = sample - centroids[nearest_centroid(sample, centroids)]
    parts = min(PARTS, dim)
    width = -(-dim // parts)
    residual = np.pad(residual, ((0, 0), (0, parts * width - dim)))
    books = [k_means(residual[:, j * width : (j + 1) * width], ENTRIES, 4) for j in range(parts)]
    entries = max(map(len, books))
    return Index(centroids, np.stack([np.pad(b, ((0, entries - len(b)), (0, 0)), mode="edge") for b in books]), dim, lists_needed(sample, centroids, -(-k * len(sample) // max(rows, len(sample)))))


def lists_needed(sample: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """How many lists, nearest first, hold ``IN_LISTS`` of the sample's ``k`` neighbours of its own vectors.

    ``k`` is the share of the wanted neighbours that falls to the sample, one at least: beyond that the
    neighbours in a sample are farther away than those in the whole, and this errs towards more lists.
    """
    if len(sample) < 2:
        return len(centroids)
    of = nearest_centroid(sample, centroids)
    k = min(k, len(sample) - 1)
    ranks = []
    for rows in np.array_split(np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int), 8):
        part = sample[rows]
        products = part @ sample.T
        products[np.arange(len(rows)), rows] = -np.inf
        near = np.argpartition(-products, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(part @ centroids.T), axis=1, kind="stable"), axis=1)
        ranks.append(np.take_along_axis(place, of[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), IN_LISTS, method="higher")) + 1


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, components added in order: equal vectors get equal scores."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * v[:, j]
    return total


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest of each row; ties to the earlier column."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > edge, scores == edge
    return above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))


def block_best(index: Index, centre: np.ndarray, codes: np.ndarray, ids: np.ndarray, v: np.ndarray, query_id: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id, score of each query's best k rows of a block (ids ascending)."""
    # Of v coded as c, q.c * |v|^2 / v.c estimates q.v; what is left is c's part across v.
    coded = index.padded(centre[None, :]) + np.concatenate([b[codes[:, j]] for j, b in enumerate(index.books)], axis=1)
    coded = coded[:, : v.shape[1]]
    along, length = (v * coded).sum(axis=1), (v * v).sum(axis=1)
    sound = along > 0.25 * length
    factor = np.where(sound, length / np.where(sound, along, 1), 1.0)
    spread = np.linalg.norm(v - coded * factor[:, None], axis=1)
    error = np.where(sound, np.minimum(1.0, SPREADS / np.sqrt(v.shape[1])), 1.0) * spread + 1e-5 * np.sqrt(length)
    near = np.repeat((q @ centre)[:, None], len(ids), axis=1).astype(np.float32)
    tables = index.tables(q).astype(np.float32)
    for j in range(codes.shape[1]):
        near += tables[:, j, codes[:, j]]
    near *= factor.astype(np.float32)
    near[query_id[:, None] == ids[None, :]] = -np.inf

    def products(qi: np.ndarray, vi: np.ndarray) -> np.ndarray:
        return np.concatenate([exact_products(q[qi[at : at + PAIRS]], v[vi[at : at + PAIRS]]) for at in range(0, max(1, len(qi)), PAIRS)])

    first = _best(near, max(KEPT, 2 * k)) & (near > -np.inf)
    qi, vi = np.nonzero(first)
    exact = products(qi, vi)
    order = np.lexsort((-exact, qi))
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi)
    least = np.full(len(q), np.inf)  # fewer than k rows: all are in ``first``
    least[qi[rank == k - 1]] = exact[order][rank == k - 1]
    length_q = np.linalg.norm(q, axis=1)
    more = ~first & (near > -np.inf) & (near + length_q[:, None] * error[None, :] >= least[:, None])
    qm, vm = np.nonzero(more)
    qi, vi, exact = np.concatenate((qi, qm)), np.concatenate((vi, vm)), np.concatenate((exact, products(qm, vm)))
    order = np.lexsort((ids[vi], -exact, qi))
    qi, vi, exact = qi[order], vi[order], exact[order]
    top = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return query_id[qi[top]], ids[vi[top]], exact[top]


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: of each valid row for which ``is_query`` (over ``id``) holds."""
    spark = vectors.sparkSession
    ship(spark)
    rows = cut(valid_vectors(vectors, key, vector), "vectors")
    total = rows.count()
    schema = "query_id long, rank int, id long, score double"
    if total < 2:
        return spark.createDataFrame([], schema)
    dim = rows.select(F.size("v").alias("n")).first()["n"]
    size = max(1, min(SAMPLE, SAMPLE_COMPONENTS // dim))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(size).collect()])
    index = spark.sparkContext.broadcast(fit_index(sample, total, k))  # MAX_LISTS x dim, and the books

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                v = matrix(batch["v"])
                of = index.value.lists(v)
                codes = index.value.codes(v, of)
                yield pa.RecordBatch.from_pydict({"list": of.astype(np.int32), "id": batch["id"], "v": batch["v"], "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    filed = cut(rows.mapInArrow(fill, "list int, id long, v array<double>, code binary"), "lists")
    sizes = {r["list"]: r["n"] for r in filed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
    blocks = {of: -(-n // BLOCK_ROWS) for of, n in sizes.items()}
    queries = filed.where(is_query).select("id", "v")
    probes = index.value.probes
    wanted = min(k + 1, total)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.array([sizes.get(c, 0) for c in range(len(index.value.centroids))])
        for batch in batches:
            q = matrix(batch["v"]) if len(batch) else np.zeros((0, 1))
            order = np.argsort(-(q @ index.value.centroids.T), axis=1, kind="stable") if len(batch) else np.zeros((0, 1), int)
            at, of, part = [], [], []
            for i, lists in enumerate(order):
                n = max(probes, int(np.searchsorted(np.cumsum(known[lists]), wanted)) + 1)
                for c in lists[:n]:
                    for b in range(blocks.get(int(c), 0)):
                        at.append(i)
                        of.append(c)
                        part.append(b)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_pydict({"list": pa.array(of, pa.int32()), "block": pa.array(part, pa.int32()), "query_id": batch["id"].take(take), "q": batch["v"].take(take)})

    probing = queries.mapInArrow(probe, "list int, block int, query_id long, q array<double>")
    # a list's queries go in chunks of bounded size, and its vectors once to each
    asked = {r["list"]: r["n"] for r in probing.where("block = 0").groupBy("list").agg(F.count("*").alias("n")).collect()}  # MAX_LISTS rows
    chunks = {of: max(1, -(-asked.get(of, 0) * dim // CHUNK_COMPONENTS)) for of in blocks}
    chunks_of = F.create_map(*(F.lit(x) for p in sorted(chunks.items()) for x in p))
    probing = probing.withColumn("chunk", F.pmod(F.xxhash64("query_id"), chunks_of[F.col("list")]).cast("int"))
    of_list = F.create_map(*(F.lit(x) for p in sorted(blocks.items()) for x in p))
    dealt = filed.withColumn("block", F.pmod(F.xxhash64("id"), of_list[F.col("list")]).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks_of[F.col("list")] - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_pydict({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        right = right.sort_by("id")
        q, v = matrix(left["q"].combine_chunks()), matrix(right["v"].combine_chunks())
        query_id, ids = left["query_id"].to_numpy(), right["id"].to_numpy()
        codes = np.frombuffer(b"".join(right["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        centre = index.value.centroids[right["list"][0].as_py()]
        out = []
        for i in range(0, len(q), 256):
            out.append(block_best(index.value, centre, codes, ids, v, query_id[i : i + 256], q[i : i + 256], k))
        return pa.Table.from_pydict({n: np.concatenate([o[x] for o in out]) for x, n in enumerate(("query_id", "id", "score"))})

    keys = ("list", "block", "chunk")
    found = probing.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(score, "query_id long, id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
