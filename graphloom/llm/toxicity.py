"""Toxicity by nearest labelled examples (operator 8).

Exact TF-IDF cosine over a block-max inverted index of labelled examples; the distance-weighted
votes of the nearest give a score, calibrated on the examples themselves, and the evidence.

The fit reads a bounded sample of labelled rows: ``SAMPLE`` documents, half toxic as far as there
are so many, those with the smallest hash of their id (of an id's texts the least). The sample gives
the vocabulary, all terms that tell the classes apart, and the examples. Document frequencies for the IDF
are counted over all documents. Scoring reads the whole text and nothing else.

Ties between examples go to the smaller id. Null and empty texts and texts without a vocabulary
term have no neighbour and get the share of toxic examples among such examples, weighted back to
the classes' share of all labelled rows. With no labelled row all scores are 0. Repeated rows are
judged alike; other columns are kept and ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import giving_back, small_batches, trim

#: Bound of the fit: sampled documents.
SAMPLE = 6000
#: A term needs so many sampled documents and so many standard errors between the classes.
MIN_DOCS, MIN_Z = 8, 6.0
NEIGHBOURS, BLOCK = 15, 64
THRESHOLD = 0.3

WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class BlockMaxIndex:
    """Postings by term in example order, cut into blocks of examples with the largest weight of each."""

    n: int
    rows: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    block_max: dict[int, np.ndarray]

    @classmethod
    def build(cls, vectors: list[dict[int, float]]) -> BlockMaxIndex:
        rows: dict[int, list] = {}
        for i, v in enumerate(vectors):
            for t, w in v.items():
                rows.setdefault(t, []).append((i, w))
        blocks = -(-len(vectors) // BLOCK)
        at = {t: np.array([i for i, _ in p], np.int64) for t, p in rows.items()}
        weights = {t: np.array([w for _, w in p]) for t, p in rows.items()}
        tops = {}
        for t in at:
            tops[t] = np.zeros(blocks)
            np.maximum.at(tops[t], at[t] // BLOCK, weights[t])
        return cls(len(vectors), at, weights, tops)

    def nearest(self, query: dict[int, float], k: int) -> list[tuple[int, float]]:
        """The k examples of largest positive cosine, exactly; ties to the earlier example.

        The blocks of largest upper bound are opened first; their k-th best score then tells which
        of the others can still hold a better example, and only those are opened.
        """
        query = {t: w for t, w in sorted(query.items()) if t in self.rows}
        if not query:
            return []
        bounds = np.zeros(-(-self.n // BLOCK))
        for t, w in query.items():
            bounds += w * self.block_max[t]
        first = np.zeros(len(bounds), bool)
        first[np.argsort(-bounds, kind="stable")[:4]] = True
        found = self._score(query, first & (bounds > 0))
        floor = -np.partition(-found[1], k - 1)[k - 1] - 1e-12 if len(found[1]) >= k else 0.0
        rest = self._score(query, ~first & (bounds > 0) & (bounds >= floor))
        rows, scores = np.concatenate((found[0], rest[0])), np.concatenate((found[1], rest[1]))
        best = np.lexsort((rows, -scores))[:k]
        return list(zip(rows[best].tolist(), scores[best].tolist(), strict=True))

    def _score(self, query: dict[int, float], opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and positive scores of the opened blocks, by one pass over the query's postings in them."""
        if not opened.any():
            return np.zeros(0, np.int64), np.zeros(0)
        score = np.zeros(self.n)
        for t, w in query.items():
            at = opened[self.rows[t] // BLOCK]
            score[self.rows[t][at]] += w * self.weights[t][at]
        rows = np.nonzero(score > 0)[0]
        return rows, score[rows]


@dataclass
class ToxicModel:
    vocabulary: dict[str, int]
    idf: np.ndarray
    index: BlockMaxIndex
    ids: list
    labels: np.ndarray
    #: Of each example, so that the sample's classes count as among all labelled rows.
    class_weight: tuple[float, float]
    without: float
    #: Raw votes and the calibrated score at each, both ascending.
    curve: tuple[np.ndarray, np.ndarray]

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        raw = {t: (1 + np.log(c)) * self.idf[t] for t, c in counts.items()}
        norm = np.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()} if norm else {}

    def votes(self, near: list[tuple[int, float]]) -> float:
        w = np.array([s * self.class_weight[self.labels[i]] for i, s in near])
        return float((w * self.labels[[i for i, _ in near]]).sum() / w.sum())

    def judge(self, text: str | None) -> tuple[float, list]:
        """Score and evidence: the nearest examples' ids."""
        counts = Counter(self.vocabulary[w] for w in terms(text) if w in self.vocabulary)
        return self.of_counts(counts)

    def of_counts(self, counts: dict[int, int], leave: int = -1) -> tuple[float, list]:
        near = [x for x in self.index.nearest(self.vector(counts), NEIGHBOURS + (leave >= 0)) if x[0] != leave][:NEIGHBOURS]
        if not near:
            return self.without, []
        raw = self.votes(near)
        return float(np.interp(raw, *self.curve)) if len(self.curve[0]) else raw, [self.ids[i] for i, _ in near]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending step curve through weighted points by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        pools.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _empty() -> ToxicModel:
    return ToxicModel({}, np.zeros(0), BlockMaxIndex(0, {}, {}, {}), [], np.zeros(0, int), (1.0, 1.0), 0.0, (np.zeros(0), np.zeros(0)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicModel:
    """``train``: a column over ``key`` that says which labelled rows may be learnt from."""
    small_batches(docs.sparkSession)
    usable = labels.where(train & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    total = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total:
        return _empty()
    half = min(SAMPLE // 2, total.get(1, 0))
    order = (F.xxhash64(key), F.col(key))
    chosen = usable.where("y = 1").orderBy(*order).limit(half).collect() + usable.where("y = 0").orderBy(*order).limit(SAMPLE - half).collect()
    y_of = {r[key]: r["y"] for r in chosen}  # SAMPLE at most

    @giving_back
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bag = [sorted(set(terms(t))) for t in batch["text"]]
            yield pd.DataFrame({"k": batch["k"], "bag": bag})

    kind = docs.schema[key].dataType.simpleString()
    bounded = docs.where(F.col(key).isin(list(y_of))).groupBy(F.col(key).alias("k")).agg(F.min(text).alias("text"))
    seen = bounded.mapInPandas(bags, f"k {kind}, bag array<string>")
    is_toxic = F.col("k").isin([k for k, y in y_of.items() if y == 1])
    by_term = seen.select(is_toxic.alias("toxic"), F.explode("bag").alias("term")).groupBy("term").agg(F.sum(F.col("toxic").cast("long")).alias("a"), F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    n1, n0 = max(1, sum(y_of.values())), max(1, len(y_of) - sum(y_of.values()))
    p1, p0, p = F.col("a") / n1, (F.col("n") - F.col("a")) / n0, F.col("n") / (n1 + n0)
    z = (p1 - p0) / F.sqrt(F.greatest(p * (1 - p) * (1 / n1 + 1 / n0), F.lit(1e-12)))
    top = by_term.select("term", z.alias("z")).where(F.abs("z") >= MIN_Z).collect()  # terms of a bounded sample
    vocabulary = {t: i for i, t in enumerate(sorted(r["term"] for r in top))}

    @giving_back
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = Counter(), 0
        for batch in batches:
            n += len(batch)
            for t in batch["text"]:
                df.update({vocabulary[w] for w in terms(t) if w in vocabulary})
        yield pd.DataFrame({"t": [-1, *df], "n": [n, *df.values()]})

    frequencies = docs.select(F.col(text).alias("text")).mapInPandas(counted, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    df = {r["t"]: r["n"] for r in frequencies}
    idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(t, 0))) + 1 for t in range(len(vocabulary))])

    @giving_back
    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(vocabulary[w] for w in terms(t) if w in vocabulary) for t in batch["text"]]
            yield pd.DataFrame({"k": batch["k"], "t": [list(c) for c in found], "c": [list(c.values()) for c in found]})

    examples = sorted(bounded.mapInPandas(sparse, f"k {kind}, t array<int>, c array<int>").collect(), key=lambda r: r["k"])
    counts = [dict(zip(r["t"], r["c"], strict=True)) for r in examples]
    y = np.array([y_of[r["k"]] for r in examples], int)
    all_n = sum(total.values())
    weight = tuple((total.get(c, 0) / all_n) / max(1, (y == c).sum()) * len(y) for c in (0, 1))
    model = ToxicModel(vocabulary, idf, BlockMaxIndex(0, {}, {}, {}), [r["k"] for r in examples], y, weight, 0.0, (np.zeros(0), np.zeros(0)))
    model.index = BlockMaxIndex.build([model.vector(c) for c in counts])
    bare = np.array([not c for c in counts], bool)
    w = np.array(weight)[y]
    model.without = float((w * y)[bare].sum() / w[bare].sum()) if bare.any() else total.get(1, 0) / all_n
    raw = [(model.of_counts(c, i)[0], i) for i, c in enumerate(counts) if c]
    if raw:  # each example judged by the others
        at = np.array([i for _, i in raw])
        model.curve = isotonic(np.array([r for r, _ in raw]), y[at].astype(float), w[at])
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, text: str = "text", out: str = "_toxicity") -> DataFrame:
    """All columns of ``docs`` and ``out`` (score, evidence: ids as text), in place of one of that name; no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE

    @F.pandas_udf("score double, evidence array<string>")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.judge(t) for t in texts]
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": [[str(i) for i in e] for _, e in found]})
        trim()

    return docs.withColumn(out, judge(F.col(text)))
