"""Language identification with language-bitmask n-gram filters (operator 5).

Training counts, for each language, the documents that hold each character n-gram (lower-cased
letters, one blank around words). An n-gram enters a language's filter if its share there reaches
``MIN_SHARE``. The filters are bit-sliced Bloom filters: one table of bit masks, a bit for each
language, so that two probes and an AND return all languages that hold an n-gram. A text is decided
by the popcount of each language over its n-grams, less the hits that false positives explain.

The fit reads a bounded sample: ``SAMPLE_PER_LANG`` labelled documents a language, those with the
smallest hash of their id, repeated rows once. Prediction reads the whole text and nothing else. Null texts and texts
without a letter are ``und`` with score 0. Ties go to the first language in order. With no labelled
row, every text is ``und``. Texts too short for an n-gram of the filters get the first language at
score 1 / languages. Repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import small_batches

#: Bound of the training sample.
SAMPLE_PER_LANG = 500
#: n of the n-grams; the share of a language's sample that must hold one; slots of the table.
SIZES, MIN_SHARE, SLOTS, PROBES = (2, 3, 4), 0.02, 1 << 20, 2
#: Languages in one word of a slot's mask; a slot has as many words as the languages need.
WORD_LANGS = 16

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; everything but letters is 0, one at a time, also around."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if low.isascii():
        letter = (codes >= 97) & (codes <= 122)
    else:
        kinds = np.unique(codes)
        letter = np.isin(codes, kinds[[chr(c).isalpha() for c in kinds]])
    codes = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def ngram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all n-grams of all sizes, repeats included."""
    codes, out = _letters(text), []
    if len(codes) <= 2 and not codes.any():
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(codes) < n:
                continue
            h = np.full(len(codes) - n + 1, n, np.uint64)
            for j in range(n):
                h = (h ^ codes[j : len(codes) - n + 1 + j]) * _MIX[0]
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _slots(h: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((h * _MIX[1 + p]) >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64) for p in range(PROBES)]


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    #: uint16 masks: words x slots.
    table: np.ndarray
    #: By language: the chance that an n-gram outside its filter seems to be in it.
    false_rate: np.ndarray

    def score(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not any(c.isalpha() for c in text):
            return "und", 0.0
        h = ngram_hashes(text)
        slots, pop = _slots(h), []
        for word in self.table:
            masks = word[slots[0]]
            for s in slots[1:]:
                masks = masks & word[s]
            counts = np.bincount(masks, minlength=1)
            seen = np.nonzero(counts)[0]
            pop += [counts[seen[(seen >> k) & 1 == 1]].sum() for k in range(min(WORD_LANGS, len(self.langs) - len(pop)))]
        pop = np.array(pop, float)
        true = np.maximum(0.0, (pop - len(h) * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(true))
        return self.langs[best], float(true[best] / true.sum()) if true.sum() else 1 / len(self.langs)


def needed(docs: int) -> float:
    """In how many of a language's sampled documents an n-gram of its filter stands at least."""
    return max(min(2, docs), MIN_SHARE * docs)


def build_model(counts: dict[str, Counter], sizes: dict[str, int]) -> LangModel:
    langs = tuple(sorted(counts))
    table = np.zeros((-(-len(langs) // WORD_LANGS), SLOTS), np.uint16)
    for k, lang in enumerate(langs):
        held = np.array([h for h, n in counts[lang].items() if n >= needed(sizes[lang])], dtype=np.uint64)
        bits = np.zeros(SLOTS, bool)
        for s in _slots(held):
            bits[s] = True
        table[k // WORD_LANGS] |= bits.astype(np.uint16) << np.uint16(k % WORD_LANGS)
    fill = np.array([((table[k // WORD_LANGS] >> np.uint16(k % WORD_LANGS)) & 1).mean() for k in range(len(langs))])
    return LangModel(langs, table, fill**PROBES)


def fit_languages(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LangModel:
    """Fit on at most ``SAMPLE_PER_LANG`` documents a language, all of them whole."""
    small_batches(docs.sparkSession)
    usable = docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("k"), "k", "t"))
    chosen = usable.select("k", "lang", F.xxhash64("text").alias("t")).withColumn("rank", rank).where(F.col("rank") <= SAMPLE_PER_LANG).drop("rank").distinct()
    chosen = [(r["k"], r["lang"], r["t"]) for r in chosen.collect()]  # SAMPLE_PER_LANG rows a language
    if not chosen:
        return LangModel((), np.zeros((0, SLOTS), np.uint16), np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        docs_of: Counter = Counter()
        for batch in batches:
            for of, body in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found.setdefault(of, Counter()).update(np.unique(ngram_hashes(body)).tolist())
                docs_of[of] += 1
        for of, c in found.items():
            h = np.fromiter(c.keys(), np.uint64, len(c)).view(np.int64)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([of] * len(c), pa.string()), "h": h, "n": np.fromiter(c.values(), np.int64, len(c)), "docs": np.zeros(len(c), np.int64)})
        zeros = np.zeros(len(docs_of), np.int64)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(docs_of), pa.string()), "h": zeros, "n": zeros, "docs": pa.array(list(docs_of.values()), pa.int64())})

    sampled = docs.sparkSession.createDataFrame(chosen, f"k {docs.schema[key].dataType.simpleString()}, lang string, t long")
    meets = F.col("u.k").eqNullSafe(F.col("s.k")) & (F.col("u.lang") == F.col("s.lang")) & (F.xxhash64("u.text") == F.col("s.t"))
    # repeated rows count once
    rows = usable.alias("u").join(F.broadcast(sampled.alias("s")), meets, "left_semi").dropDuplicates(["k", "lang", "text"]).select("lang", "text")
    summed = rows.mapInArrow(count, "lang string, h long, n long, docs long").groupBy("lang", "h").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    least = {of: float(needed(n)) for of, n in Counter(x[1] for x in chosen).items()}
    enough = docs.sparkSession.createDataFrame(list(least.items()), "lang string, least double")
    summed = summed.join(F.broadcast(enough), "lang").where((F.col("n") >= F.col("least")) | (F.col("docs") > 0))
    counts: dict[str, Counter] = {}
    sizes: dict[str, int] = {}
    for r in summed.toPandas().itertuples():  # n-grams of a bounded sample, frequent ones
        counts.setdefault(r.lang, Counter())[r.h & 0xFFFFFFFFFFFFFFFF] += r.n
        sizes[r.lang] = sizes.get(r.lang, 0) + r.docs
    return build_model(counts, sizes)


def predict_languages(docs: DataFrame, model: LangModel, text: str = "text", out: str = "_language") -> DataFrame:
    """All columns of ``docs`` and ``out`` (lang, score), in place of one of that name; a row-wise pass, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB for 16 languages

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.score(t) for t in texts]
        return pd.DataFrame(found, columns=["lang", "score"])

    return docs.withColumn(out, judge(F.col(text)))
