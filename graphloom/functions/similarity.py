"""Similarities: vectors as expressions over arrays, names by edit distance."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str, on_zero: float | None = None) -> Column:
    """Raw cosine; ``on_zero`` (null by default) where a vector has no length."""
    out = F.try_divide(dot(a, b), norm(a) * norm(b))
    return out if on_zero is None else F.coalesce(out, F.lit(on_zero))


def cosine_score(a: Column | str, b: Column | str) -> Column:
    """Cosine moved to 0..1."""
    return (cosine(a, b) + 1) / 2


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def euclidean_score(a: Column | str, b: Column | str) -> Column:
    return 1 / (1 + squared_distance(a, b))


SCORES = {"cosine": cosine_score, "euclidean": euclidean_score}


def vector_literal(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a whole row of the usual table at a time in the bits of a number."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / total length, by the longest common subsequence."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter with any window of its length in the longer, ends cut included."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(indel_ratio(short, w) for w in windows)


def _token_sort(a: str, b: str, ratio) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str, ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both, only_a, only_b = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_a or not only_b):
        return 1.0
    if ratio is _partial:
        return 1.0 if both else ratio(only_a, only_b)
    joined_a, joined_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    found = [ratio(joined_a, joined_b)]
    if both:
        found += [ratio(both, joined_a), ratio(both, joined_b)]
    return max(found)


def default_process(text: str) -> str:
    """Lower case, everything but letters and digits a blank, trimmed."""
    return re.sub(r"[\W_]", " ", text.lower()).strip()


def weighted_ratio(a: str, b: str) -> float:
    """Weighted fuzzy ratio in 0..1 (public definition; not claimed equal to any library's bits)."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    plain = indel_ratio(a, b)
    if longer < 1.5:
        return max(plain, 0.95 * max(_token_sort(a, b, indel_ratio), _token_set(a, b, indel_ratio)))
    scale = 0.9 if longer <= 8 else 0.6
    return max(plain, scale * _partial(a, b), 0.95 * scale * max(_token_sort(a, b, _partial), _token_set(a, b, _partial)))


@F.pandas_udf(T.DoubleType())
def weighted_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def safe_stem(text: str) -> str:
    """File stem of a label: compatibility-decomposed, ASCII, other characters an underscore."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9_]+", "_", plain).strip("_") or "unnamed"


def unique_names(names: list[str]) -> list[str]:
    """Safe stems; a stem met again gets _1, _2 and so on."""
    taken: dict[str, int] = {}
    out = []
    for name in names:
        stem = safe_stem(name)
        n = taken.get(stem, -1) + 1
        taken[stem] = n
        out.append(f"{stem}_{n}" if n else stem)
    return out
