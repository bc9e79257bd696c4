import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions.similarity import common_subsequence, weighted_ratio
from graphloom.operators import resolve, simjoin


def brute(rows, threshold, ratio=weighted_ratio):
    return sorted((a, b) for i, (a, la, ta) in enumerate(rows) for b, lb, tb in rows[i + 1 :] if la == lb and ta and tb and ratio(ta, tb) >= threshold)


def meets(a, b, threshold):
    """Whether two names meet if no part is rarer than another in any order: by all parts of their prefixes."""
    x, y = simjoin.signatures(a, threshold), simjoin.signatures(b, threshold)

    def prefix(rows):
        kept, groups = set(), {}
        for kind, role, part, weight, need in rows:
            groups.setdefault((kind, role), []).append((part, weight, need))
        for (kind, role), parts in groups.items():
            rest = 0
            for part, weight, need in sorted(parts, reverse=True):
                rest += weight
                if rest >= need:
                    kept.add((kind, role, part))
        return kept

    p, q = prefix(x), prefix(y)
    return any((k, 2 if k[-1] in "<*" else 1, w) in q for k, r, w in p if r == 1) or any((k, 2 if k[-1] in "<*" else 1, w) in p for k, r, w in q if r == 1)


WORDS = st.lists(st.text(alphabet="abcd", min_size=1, max_size=5), min_size=1, max_size=4).map(" ".join)


@settings(max_examples=1500, deadline=None)
@given(WORDS, WORDS, st.sampled_from([0.5, 0.57, 0.6, 0.7, 0.8, 0.85, 0.855, 0.9, 0.95, 1.0]))
def test_no_pair_above_the_threshold_is_lost(a, b, threshold):
    if weighted_ratio(a, b) >= threshold:
        assert meets(a, b, threshold)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.integers(0, 10**9), st.sampled_from([0.6, 0.8, 0.9]))
def test_edited_names_meet(a, seed, threshold):
    rng = np.random.default_rng(seed)
    b = list(a)
    for _ in range(int(rng.integers(0, 4))):
        at = int(rng.integers(0, len(b) + 1))
        b[at : at + int(rng.integers(0, 2))] = ["abc d"[rng.integers(5)]] * int(rng.integers(0, 2))
    b = "".join(b)
    if weighted_ratio(a, b) >= threshold:
        assert meets(a, b, threshold)


@given(st.text(alphabet="abc", max_size=15), st.text(alphabet="abc", max_size=15))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    assert common_subsequence(a, b) == row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_names_of_a_label_match_brute_force(spark, threshold):
    rng = np.random.default_rng(4)
    base = ["kim", "jim", "tim cook", "cook tim", "john smith", "jon smith", "smith, john paul", "acme corporation ltd", "acme corp", "the acme corporation", "x", "", None, "kim", "bibliotheque nationale"]
    rows = [(i, "AB"[i % 2], t) for i, t in enumerate(base + base)]
    for i in range(60):
        t = list(base[int(rng.integers(0, 11))] or "y")
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(0, len(t)))] = "abcde "[rng.integers(6)]
        rows.append((100 + i, "A", "".join(t)))
    nodes = spark.createDataFrame(rows, "id long, label string, name string")
    got = sorted(tuple(r) for r in resolve.fuzzy_pairs(nodes, threshold=threshold, processed=False).collect())
    assert got == brute(rows, threshold)
    if threshold == 0.6:
        assert any({rows[a][2], rows[b][2]} == {"kim", "jim"} for a, b in got if b < 30)
    assert resolve.fuzzy_pairs(nodes.limit(0), threshold=threshold).count() == 0


def test_vectors_match_brute_force_and_few_are_compared(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "CELL", 40)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16)) * 0.1, np.zeros((3, 16)), np.repeat(centres[:1], 90, axis=0)])
    rows = [(i, ["p", "q"][i % 2], [float(x) for x in r]) for i, r in enumerate(v)] + [(9000, "p", None)]
    nodes = spark.createDataFrame(rows, "id long, label string, embedding array<double>")
    got = sorted(tuple(r) for r in resolve.vector_pairs(nodes, threshold=0.9).collect())
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n == 0, 1, n)[:, None]
    c = u @ u.T
    assert got == [(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if i % 2 == j % 2 and c[i, j] >= 0.9]
    compared = simjoin.vector_candidates(nodes.where("embedding is not null"), "embedding", 0.9, ["label"])
    pairs = compared.select("a", "b")
    assert pairs.distinct().count() == pairs.count() < 0.45 * len(v) * len(v) / 4
    assert resolve.vector_pairs(nodes.limit(0), threshold=0.9).count() == 0
    for bad in (simjoin.name_pairs, simjoin.vector_pairs):
        with pytest.raises(ValueError, match="threshold"):
            bad(nodes.selectExpr("id", "label", "'x' AS t"), *(["t", 0.0, []] if bad is simjoin.vector_pairs else [0.0]))
