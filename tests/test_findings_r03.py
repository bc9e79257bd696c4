import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions.similarity import weighted_ratio
from graphloom.operators import resolve, simjoin


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def alike(a, b, threshold):
    return 1 - edits(a, b) / max(len(a), len(b), 1) >= threshold


@settings(max_examples=2000, deadline=None)
@given(st.text(alphabet="ab", max_size=14), st.lists(st.tuples(st.integers(0, 14), st.sampled_from(["", "a", "b", "ab"]), st.integers(0, 1)), max_size=5), st.sampled_from([0.3, 0.5, 0.7, 0.8, 0.94, 1.0]))
def test_names_within_the_edits_meet(a, changes, threshold):
    b = a
    for at, new, gone in changes:
        b = b[:at] + new + b[at + gone :]
    if alike(a, b, threshold):
        x, y = sorted((a, b), key=len)
        assert simjoin.edit_signatures(y, threshold)[0] & simjoin.edit_signatures(x, threshold)[1]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.94])
def test_levenshtein_pairs_match_brute_force(spark, threshold):
    rng = np.random.default_rng(6)
    names = ["Customer#%09d" % i for i in rng.integers(0, 3000, 150)] + ["", "", None, "é", "e", "ab", "ba", "x" * 40, "x" * 39 + "y", "😀a", "😀b"]
    rows = [(i, "pq"[int(rng.integers(2))], t, [1, 1, 2, None][int(rng.integers(4))]) for i, t in enumerate(names + names[:40])]
    nodes = spark.createDataFrame(rows, "id long, label string, name string, block int")
    want = {(a, b) for a, la, ta, ka in rows for b, lb, tb, kb in rows if a < b and la == lb and ka == kb and None not in (ka, ta, tb) and alike(ta, tb, threshold)}
    found = resolve.levenshtein_pairs(nodes, "name", threshold, nodes["block"])
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    links = resolve.levenshtein_links(nodes, "name", threshold, nodes["block"])
    assert {tuple(r) for r in links.collect()} <= want | {(b, a) for a, b in want}
    groups = lambda df: {tuple(r) for r in resolve.components(df).collect()}
    assert groups(links) == groups(found)


@pytest.mark.parametrize("name", ["resolve_levenshtein", "resolve_components"])
def test_names_are_not_compared_with_all_of_their_block(spark, tmp_path, name):
    """30,000 names of one block: 450 million pairs, of which only those of one edit are looked at."""
    rows = spark.range(30_000).selectExpr("id AS c_custkey", "'A' AS c_mktsegment", "format_string('Customer#%09d', id * 97) AS c_name", "1 AS c_nationkey")
    rows.write.parquet(f"{tmp_path}/customer.parquet")
    plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan  # decided before, where names met


def test_vectors_meet_as_blocks(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "CELL", 50)
    monkeypatch.setattr(simjoin, "VISITORS", 30)
    monkeypatch.setattr(simjoin, "STRIP", 7)
    rng = np.random.default_rng(8)
    v = [[float(x) for x in r] for r in rng.normal(size=(300, 8)).astype(np.float32)] + [[1.0, 0.0], [3.0, 4.0], [0.0, 0.0], [None, 1.0], [3.0, 4.0]]
    rows = [(f"n{i}", i % 3, x) for i, x in enumerate(v[:300])] + [(f"m{i}", 7, x) for i, x in enumerate(v[300:])] + [("null", 7, None), (None, 7, [3.0, 4.0])]
    nodes = spark.createDataFrame(rows, "id string, label int, embedding array<double>")
    u = np.array(v[:300]) / np.linalg.norm(v[:300], axis=1)[:, None]
    for threshold in (0.35, 0.6):
        found = resolve.vector_pairs(nodes, threshold=threshold)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
        want = {tuple(sorted((f"n{i}", f"n{j}"))) for i in range(300) for j in range(i) if i % 3 == j % 3 and u[i] @ u[j] >= threshold}
        want |= {("m1", "m4")} | ({("m0", "m1"), ("m0", "m4")} if threshold <= 0.6 else set())  # 0.6 is met exactly
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_few_like_names_are_scored(spark):
    """Numbered names have nearly all their bigrams in common; only those within the edits of their ratio are scored."""
    names = ["supplier %09d" % (i * 37) for i in range(400)] + ["000000037 supplier", "supplier", "supplier of the north and 000000037"]
    nodes = spark.createDataFrame([(i, "A", t) for i, t in enumerate(names)], "id long, label string, t string")
    scored = simjoin.name_candidates(nodes, 0.9)
    assert scored.count() < 0.05 * len(names) ** 2 / 2
    want = [(i, j) for i, a in enumerate(names) for j in range(i + 1, len(names)) if weighted_ratio(a, names[j]) >= 0.9]
    assert sorted(tuple(r) for r in simjoin.name_pairs(nodes, 0.9).collect()) == want


def test_vectors_of_few_visit_few_cells(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "CELL", 50)
    rng = np.random.default_rng(9)
    v = rng.normal(size=(240, 8)).astype(np.float32)
    rows = [(i, int(i >= 200), [float(x) for x in r]) for i, r in enumerate(v)] + [(1000 + i, 0, [float(i), 1.0]) for i in range(3)] + [(2000, 1, [0.0] * 8), (2001, 1, [None] * 8)]
    nodes = spark.createDataFrame(rows, "id long, label int, embedding array<float>")
    members, probes, _ = simjoin._placed(nodes.where("size(embedding) = 8"), "embedding", 0.35, ["label"], simjoin.PIVOTS)
    # cells by the number of their keys' vectors: 4 for 200, 1 for 40, whatever the pivots
    assert {r["label"]: r["n"] for r in members.groupBy("label").agg(F.countDistinct("cell").alias("n")).collect()} == {0: 4, 1: 1}
    visits = {r["label"]: r["count"] for r in probes.select("label", "cell", "y").distinct().groupBy("label").count().collect()}
    assert visits[1] == 40
    assert visits[0] <= 4 * 200
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1)[:, None]
    want = {(i, j) for j in range(240) for i in range(j) if (i < 200) == (j < 200) and u[i] @ u[j] >= 0.35}
    want |= {(1000, 1001), (1000, 1002), (1001, 1002)}  # cosines of 0.71, 0.45 and 0.95
    assert sorted(tuple(r) for r in resolve.vector_pairs(nodes, threshold=0.35).collect()) == sorted(want)
