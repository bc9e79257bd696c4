import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import ann, components, lang_id, simhash, substring_dedup, toxicity
from graphloom.llm.common import held_out

DOCS = "doc_id long, text string, lang string"


# ---- 2 nearest neighbours


def exact(rows, q, k=20):
    v = dict(rows)[q]
    s = sorted((-float(sum(a * b for a, b in zip(v, w, strict=True))), i) for i, w in rows if i != q)
    return [i for _, i in s[:k]]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann, "CHUNK_COMPONENTS", 128)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(800)]
    rows += [(i, rows[40][1]) for i in range(800, 1200)]  # a third are copies of one vector
    bad = [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, [1.0, None] * 4), (2100, [1.0] * 5), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash"))
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert set(got) == set(range(0, 1200, 20))
    hit = 0
    for q, found in got.items():
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        for _, i, s in found:
            assert s == pytest.approx(float(np.dot(dict(rows)[q], dict(rows)[i])), abs=1e-12)
        hit += len(set(exact(rows, q)) & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    assert [f[1] for f in got[40]] == exact(rows, 40)  # ties: the smallest ids of the copies


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 1.0]), (20, [3.0, -1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in ann.search(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 20), (20, 1, 0), (20, 2, 1)]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("centres", [0, 500])
def test_recall_over_many_vectors(spark, tmp_path, centres):
    """100,000 vectors, without and with clusters, in lists of thousands."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(7)
    n, dim = 100_000, 24
    v = rng.normal(size=(n, dim))
    if centres:
        v = 3 * rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.3 * v
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(v.ravel(), dim).cast(pa.list_(pa.float64()))}), f"{tmp_path}/v.parquet")
    found = ann.search(spark.read.parquet(f"{tmp_path}/v.parquet"), F.col("id") % 1000 == 0).toPandas()
    got = {q: set(g["id"]) for q, g in found.groupby("query_id")}
    assert len(got) == 100
    hits = 0
    for q, ids in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(ids & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits / 2000 >= 0.9
    sample = v[rng.choice(n, 4000, replace=False)]
    index = ann.fit_index(sample, n)
    if centres:  # clusters: few lists hold the neighbours
        assert index.probes <= len(index.centroids) / 4


@pytest.mark.parametrize(("groups", "each", "k"), [(1, 100, 20), (8, 300, 20), (2, 1000, 20), (0, 0, 20), (2, 300, 100)])
def test_groups_of_near_copies_in_a_block(groups, each, k):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4000, 64))
    for g in range(groups):
        v[g * each : (g + 1) * each] = v[g * each] + 0.05 * rng.normal(size=(each, 64))
    v = v[rng.permutation(len(v))] if not groups else v
    index = ann.fit_index(v[rng.choice(len(v), 2000, replace=False)], len(v))
    lists = index.lists(v)
    inside = lists[0] if groups else np.bincount(lists).argmax()
    rows = np.flatnonzero(lists == inside)
    queries = rows[:40]
    got = ann.block_best(index, index.centroids[inside], index.codes(v[rows], lists[rows]), rows, v[rows], queries, v[queries], k)
    hits = [len({*got[1][got[0] == q]} & {*(best := rows[rows != q][np.argsort(-(v[rows[rows != q]] @ v[q]), kind="stable")[:k]])}) / len(best) for q in queries]
    assert np.mean(hits) >= 0.98


# ---- 5 languages


def corpus(rng, n):
    parts = {"en": ["the", "ing", "th", "wh", "sh"], "de": ["ung", "sch", "ein", "ich", "ß"], "fr": ["eau", "oi", "é", "ent", "qu"]}
    return [(i, " ".join("".join(rng.choice(parts[lang], 2)) for _ in range(30)), lang) for i in range(n) for lang in [list(parts)[i % 3]]]


def test_languages(spark):
    rows = corpus(np.random.default_rng(0), 300)
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !? 😀", "fr"), (903, "a", None), (904, "schung " * 30_000, "de"), (905, "eauqu", None)]
    df = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("clash"))
    model = lang_id.fit_languages(df, ~held_out(F.col("doc_id")))
    got = {r["doc_id"]: r["_language"] for r in lang_id.predict_languages(df, model).collect()}
    assert np.mean([got[i]["lang"] == lang for i, _, lang in rows]) > 0.98
    assert [got[i]["lang"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0.0
    assert got[904]["lang"] == "de" and got[905]["lang"] == "fr" and got[903]["lang"] in model.langs
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = lang_id.fit_languages(df.limit(0), ~held_out(F.col("doc_id")))
    assert lang_id.predict_languages(df, empty).where("_language.lang <> 'und'").count() == 0


def test_many_languages_and_single_documents(spark):
    """More languages than a word of a mask holds; one document is enough for a filter."""
    rng = np.random.default_rng(5)
    sounds = ["".join(chr(97 + x) for x in rng.integers(0, 26, 3)) for _ in range(160)]
    text = lambda k, n: " ".join("".join(rng.choice(sounds[4 * k : 4 * k + 4], 2)) for _ in range(n))
    rows = [(100 * k + i, text(k, 60), f"l{k:02}") for k in range(40) for i in range(1 if k == 39 else 6)]
    rows += [rows[0]] * 3
    model = lang_id.fit_languages(spark.createDataFrame(rows, DOCS), F.lit(True))
    assert len(model.langs) == 40 and model.table.shape[0] == 3
    assert all(model.score(text(k, 40))[0] == f"l{k:02}" for k in range(40))


def test_languages_match_exact_sets(spark):
    """The Bloom filters' answers are those of plain sets of n-grams, over a whole supplied table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = ~held_out(F.col("doc_id"))
    rows = docs.select("doc_id", "text", "lang", train.alias("t")).collect()
    sets, n = {}, {}
    for r in rows:
        if r["t"] and r["lang"] and r["text"] is not None:
            n[r["lang"]] = n.get(r["lang"], 0) + 1
            for h in set(lang_id.ngram_hashes(r["text"]).tolist()):
                sets.setdefault(r["lang"], {}).setdefault(h, 0)
                sets[r["lang"]][h] += 1
    assert max(n.values()) <= lang_id.SAMPLE_PER_LANG
    sets = {x: {h for h, c in s.items() if c >= max(2, lang_id.MIN_SHARE * n[x])} for x, s in sets.items()}
    got = {r["doc_id"]: r["_language"] for r in lang_id.predict_languages(docs, lang_id.fit_languages(docs, train)).collect()}
    for r in rows:
        grams = lang_id.ngram_hashes(r["text"] or "").tolist()
        hits = [(sum(h in sets[x] for h in grams), x) for x in sorted(sets)]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang"] == "und"
        elif sum(h for h, _ in hits):
            top = max(h for h, _ in hits)
            assert got[r["doc_id"]]["score"] == pytest.approx(top / sum(h for h, _ in hits), abs=0.02)
            if sum(h > top - 3 for h, _ in hits) == 1:
                assert got[r["doc_id"]]["lang"] == max(hits)[1]


def test_false_positives_are_taken_off():
    held = lang_id.ngram_hashes("the thing")
    model = lang_id.build_model({"a": {int(h): 9 for h in held}, "b": {}}, {"a": 9, "b": 9})
    assert model.score("the thing") == ("a", 1.0)
    assert model.false_rate[1] == 0


# ---- 6 SimHash


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, k):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= k and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_fingerprints_and_components(spark):
    rng = np.random.default_rng(2)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 999, 150)) for _ in range(25)]
    texts = base + [b.replace("w1", "v1", 1) for b in base] + base[:5] * 3 + ["", None, "One", "one  ", "a b", "É é x y", "x " * 20_000]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = sorted((r["doc_id"], r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(df).collect())
    fps = [brute_fp(t) for t in texts]
    assert [g[1] for g in got] == fps
    assert [g[2] for g in got] == classes(fps, 2)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("max_bits", "n", "subtree"), [(2, 400, 256), (2, 400, 1e-7), (4, 300, 256)])
def test_trie_join_finds_every_link(spark, monkeypatch, max_bits, n, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 2**63, 12)
    fps = [int(c) for c in centres]
    while len(fps) < n:
        x = int(rng.choice(centres))
        for b in rng.integers(0, 63, int(rng.integers(1, 7))):
            x ^= 1 << int(b)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "id long, fp long")
    found = {r["node"]: r["component"] for r in components.components(simhash.linked(df, ["fp"], max_bits)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps, max_bits)


def test_trie_join_pairs_are_those_within_the_budget():
    rng = np.random.default_rng(4)
    fp = np.sort(rng.integers(0, 2**10, 700).astype(np.uint64))
    found = set()
    simhash.trie_join(fp, np.array([0, 300, 700]), 2, lambda i, j: found.update(zip(i.tolist(), j.tolist(), strict=True)))
    want = {(i, j) for lo, hi in ((0, 300), (300, 700)) for i in range(lo, hi) for j in range(i + 1, hi) if bin(int(fp[i] ^ fp[j])).count("1") <= 2}
    assert {(min(p), max(p)) for p in found} == want


def test_duplicate_groups(spark):
    rng = np.random.default_rng(9)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) for _ in range(30)]
    near = [b.replace(b.split()[50], "odd").replace(b.split()[120], "other") for b in base]
    texts = base + near + base[:4] + ["", None, "short one", "Short  one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in simhash.duplicate_groups(df).collect()}
    assert all(got[i] == i for i in range(30))
    assert all(got[60 + i] == i for i in range(4)) and got[65] == got[64] and got[67] == got[66]
    assert sum(got[30 + i] == i for i in range(30)) >= 29
    assert simhash.duplicate_groups(df.limit(0)).count() == 0


def near_copies(rng, edit, n):
    """Rows of (text, its copy with ``edit`` words of a block or scattered ones changed), and their similarity."""
    rows, sims = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(80, 600)))]
        m = max(1, int(len(words) * rng.uniform(0.04, 0.25)))
        other, at = list(words), int(rng.integers(0, len(words) - m))
        if edit == "append":
            other += [f"x{x}" for x in rng.integers(0, 10**6, m)]
        elif edit == "cut":
            other = other[:-m]
        elif edit == "block":
            other[at : at + m // 2] = [f"x{x}" for x in rng.integers(0, 10**6, m // 2)]
        else:
            for k in rng.choice(len(words), max(1, m // 7), replace=False):
                other[k] = f"x{rng.integers(0, 10**6)}"
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (words, other))
        sims.append(len(a & b) / len(a | b))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    return rows, np.array(sims)


@pytest.mark.parametrize("edit", ["append", "cut", "block", "scattered"])
def test_recall_of_near_copies(spark, edit):
    rows, sims = near_copies(np.random.default_rng(11), edit, 200)
    got = {r["doc_id"]: r["component"] for r in simhash.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = np.array([got[2 * i + 1] == 2 * i for i in range(len(sims))])
    assert (sims >= 0.8).sum() >= 50 and linked[sims >= 0.8].mean() >= 0.97


def test_ids_that_are_text(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("b", " ".join(words)), ("a10", " ".join(words[:59] + ["x"])), ("a9", "something else here"), (None, "something else here"), ("z", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["component"]) for r in simhash.duplicate_groups(df).collect()}
    assert got == {("b", "a10"), ("a10", "a10"), ("a9", "a9"), (None, "a9"), ("z", "z")}
    kept = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_substrings(df).collect()}
    assert kept == {("a10", 0), ("b", 59), ("a9", 0), (None, 0), ("z", 0)}


def test_only_pairs_of_similarity_0_8_are_linked(spark):
    rows, sims = near_copies(np.random.default_rng(12), "scattered", 300)
    rows += [(1000, "a b c d e f g h"), (1001, "a b c d e f g"), (1002, "p q r s t u v w x"), (1003, "p q r s t u v w")]  # 3 of 4 and 4 of 5 shingles
    got = {r["doc_id"]: r["component"] for r in simhash.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = np.array([got[2 * i + 1] == 2 * i for i in range(len(sims))])
    assert not linked[sims < 0.8].any() and ((sims > 0.7) & (sims < 0.8)).sum() >= 20
    assert linked[sims >= 0.8].mean() >= 0.99
    assert got[1001] == 1001 and got[1003] == 1002


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 300)] + [(5, 5), (400, 400)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 200 for i in range(200, 300)) and 400 not in got


# ---- 8 toxicity


def toxic_corpus(rng, n):
    rows = []
    for i in range(n):
        words = [f"w{x}" for x in rng.integers(0, 3000, 60)]
        y = int(rng.random() < 0.15)
        if y:
            words[10:14] = list(rng.choice(["vile", "scum", "fool", "trash"], 4))
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus(np.random.default_rng(6), 900)
    odd = [(5000, None), (5001, ""), (5002, "scum vile trash fool " * 4000), (5003, "SCUM### vile!!!")]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + odd, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (1, 1, None), (7777, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, labels, ~held_out(F.col("doc_id")))
    got = {r["doc_id"]: r["_toxicity"] for r in toxicity.score_toxicity(df, model).collect()}
    out = [(got[i]["score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows]
    assert np.mean(out) > 0.98
    assert got[5000]["score"] == got[5001]["score"] < 0.3 and got[5000]["evidence"] == []
    assert got[5002]["score"] > 0.3 and got[5003]["score"] > 0.3 and got[5002]["evidence"]
    none = toxicity.fit_toxicity(df, labels.limit(0), F.lit(True))
    assert toxicity.score_toxicity(df, none).where("_toxicity.score <> 0").count() == 0


def test_scores_match_brute_force(spark):
    """Every score of a supplied table from plain cosines with all examples, votes and curve included."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id")))
    assert len(model.curve[0])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    # IDF over all documents, and the examples' vectors, counted anew
    bags = {d: toxicity.Counter(w for w in toxicity.terms(t) if w in model.vocabulary) for d, t in texts.items()}
    df = toxicity.Counter(w for b in bags.values() for w in b)
    for w, i in model.vocabulary.items():
        assert model.idf[i] == pytest.approx(np.log((1 + len(texts)) / (1 + df[w])) + 1)

    def dense(bag):
        v = np.zeros(len(model.vocabulary))
        for w, c in bag.items():
            v[model.vocabulary[w]] = (1 + np.log(c)) * model.idf[model.vocabulary[w]]
        return v / (np.linalg.norm(v) or 1)

    examples = np.array([dense(bags[i]) for i in model.ids])
    weight = np.array(model.class_weight)[model.labels]
    for r in toxicity.score_toxicity(docs, model).collect():
        cos = np.round(examples @ dense(bags[r["doc_id"]]), 12)
        near = [i for i in np.argsort(-cos, kind="stable")[: toxicity.NEIGHBOURS] if cos[i] > 0]
        if not near:
            assert r["_toxicity"]["score"] == pytest.approx(model.without)
            continue
        raw = (cos[near] * weight[near] * model.labels[near]).sum() / (cos[near] * weight[near]).sum()
        tied = (cos == cos[near[-1]]).sum() > 1 and len(near) == toxicity.NEIGHBOURS
        if not tied:
            assert r["_toxicity"]["score"] == pytest.approx(float(np.interp(raw, *model.curve)), abs=1e-6)


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = np.random.default_rng(3)
    vectors = [{int(t): float(rng.integers(1, 4)) for t in rng.integers(0, 12, int(rng.integers(0, 5)))} for _ in range(90)]
    index = toxicity.BlockMaxIndex.build(vectors)
    for _ in range(60):
        q = {int(t): float(rng.integers(1, 4)) for t in rng.integers(0, 14, 4)}
        want = sorted((-sum(w * v.get(t, 0) for t, w in q.items()), i) for i, v in enumerate(vectors))
        want = [(i, -s) for s, i in want if s < 0][:5]
        assert index.nearest(q, 5) == want


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert list(y) == sorted(y) and y[-1] == 1.0 and len(x) == 3
