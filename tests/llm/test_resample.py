import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import resample as module
from graphloom.llm.resample import resample, split_words


def brute(rows, target, buckets=10_000, grams=1, percent=10, min_words=20, seed="2024"):
    def words(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    def counts(text):
        w = words(text)
        runs = [" ".join(w[i : i + n]) for n in range(1, grams + 1) for i in range(len(w) - n + 1)]
        return Counter(zlib.crc32(x.encode()) % buckets for x in runs)

    s, t = sum((counts(x) for _, x in rows), Counter()), sum((counts(x) for x in target), Counter())
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (s_all + buckets)) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for key, text in rows:
        c = counts(text)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(n * gain(b) for b, n in c.items())
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, sum(c.values()), weight, score, None, len(words(text)) >= min_words])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def corpus(rng, n=300):
    words = [f"w{i}" for i in range(200)] + ["Éa", "x-y", "the", "THE", "a1"]
    p = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, int(rng.integers(0, 90)), p=p / p.sum())) for _ in range(n)]


@pytest.mark.parametrize(("grams", "percent", "lists"), [(1, 10, 16_384), (2, 35, 16), (1, 100, 1)])
def test_resampling_matches_brute_force(spark, monkeypatch, grams, percent, lists):
    monkeypatch.setattr(module, "RUN_DOCS", lists)
    texts = corpus(np.random.default_rng(5))
    texts += [None, "", "\t.,;", "the " * 30_000, texts[3], texts[3]]
    rows = list(enumerate(texts)) + [(None, texts[4]), (None, None), (7, texts[7]), (7, texts[7])]
    target = ["the w1 w2 w3", "w150 w151 Éa", None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "k", "score", "part", "bucket", "w")})
    aim = spark.createDataFrame([(t,) for t in target], "text string").withColumn("bucket", F.lit(1))
    got = sorted((tuple(r) for r in resample(docs, aim, grams=grams, percent=percent).collect()), key=str)
    assert got == brute(rows, target, grams=grams, percent=percent)


def test_resampling_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two " * 20), ("b", "three " * 30)], "id string, body string")
    none = spark.createDataFrame([], "text string")
    got = {r["id"]: r["rank"] for r in resample(docs, none, key="id", text="body", percent=50).collect()}
    assert sorted(got) == ["a", "b"]
    assert [r for r in got.values() if r] == [1]
    assert resample(docs.limit(0), none, key="id", text="body").count() == 0
    with pytest.raises(ValueError, match="percent"):
        resample(docs, none, key="id", text="body", percent=101)


def test_words():
    text = "A-b C_d É1\x00z\u3000q"
    assert [w.decode() for w in split_words(text.encode())] == ["a", "b", "c", "d", "É1", "z\u3000q"]
    assert split_words(None) == []
