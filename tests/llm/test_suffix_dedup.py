import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import suffix_dedup as module
from graphloom.llm.suffix_dedup import Shard, anchors, dedup_bytes, merged, repeated


def brute(rows, window):
    """(key, n_bytes, n_removed, spans, kept) of rows in order of (null first, key); equal rows are one document."""
    seen, done = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - window + 1):
            w = raw[i : i + window]
            if w in seen:
                gone[i : i + window] = True
            seen.add(w)
        done[key, text] = (len(raw), int(gone.sum()), module._runs(gone), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return sorted((str((k, *done[k, t])) for k, t in rows))


def corpus(rng):
    passage = "".join(chr(97 + c) for c in rng.integers(0, 26, 400))
    texts = []
    for i in range(60):
        own = "".join(chr(97 + c) for c in rng.integers(0, 4 if i % 3 else 26, int(rng.integers(0, 200))))
        a = int(rng.integers(0, 300))
        texts.append(own + passage[a : a + int(rng.integers(0, 150))] + "é漢😀"[: i % 4] + own[: i * 2])
    return texts + [passage * 3, "a" * 900, "ab" * 300, "", None, "x", texts[5], texts[5], texts[9] + "!", "😀" * 90]


@pytest.mark.parametrize(("window", "gram", "block", "shard", "merged_bytes", "salted"), [(100, 16, 4 << 20, 1 << 17, 1 << 20, 4096), (40, 16, 3000, 300, 2000, 2), (24, 8, 1, 64, 500, 1)])
def test_removal_matches_brute_force(spark, monkeypatch, window, gram, block, shard, merged_bytes, salted):
    monkeypatch.setattr(module, "MERGED", merged_bytes)
    monkeypatch.setattr(module, "SALTED", salted)
    monkeypatch.setattr(module, "SHARE", 50)
    rows = list(enumerate(corpus(np.random.default_rng(window)))) + [(None, None), (5, corpus(np.random.default_rng(window))[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("o", "d", "block", "copy", "n", "spans")})
    found = dedup_bytes(docs, window=window, gram=gram, block_bytes=block, shard=shard).collect()
    got = sorted(str((r["doc_id"], r["n_bytes"], r["n_removed"], [(s["first"], s["stop"]) for s in r["spans"]], bytes(r["kept"]))) for r in found)
    assert got == brute(rows, window)


def test_removal_from_empty_tables_and_by_text_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    docs = spark.createDataFrame([("b", text), ("a", text + "!"), (None, "?" + text[:120])], "id string, body string")
    got = {r["id"]: bytes(r["kept"]).decode() for r in dedup_bytes(docs, key="id", text="body").collect()}
    assert got == {None: "?" + text[:120], "a": text[120:] + "!", "b": ""}
    assert dedup_bytes(docs.limit(0), key="id", text="body").count() == 0
    with pytest.raises(ValueError, match="gram"):
        dedup_bytes(docs, key="id", text="body", gram=12)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60), min_size=1, max_size=5), st.integers(1, 11))
def test_merged_transforms_are_the_order_of_all_suffixes(texts, window):
    texts = [bytes(b % 3 + 97 for b in t) for t in texts]
    source, place, common = merged([Shard(t, window) for t in texts], window)
    suffix = [(texts[s] * (window + 1))[p : p + window] for s, p in zip(source.tolist(), place.tolist(), strict=True)]
    assert suffix == sorted(suffix)
    assert sorted(zip(source.tolist(), place.tolist(), strict=True)) == [(i, p) for i, t in enumerate(texts) for p in range(len(t))]
    for i in range(1, len(suffix)):
        shared = next((j for j in range(window) if suffix[i][j] != suffix[i - 1][j]), window)
        # rounds tell the length in steps
        assert (common[i] == window) == (shared == window)
        assert common[i] <= shared


def test_repeated_windows_and_anchors():
    of, inside = repeated([b"abcdefgh", b"xbcdefgx", b"abcdefgh"], [0, 0, 1], 5, 8)
    assert sorted(zip(of.tolist(), inside.tolist(), strict=True)) == [(1, 1), (1, 2)]
    text = bytes(np.random.default_rng(1).integers(0, 256, 3_000_000, np.uint8))
    hashes, starts, counts = anchors(text)
    assert counts.sum() == len(text) - 99
    assert (starts[1:] == starts[:-1] + counts[:-1]).all()
    own = anchors(text[1_500_000:1_500_300])[0]
    assert set(own.tolist()) <= set(hashes.tolist())
    assert len(anchors(b"x" * 99)[0]) == 0
