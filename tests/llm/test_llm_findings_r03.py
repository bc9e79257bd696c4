from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import corpus_pipeline
from graphloom.llm import queries, simhash, suffix_dedup, url_filter

#: The rules as the contract of op3 words them.
CONTRACT = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}


def by_contract(url):
    host, path = url_filter.split_url(url)
    fits = [h + p for h, p in CONTRACT if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=len, default=None)
    verdict = {h + p: v for (h, p), v in CONTRACT.items()}.get(best)
    return host, path, best, verdict or ("block" if any(f".{s}." in f".{host}" for s in ("spam-farm", "cheap-pills")) else "allow")


def test_op3_verdicts_are_those_of_the_contract(spark, tmp_path):
    rng = np.random.default_rng(3)
    hosts = ["net", "a.net", "EXAMPLE.net", "x.example.net", "com", "example.com", "b.example.com", "org", "q.org", "notnet", "spam-farm.net", "spam-farm.org", "cheap-pills.com", "net:80", "é.net", ""]
    paths = ["", "/", "/de/", "/de/8", "/de/81/x", "/DE/8", "/en/", "/en/7", "/en/8", "/es/", "/es", "?/de/", "#/de/", "//de/", "/de/" + quote("ü")]
    urls = [f"{rng.choice(['http://', 'x://', ''])}{h}{p}" for h in hosts for p in paths] + [None, ""]
    rows = [(i, u) for i, u in enumerate(urls)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in queries.op3_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: by_contract(u) for i, u in rows}


def test_near_dedup_stage_keeps_what_simhash_links(spark):
    """On the supplied texts the fingerprints of operator 6 and the bands of least hashes differ."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    fps = np.array([simhash.fingerprint(t) for _, t in rows], np.uint64)
    label = np.arange(len(rows))
    links = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    while (low := np.where(links, label[None, :], len(rows)).min(axis=1)).tolist() != label.tolist():
        label = low
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == [k for (k, _), own, first in zip(rows, range(len(rows)), label, strict=True) if own == first]


def in_one_process(rows, blocks):
    """Spans (document, first, stop) that go, windows of salts and bytes of stretches, by the functions of dedup_bytes' tasks."""
    tables = []
    for b in range(blocks):
        mine = [(b, o, o % 3, t) for o, t in rows if o % blocks == b]
        tables.append(pa.table(list(zip(*mine, strict=True)), schema=pa.schema([("block", pa.int64()), ("o", pa.int64()), ("d", pa.int64()), ("text", pa.binary())])))
    none = pa.table({"o": pa.array([], pa.int64()), "d": pa.array([], pa.int64())})
    asked = pa.concat_tables([suffix_dedup._asked(1, 100, 16)(t, none) for t in tables])
    answers = suffix_dedup._answered(asked)
    stretches = []
    for b, t in enumerate(tables):
        told = answers.filter(pc.equal(answers["block"], b))
        told = told.append_column("o", pa.nulls(len(told), pa.int64())).append_column("d", pa.nulls(len(told), pa.int64()))
        stretches.append(suffix_dedup._stretched(100, 16)(t, told))
    ordered = pa.concat_tables(stretches).sort_by([(c, "ascending") for c in ("anchor", "salt", "o", "d", "start")])
    found = [r for batch in suffix_dedup._resolved(100, 16, 1 << 12)(iter(ordered.to_batches(max_chunksize=7))) for r in batch.to_pylist()]
    salted = sorted((r for r in found if r["digest"]), key=lambda r: (r["digest"], r["o"], r["first"]))
    later = [(r["block"], r["i"], r["first"], r["first"] + 100) for x, r in zip([None, *salted], salted, strict=False) if x and x["digest"] == r["digest"]]
    gone = set()
    for b in range(blocks):
        packed = [r["spans"] for r in found if r["spans"] and r["block"] == b]
        packed.append(suffix_dedup._packed(*np.array([x[1:] for x in later if x[0] == b], np.int64).reshape(-1, 3).T))
        number = sorted(o for o, _ in rows if o % blocks == b)
        gone |= {(number[i], x, y) for i, x, y in zip(*(v.tolist() for v in suffix_dedup._united(packed)), strict=True)}
    return gone, len(salted), sum(len(x) for x in ordered.filter(pc.is_valid(ordered["anchor"]))["bytes"].to_pylist())


@pytest.mark.parametrize(("salted", "merged"), [(4096, 1 << 20), (3, 3000)])
def test_op13_few_stretches_enter_shards_and_none_is_lost(monkeypatch, salted, merged):
    rng = np.random.default_rng(5)
    letters = lambda n: bytes(rng.integers(97, 101 + n % 20, n, np.uint8))
    phrase, passage = letters(60), letters(160)
    # a phrase among other words is no repeat; a passage is, whole or in part
    rows = [(o, letters(150) + phrase[: 20 + o % 41] + letters(150) + (passage[o % 50 : 110 + o % 50] if o % 4 == 0 else b"") + letters(o % 7)) for o in range(120)]
    rows += [(200, passage * 2), (201, b"ab" * 200), (202, b"x" + b"ab" * 150), (203, b"")]
    monkeypatch.setattr(suffix_dedup, "SALTED", salted)
    monkeypatch.setattr(suffix_dedup, "MERGED", merged)
    entered, own = [], suffix_dedup.repeated
    monkeypatch.setattr(suffix_dedup, "repeated", lambda s, *a: (entered.extend(s), own(s, *a))[1])
    seen, want = set(), set()
    for o, text in rows:
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(text[i : i + 100])
        want |= {(o, a, b) for a, b in suffix_dedup._runs(gone)}
    got, n, dealt = in_one_process(rows, 4)
    assert got == want
    assert (n > 0) == (salted == 3)
    if salted == 4096:
        assert sum(map(len, entered)) < dealt / 2


def test_op13_windows_of_salts_meet_only_where_what_surrounds_the_anchor_is_shared(spark, monkeypatch):
    """More stretches of one anchor than a salt has: a phrase in other words each time, and 40 that go on alike."""
    rng = np.random.default_rng(11)
    letters = lambda n: bytes(rng.integers(97, 123, n, np.uint8)).decode()
    # the smallest hash of many stands within the phrase, so that all windows over it have this anchor
    gram = min((letters(16) for _ in range(20_000)), key=lambda g: suffix_dedup._hashed(g.encode(), 16)[0])
    phrase, ends = letters(10) + gram + letters(10), [letters(90) for _ in range(40)]
    rows = [(o, letters(40 + o % 30) + letters(25) + phrase + (ends[o % 40][: 30 + o % 60] if o % 9 == 0 else "") + letters(60)) for o in range(6000)]
    own, tables = suffix_dedup.cut, {}
    monkeypatch.setattr(suffix_dedup, "cut", lambda df, name: tables.setdefault(name, own(df, name)))
    seen, want = set(), {}
    for o, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(raw[i : i + 100])
        want[o] = suffix_dedup._runs(gone)
    found = suffix_dedup.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=1 << 18).collect()
    assert {r["doc_id"]: [(s["first"], s["stop"]) for s in r["spans"]] for r in found} == want
    pieces = [r for r in tables["pieces"].collect() if r["part"] is not None]
    assert len({r["salt"] for r in pieces}) > 1
    shared = {r["part"] for r in tables["several"].collect()}
    windows = lambda rows: sum(len(r["bytes"]) - 99 for r in rows)
    # repeats across salts are there, and few of the windows that were rows of their own still are
    assert shared and any(want.values())
    assert 4 * (len(pieces) + windows(r for r in pieces if r["part"] in shared)) < windows(pieces)
