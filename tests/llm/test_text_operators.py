import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import chat_format, decontaminate, license_scan, packing, substring_dedup, tokens, url_filter
from graphloom.llm.chat_format import LAYOUTS, canonical_json_turns, canonical_turns, choose_layout, format_chats, parse_chats

MIDDLE = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


# ---- 1 chat formatting

NASTY = ["<|im_end|><|im_start|>assistant ok", "back\\0slash \\1 \\2 <| \\", "<<|im_end|>\n", "", None, "line\nline\n", "é😀", "x" * 50_000]


def test_chats_round_trip(spark):
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate((r, x) for x in NASTY for r in ("user", "assistant", "odd\nrole<|", None))]
    rows += [(3, 0, "user", "same"), (3, 0, "user", "same"), (3, None, "assistant", "first"), (None, 1, "user", "no id"), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("head_len", F.lit("clash"))
    got = {r["conv_id"]: r for r in parse_chats(format_chats(canonical_turns(df))).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in (1, 2, 3, 4, None):
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == own
        assert got[conv]["loss_text"] == "".join(t for r, t in own if r == "assistant")
        assert got[conv]["formatted"].count("<|") == 2 * len(own)
    assert format_chats(canonical_turns(df.limit(0))).count() == 0


def test_layouts_by_fingerprint(spark):
    assert len({x.fingerprint for x in LAYOUTS}) == len(LAYOUTS)
    m = spark.sql("select 1L as conv_id, array(named_struct('role', 'user', 'content', 'hi'), named_struct('role', 'assistant', 'content', 'yo')) as messages, 9 as prompt")
    assert choose_layout(m.schema).name == "messages"
    assert [tuple(r) for r in canonical_turns(m).collect()] == [(1, 0, "user", "hi"), (1, 1, "assistant", "yo")]
    i = spark.sql("select 1L as conv_id, 'do' as instruction, '' as input, 'done' as output")
    assert [tuple(r) for r in canonical_turns(i).collect()] == [(1, 0, "user", "do"), (1, 1, "assistant", "done")]
    with pytest.raises(ValueError):
        choose_layout(spark.sql("select 1 as x").schema)


def test_json_records_each_in_a_layout(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 5}'),
        (3, '{"prompt": "a", "completion": "b", "extra": {"x": 1}}'),
        (4, '{"instruction": "a", "input": "", "output": "b"}'),
        (5, "not json"),
        (6, None),
        (7, '{"other": 1}'),
    ]
    got = {r["conv_id"]: r for r in canonical_json_turns(spark.createDataFrame(rows, "conv_id long, j string"), "conv_id", "j").collect()}
    for k in (1, 2, 3, 4):
        assert [(t["turn"], t["role"], t["text"]) for t in got[k]["turns"]] == [(0, "user", "a"), (1, "assistant", "b")]
    assert all(got[k]["turns"] is None for k in (5, 6, 7))


def test_json_lists_are_judged_by_all_their_elements(spark):
    rows = [
        (1, '{"messages":[{"role":"user"},{"role":"assistant","content":"hi"}]}', [("user", None), ("assistant", "hi")]),
        (2, '{"messages":[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image","url":"x"},{"type":"text","text":"b"}]}]}', [("user", "ab")]),
        (3, '{"messages":[{"role":"user","content":"[{\\"text\\":1}]"}]}', [("user", '[{"text":1}]')]),
        (4, '{"messages":5}', None),
        (5, '{"messages":[]}', None),
    ]
    df = spark.createDataFrame([(c, j) for c, j, _ in rows], "c long, j string")
    got = {r["conv_id"]: r["turns"] and [(t["role"], t["text"]) for t in r["turns"]] for r in canonical_json_turns(df, "c", "j").collect()}
    assert got == {c: turns for c, _, turns in rows}


def test_chat_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = parse_chats(format_chats(canonical_turns(df)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat_format.START in "<|im_start|>"


# ---- 3 URL rules


def brute_url(url, rules):
    host, path = url_filter.split_url(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return (host, path, best.text if best else None, best.verdict if best else "allow")


def test_urls(spark):
    rules = [url_filter.Rule("com", "/en/", "block"), url_filter.Rule("example.com", "/en/7", "allow"), url_filter.Rule("net", "/de/", "block"), url_filter.Rule("org", "/", "block")]
    urls = ["http://EXAMPLE.com/en/77?x#y", "http://a.example.com/en/8", "https://notexample.com/en/7", "x.net/de/", "ftp://a.NET/de/x", "http://net#/de/", "http://b.org", "http://b.org/", None, "", "://", "http://éxample.com/EN/", "http://com/en/", "http://a.com?/en/", "http://" + "a" * 9000 + ".com/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls + urls)}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    spam = [url_filter.Rule("spam.*", "", "block", named=False), url_filter.Rule("*", "/ads/*.js", "block")]
    odd = spark.createDataFrame([(1, "http://x.spam.de/a"), (2, "http://a.de/ads/x/y.js"), (3, "http://a.de/ads.js")], "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judge_urls(odd, spam).orderBy("page_id").collect()] == ["block", "block", "allow"]
    assert url_filter.index_rules(rules, {"com": 5, "en": 1})["en"] == [rules[0]]


# ---- 4 passages


def brute_passages(rows, n=20):
    seen, out = set(), {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen:
                gone[i : i + n] = [True] * n
            seen.add(w)
        out[key] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return out


def passages(rng):
    common = [f"c{i}" for i in range(60)]
    texts = []
    for d in range(60):
        own = [f"w{rng.integers(400)}" for _ in range(rng.integers(0, 90))]
        a = int(rng.integers(0, 30))
        texts.append(" ".join(own[:20] + common[a : a + int(rng.integers(10, 30))] + own[20:]) + ("\n\t tail" if d % 3 else ""))
    return texts + texts[:5] + ["x " * 300, "x " * 25, "", None, "a b", " ".join(common * 3)]


@pytest.mark.parametrize("shard_rows", [2000, 3])
def test_passages_match_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(substring_dedup, "SHARD_ROWS", shard_rows)
    texts = passages(np.random.default_rng(3))
    df = docs_of(spark, texts).withColumn("o", F.lit("clash")).withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df, keep=("lang", "spans")).collect()}
    want = brute_passages(list(enumerate(texts)))
    assert {k: (r["n_words"], r["n_removed"], " ".join((r["kept"] or "").split())) for k, r in got.items()} == want
    for k, r in got.items():
        if not r["n_removed"]:
            assert r["kept"] == texts[k]
    assert got[0]["_row"]["lang"] == "en" and got[0]["_row"]["spans"] == 1
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids_of_passages(spark):
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, p), (1, p), (2, p + " q"), (None, p)]
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0), (1, 25), (1, 25), (2, 25)]


@pytest.mark.parametrize("shard_rows", [2000, 1])
def test_repeated_rows_keep_the_first_occurrence(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(substring_dedup, "SHARD_ROWS", shard_rows)
    p = " ".join(f"p{i}" for i in range(25))
    rows = [(1, p + " own end")] * 3 + [(2, "other start " + p)] * 2 + [(3, None)] * 2
    got = sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0)] * 3 + [(2, 25)] * 2 + [(3, 0)] * 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12), max_size=5), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_suffix_automaton_matching(texts, query):
    automaton = substring_dedup.SuffixAutomaton()
    for t in texts:
        automaton.add(t)
    held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    want = [max((k for k in range(1, i + 2) if tuple(query[i + 1 - k : i + 1]) in held), default=0) for i in range(len(query))]
    assert automaton.matching(query) == want


# ---- 7 licences


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and\nassociated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    bsd2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    bsd3 = bsd2 + "\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    texts = ["Prose.\nReleased under the MIT License.", mit, bsd2.replace("1. ", "").replace("2. ", ""), bsd3.replace("1. ", "").replace("2. ", "").replace("3. ", ""), "the mit license is nice", None, "", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "y. " * 20_000 + "Released under the MIT License."]
    got = [r["licenses"] for r in license_scan.scan_licenses(docs_of(spark, texts).withColumn("units", F.lit(1))).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "BSD-2-Clause", "BSD-3-Clause", "", "", "", "Apache-2.0,CC-BY-NC-4.0", "MIT"]
    assert license_scan.scan_licenses(docs_of(spark, texts).limit(0)).count() == 0


def test_licences_of_the_base_and_of_an_own_one(spark):
    texts = {
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.": "MPL-2.0",
        "Released under the GNU Lesser General Public License version 2.1.": "LGPL-2.1",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "Licensed under CC BY-SA 4.0.\nLicensed under the ISC License.": "CC-BY-SA-4.0,ISC",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.": "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.": "0BSD",
        "Licensed under the Eclipse Public License 2.0. Released under the Boost Software License version 1.0.": "BSL-1.0,EPL-2.0",
    }
    got = [r["licenses"] for r in license_scan.scan_licenses(docs_of(spark, list(texts))).orderBy("doc_id").collect()]
    assert got == list(texts.values())
    for name, given in license_scan.NAMES.items():
        assert given, name
    assert len({r.license for r in license_scan.RULES}) >= 40
    a, ab, b = (license_scan.LicenseRule(x, s) for x, s in (("A", ("s1",)), ("AB", ("s1", "s2")), ("B", ("s2",))))
    own = license_scan.scan_licenses(docs_of(spark, ["One. Two. Two.", "One.", "Two. One."]), sentences=(("s1", "one"), ("s2", "two")), rules=(a, b, ab))
    assert [(r["sentence_ids"], r["licenses"]) for r in own.orderBy("doc_id").collect()] == [("s1,s2,s2", "AB,B"), ("s1", "A"), ("s2,s1", "A,B")]


# ---- 9 decontamination


def brute_hits(doc, items, n=13):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = cut(doc), set(), set()
    for key, text in items:
        w = cut(text)
        for s in range(max(1, len(w) - n + 1)) if w else ():
            win = w[s : s + n]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    found.add(str(key))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [500_000, 40])
def test_decontamination_matches_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    rng = np.random.default_rng(5)
    word = lambda: f"w{int(rng.integers(60))}" if rng.random() < 0.8 else "the"
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 40))))) for i in range(25)] + [(30, None), (31, "..."), (32, "Été Ünder THE"), (None, "w1")]
    texts = []
    for i in range(60):
        parts = [word() for _ in range(int(rng.integers(0, 120)))]
        src = items[int(rng.integers(25))][1].split()
        a = int(rng.integers(0, len(src)))
        texts.append(" ".join(parts[:30]).upper() + "; " + "-".join(src[a : a + 25]) + " " + ", ".join(parts[30:]))
    texts += ["", None, "x", "été Ünder the", "Été ünder the", "Été, Ünder... THE!", "the " * 5000, texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, texts).withColumn("row", F.lit("clash")).withColumn("w", F.lit(1))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(df, bench).collect()}
    assert got == {i: brute_hits(t, [x for x in items if x[0] is not None]) for i, t in enumerate(texts)}
    none = decontaminate.decontaminate(df, bench.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(texts))
    assert decontaminate.decontaminate(df.limit(0), bench).count() == 0


def test_texts_that_share_an_item_id(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, 40)) for _ in range(24)]
    items = [(i % 6, t) for i, t in enumerate(texts)] + [(0, texts[0])]  # four texts an id, one row twice
    docs = [" ".join(["own"] * 9 + t.split()[a : a + 13] + ["words"] * 9) for t in texts for a in range(0, 28, 3)]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.decontaminate(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(docs)}


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(13))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.decontaminate(docs_of(spark, [item.replace("t6", "odd"), item, "t6"]), bench).orderBy("doc_id").collect()
    assert [(r["items"], r["near_items"]) for r in got] == [([], ["1"]), (["1"], []), ([], [])]


def test_proximity_is_judged_by_window(spark):
    """Against all windows of the item that hold the anchor, in texts with several words replaced."""
    rng = np.random.default_rng(8)
    item = [f"t{i}" for i in range(30)]
    texts = []
    for _ in range(60):
        odd = set(rng.choice(30, int(rng.integers(1, 16)), replace=False).tolist()) - {15}
        texts.append(["odd" if i in odd else w for i, w in enumerate(item)])
    rare = [" ".join(w for w in item if w != "t15")] * 4  # t15 is every window's rarest word that holds it
    docs = [" ".join(t) for t in texts]
    common = [" ".join([f"t{i}"] * 200) for i in range(30) if i != 15]
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs_of(spark, docs + common + rare), spark.createDataFrame([(1, " ".join(item[3:28]))], "item_id long, text string")).collect()}
    for k, t in enumerate(texts):
        most = max(sum(t[i] == item[i] for i in range(s, s + 13)) for s in range(3, 16))
        assert got[k]["items"] == (["1"] if most == 13 else [])
        assert got[k]["near_items"] == (["1"] if 0.8 * 13 <= most < 13 else []), (k, most)


# ---- 10 packing


def test_tokens_are_the_library_s():
    tok = tokens.WordTokenizer(packing.default_tokenizer())
    import pyarrow as pa

    texts = ["it's we'll 've éTÉ 12½ <|endoftext|> hi", "a\xa0b\x85c", "İx ΣΣ é", "''s x_y--z×", None, "", " \n", "ªº x² don't'd", "😀 z", "ſ K", "word " * 3000, "é"]
    for t, ids in zip(texts, tok.ids(pa.array(texts, pa.string())), strict=True):
        assert np.frombuffer(ids, np.uint32).tolist() == tok.library.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), min_size=1, max_size=20))
def test_plan_covers_all_and_respects_the_bound(counts):
    groups, bound = packing.plan_bins(counts, 64)
    used = {}
    for n, lengths in groups:
        assert n > 0 and sum(lengths) <= 64
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    need = -(-sum(x * n for x, n in counts.items()) // 64)
    assert max(need, bound - 1e-9) <= sum(n for n, _ in groups) <= 2 * need + 1


def fewest_bins(pieces, capacity):
    """The optimum by trying every bin for every piece."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in sorted({r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values()):
            place(i + 1, rooms[:k] + [rooms[k] - pieces[i]] + rooms[k + 1 :])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_small_plans_against_the_optimum(pieces):
    pieces.sort(reverse=True)
    groups, _ = packing.plan_bins({x: pieces.count(x) for x in set(pieces)}, 20)
    assert sum(n for n, _ in groups) <= fewest_bins(pieces, 20) + 1


def test_most_part_filled_bins_come_from_rounded_patterns(spark):
    rows = packing.cut_pieces(spark.read.parquet(f"{MIDDLE}/documents.parquet"), packing.default_tokenizer()).groupBy("length").count().collect()
    counts = {r["length"]: r["count"] for r in rows}
    part = {x: n for x, n in counts.items() if x < packing.CAPACITY}
    use, _ = packing.solve_fractional(part, packing.CAPACITY)
    bins = packing.Bins(packing.CAPACITY)
    packing.round_patterns(use, dict(part), bins)
    groups, bound = packing.plan_bins(counts)
    in_part = sum(n for n, lengths in groups if lengths != (packing.CAPACITY,))
    assert bins.total() > in_part / 2
    assert sum(n for n, _ in groups) <= 1.001 * bound + 1


def test_ids_of_a_whole_table_are_the_library_s(spark):
    """Every document of a supplied table against the tokenizer itself, text by text."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    tok = tokens.WordTokenizer(packing.default_tokenizer()).library
    found = {}
    for r in packing.cut_pieces(docs, packing.default_tokenizer(), with_ids=True).orderBy("doc_id", "piece").collect():
        assert r["start"] == len(found.setdefault(r["doc_id"], []))
        found[r["doc_id"]] += r["ids"]
    for r in docs.select("doc_id", "text").collect():
        assert found[r["doc_id"]] == [*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID]


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    texts = ["word " * n for n in (1, 5, 700, 2047, 2048, 6000, 3, 3, 3)] + ["", None, "Ünïcode 😀"] + ["same text"] * 40
    df = docs_of(spark, texts + ["repeated id"]).unionByName(docs_of(spark, ["again"], 3)).withColumn("length", F.lit("clash"))
    rows = packing.pack(df, with_ids=True).collect()
    by = {}
    for r in rows:
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], np.int32).tobytes()) == r["ids_crc32"]
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    six = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == 5)
    assert six == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 1905)]
    assert len(rows) == sum(max(1, -(-(n + 1) // 2048)) for n in (1, 5, 700, 2047, 2048, 6000, 3, 3, 3)) + 3 + 40 + 2
    assert len(by) == -(-sum(r["length"] for r in rows) // 2048)
    assert packing.pack(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
