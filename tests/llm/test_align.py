import hashlib
import os
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm.align import align, aligned_tables, cut_characters, default_tokenizers, pair


def brute(rows):
    """Whole texts through both libraries, links by comparing byte ranges."""
    both = pair(*default_tokenizers())
    made, held, corpus = [], [], Counter()
    for _, text in rows:
        a = both.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        whole = f" {text}".encode()
        if not text or b"".join(both.bytes_a[i] for i in a) != whole or b"".join(both.bytes_b[i] for i in b) != whole:
            made.append(None)
            held.append(Counter())
            continue

        def ranges(ids, of):
            at, out = 0, []
            for i in ids:
                out.append((at, at := at + len(of[i]), i))
            return out

        ra, rb = ranges(a, both.bytes_a), ranges(b, both.bytes_b)
        links, j = Counter(), 0
        for x, y, i in ra:
            while rb[j][1] <= x:
                j += 1
            m = j
            while m < len(rb) and rb[m][0] < y:
                links[i, rb[m][2]] += 1
                m += 1
        common = {y for _, y, _ in ra} & {y for _, y, _ in rb}
        groups, of = [], lambda rs: [(y, str(i)) for _, y, i in rs]
        la, lb = of(ra), of(rb)
        low = 0
        for end in sorted(common):
            groups.append(",".join(i for y, i in la if low < y <= end) + "|" + ",".join(i for y, i in lb if low < y <= end))
            low = end
        made.append((len(a), len(b), groups))
        held.append(links)
        corpus.update(links.keys())
    best = defaultdict(int)
    for (a, _), n in corpus.items():
        best[a] = max(best[a], n)
    out = []
    for (key, _), m, links in zip(rows, made, held, strict=True):
        if m is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_best = sum(n for (a, b), n in links.items() if corpus[a, b] == best[a])
            digest = hashlib.sha256(";".join(m[2]).encode()).hexdigest()
            out.append((key, m[0], m[1], len(m[2]), sum(links.values()), n_best, sum(n * corpus[p] for p, n in links.items()), digest))
    return sorted(out, key=str), corpus


NASTY = [
    "Hello world, don't stop 123 4567\n\n\tindented  code();\r\n  x = 'a'\r\nif  (a) { }\r ", "<|endoftext|> </s><s> <0x41> [UNK]", "a▁b ▁ x", " x　y  z\u0085w\x1cv", " lead", "  two", "trail  ", "\n", " ", "   ",
    "\t\ta\tb", "naïve Ünïcode 漢字かな交じり文 한국어 😀👩‍👩‍👧 é", "a" * 5000, "x " * 3000, "\x00\x01 \x7f", "don't we'll I'VE it's''s", "“quotes” — dash…", "é ﬁ ＡΩ ​﻿ q", None, "", "tail ", "1,234.56 $%^ &*( ))) ;\r ;\r\n",
]


@pytest.mark.parametrize(("block", "share", "held"), [(4 << 20, 400_000, 10**6), (200, 7, 0), (3000, 50, 10**6)])
def test_alignment_matches_brute_force(spark, block, share, held):
    rows = list(enumerate(NASTY)) + [(None, "null id here"), (None, None), (3, NASTY[0]), (3, NASTY[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("k", "block", "n_a", "codes", "pair", "share")})
    found, ids = aligned_tables(docs, block_bytes=block, share=share, pairs_held=held)
    want, corpus = brute(rows)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    pairs = {(r["a"], r["b"]): r["docs"] for r in ids.collect()}
    assert pairs == dict(corpus)
    assert align(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no supplied tables")
def test_alignment_of_a_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in align(docs).collect()), key=str) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r  '.,;(){}ab1Ä漢s▁"), st.characters(exclude_categories=["Cs"])), min_size=1, max_size=60))
def test_segments_give_the_whole_text_s_tokens(text):
    both = pair(*default_tokenizers())
    segments = both.segments.findall(f" {text}")
    assert "".join(segments) == f" {text}"
    a, b = both.a.encode(f" {text}", add_special_tokens=False).ids, both.b.encode(text)
    found = both.encode(segments)
    if b"".join(both.bytes_b[i] for i in b) == f" {text}".encode():
        ids = [(n_a, np.frombuffer(x, "<i4").tolist()) for n_a, _, x, _ in found]
        assert [i for n, x in ids for i in x[:n]] == a
        assert [i for n, x in ids for i in x[n:]] == b
    else:
        assert (0, 0, b"", b"") in found


def test_characters_that_pieces_reach_across_are_not_cut_at():
    assert cut_characters(["a", "▁a", "b\tc"]) == " \n"
    assert cut_characters(["a▁b", "▁▁"]) == "\t\n"
