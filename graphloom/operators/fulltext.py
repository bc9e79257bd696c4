"""BM25 full-text search; the tokenizer lower-cases and cuts Han, Kana and Hangul runs to bigrams.

Queries are words, ``"phrases"``, wildcards (``lic*``, ``te?t``), fuzzy words (``idoit~``, ``idoit~1``), each with
``field:`` before and ``^boost`` after it, ``+required``, ``-excluded``, AND, OR, NOT and brackets. Words side by side
are alternatives; a NOT among them excludes. Scores add up the weights of all words that are not excluded, a word
that stands twice once. A wildcard adds its boost to each document with any of its words; a fuzzy one adds the
weights of all words within the edits, each less by the share of edits.

``FullTextIndex`` is the written index. A run of documents makes its own postings, in blocks of ``BLOCK``
by falling weight, with the highest count and the least length of a block beside it; blocks, not tokens, are
then sorted by term over parts, so that a word of all documents is many blocks in many parts. A sorted dictionary
holds the words, a small table the range of each part: a search opens the parts of its words only, and a
top-k reads only blocks that can reach it. ``bm25`` searches a table without an index.

Rows are documents; the score of a key that stands in several rows is the sum of theirs. Null texts have no words.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import QueryParseError
from graphloom.session import ship
from graphloom.sources.scratch import cut

K1, B = 1.2, 0.75
CJK = r"ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯"


def tokens(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    plain = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    runs = F.regexp_extract_all(F.lower(text), F.lit(rf"([{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+)"), F.lit(1))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^[{CJK}]") & (F.char_length(t) > 1), pairs(t)).otherwise(F.array(t))))
    return F.when(text.rlike(f"[{CJK}]"), cut).otherwise(plain)


def _ordered_tokens(text: str) -> list[str]:
    found: list[str] = []
    for run in re.findall(rf"[{CJK}]+|(?:(?![{CJK}_])\w)+", text.lower()):
        found += [run[i : i + 2] for i in range(len(run) - 1)] if len(run) > 1 and re.match(f"[{CJK}]", run) else [run]
    return found


def query_tokens(text: str) -> list[str]:
    """The same tokens of a query string, sorted and once each."""
    return sorted(set(_ordered_tokens(text)))


@dataclass(frozen=True)
class Leaf:
    """What a query asks of one field: a word, a phrase, a wildcard or a fuzzy word."""

    kind: str
    words: tuple[str, ...]
    field: str | None = None
    boost: float = 1.0
    edits: int = 0


#: A parsed query: ("leaf", Leaf), ("and" | "or", parts), ("not", part), ("may", part).
Node = tuple
_PART = re.compile(r'[+-]?(?:\w+:)?"[^"]*"(?:\^[\d.]+)?|[+-]?\(|\)|[^\s()"]+')
_LEAF = re.compile(r'(?P<sign>[+-]?)(?:(?P<field>\w+):)?(?P<body>.*?)(?P<fuzzy>~\d?)?(?:\^(?P<boost>\d+(?:\.\d+)?))?$', re.DOTALL)


def parse(text: str, fields: tuple[str, ...] = ()) -> Node:
    """Unbalanced quotes or brackets and lone operators raise ``QueryParseError``; a prefix that is no field is a word."""
    if text.count('"') % 2 or text.count("[") != text.count("]"):
        raise QueryParseError(f"unbalanced query: {text!r}")
    parts = _PART.findall(text)
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def clause() -> Node:
        nonlocal at
        found, excluded, required = [], [], []
        while peek() not in (None, ")"):
            if peek() == "OR":
                if not (found or required) or parts[at + 1 : at + 2] in ([], [")"], ["OR"], ["AND"]):
                    raise QueryParseError(f"OR needs two sides: {text!r}")
                at += 1
                continue
            sign = peek()[0] if peek()[0] in "+-" and len(peek()) > 1 else ""
            node = conjunction()
            if node:
                (excluded if node[0] == "not" else required if sign == "+" else found).append(node)
        if not found and not required:
            raise QueryParseError("the query has no term")
        may = found[0] if len(found) == 1 else ("or", found)
        whole = ("and", [*required, *([("may", may)] if found else [])]) if required else may
        return ("and", [whole, *excluded]) if excluded else whole

    def conjunction() -> Node | None:
        nonlocal at
        sides = [unary()]
        while peek() == "AND":
            at += 1
            sides.append(unary())
        if len(sides) > 1 and (None in sides or all(s[0] == "not" for s in sides)):
            raise QueryParseError(f"AND needs two sides: {text!r}")
        return sides[0] if len(sides) == 1 else ("and", sides)

    def negated(node: Node | None) -> Node:
        if node is None:
            raise QueryParseError(f"a term is missing: {text!r}")
        return ("not", node)

    def unary() -> Node | None:
        nonlocal at
        word = peek()
        if word in (None, ")", "AND", "OR"):
            raise QueryParseError(f"a term is missing: {text!r}")
        at += 1
        if word == "NOT":
            return negated(unary())
        if word.lstrip("+-") == "(":
            node = clause()
            if peek() != ")":
                raise QueryParseError(f"unbalanced query: {text!r}")
            at += 1
            return negated(node) if word[0] == "-" else node
        node = leaf(word)
        return negated(node) if word[0] == "-" and len(word) > 1 else node

    def leaf(word: str) -> Node | None:
        m = _LEAF.match(word)
        of, body, boost = m["field"], m["body"], float(m["boost"] or 1)
        if of and of not in fields:
            of, body = None, f"{of}:{body}"
        make = lambda kind, *words, edits=0: ("leaf", Leaf(kind, words, of, boost, edits))
        if re.search(r"[*?]", body) and re.search(r"\w", body) and not body.startswith('"'):
            return make("wild", body.lower())
        found = _ordered_tokens(body)
        if not found:
            return None
        if m["fuzzy"] and len(found) == 1:
            return make("fuzzy", found[0], edits=min(2, int(m["fuzzy"][1:] or 2)))
        if body.startswith('"') and len(found) > 1:
            return make("phrase", *found)
        nodes = [make("word", t) for t in found]
        return nodes[0] if len(nodes) == 1 else ("or", nodes)

    node = clause()
    if at < len(parts):
        raise QueryParseError(f"unbalanced query: {text!r}")
    return node


def leaves(node: Node, scored: bool = False) -> list[Leaf]:
    """The leaves of a query, each once; with ``scored`` without those that are excluded."""
    if node[0] == "leaf":
        return [node[1]]
    if node[0] in ("not", "may"):
        return [] if scored and node[0] == "not" else leaves(node[1], scored)
    return list(dict.fromkeys(x for part in node[1] for x in leaves(part, scored)))


def parse_query(text: str) -> list[str]:
    """The words that are scored, sorted."""
    return sorted({w for x in leaves(parse(text), True) for w in x.words})


def _any_of(node: Node) -> bool:
    """Whether every document with a leaf fits."""
    return node[0] == "leaf" and node[1].kind != "phrase" or node[0] == "or" and all(map(_any_of, node[1]))


def _matches(node: Node, has: dict[Leaf, Column]) -> Column:
    if node[0] == "leaf":
        return has[node[1]]
    if node[0] == "not":
        return ~_matches(node[1], has)
    if node[0] == "may":
        return F.lit(True)
    return reduce(operator.and_ if node[0] == "and" else operator.or_, (_matches(x, has) for x in node[1]))


def _in_order(words: tuple[str, ...], places: Column) -> Column:
    """Whether the words follow each other (term -> positions)."""
    at = lambda t: F.coalesce(F.try_element_at(places, F.lit(t)), F.array().cast("array<int>"))
    return F.exists(at(words[0]), lambda p: reduce(operator.and_, (F.array_contains(at(t), p + i) for i, t in enumerate(words))))


#: Postings of a block; words that are inverted together, postings of a part, about.
BLOCK, RUN, PART = 128, 2_000_000, 4_000_000


def _inverted(n_fields: int):
    """Blocks of the postings of a run of documents: field by number, term, and the block's bounds and lists."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(len(batch[f"t{i}"].flatten()) for i in range(n_fields))
            if size >= RUN:
                yield from blocks(pa.Table.from_batches(held).combine_chunks())
                held, size = [], 0
        if held:
            yield from blocks(pa.Table.from_batches(held).combine_chunks())

    def blocks(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for number in range(n_fields):
            lists = pa.concat_arrays(table[f"t{number}"].chunks) if table[f"t{number}"].num_chunks != 1 else table[f"t{number}"].chunk(0)
            encoded = lists.flatten().dictionary_encode()
            if not len(encoded):
                continue
            ends = lists.offsets.to_numpy().astype(np.int64)
            length = np.diff(ends)
            code, doc = encoded.indices.to_numpy(), np.repeat(np.arange(len(length)), length)
            place = np.arange(len(code)) - np.repeat(ends[:-1] - ends[0], length)
            order = np.argsort(code.astype(np.int64) * len(length) + doc, kind="stable")
            code, doc, place = code[order], doc[order], place[order]
            first = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1]))))
            tf = np.diff(np.append(first, len(code)))
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(place, pa.int32()))
            code, doc = code[first], doc[first]
            dl = length[doc]
            weight = tf / (tf + K1 * (1 - B + B * dl / length[length > 0].mean()))
            # a term's postings by falling weight: only the first blocks of a term can be among the best
            order = np.lexsort((-weight, code))
            code, doc, tf, dl = code[order], doc[order], tf[order], dl[order]
            nth = np.arange(len(code)) - np.searchsorted(code, code)
            start = np.flatnonzero(nth % BLOCK == 0)
            cuts = pa.array(np.append(start, len(code)), pa.int32())
            listed = lambda x: pa.ListArray.from_arrays(cuts, x)
            columns = [
                pa.array(np.full(len(start), number), pa.int32()), encoded.dictionary.take(pa.array(code[start])).cast(pa.string()), pa.array(np.diff(np.append(start, len(code))), pa.int32()), pa.array(np.add.reduceat(tf, start), pa.int64()),
                pa.array(np.maximum.reduceat(tf, start), pa.int32()), pa.array(np.minimum.reduceat(dl, start), pa.int32()),
                listed(pa.concat_arrays(table["row"].chunks).take(pa.array(doc))), listed(pa.concat_arrays(table["k"].chunks).take(pa.array(doc))), listed(pa.array(tf, pa.int32())), listed(pa.array(dl, pa.int32())), listed(places.take(pa.array(order))),
            ]
            yield pa.RecordBatch.from_arrays(columns, _COLUMNS)

    return invert


_SCHEMA = "term string, n int, cf long, max_tf int, min_dl int, rows array<long>, keys array<{key}>, tf array<int>, dl array<int>, places array<array<int>>"
_COLUMNS = ["field", "term", "n", "cf", "max_tf", "min_dl", "rows", "keys", "tf", "dl", "places"]


def posting_blocks(docs: DataFrame, key: str, texts: dict[str, str]) -> DataFrame:
    """The blocks of all documents; fields come as their names."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    split = [tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"t{i}") for i, c in enumerate(texts.values())]
    schema = "field int, " + _SCHEMA.format(key=kind)
    # few input files must not leave cores idle; large inputs have more splits than cores and stay where they are
    cores = docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.select(*dict.fromkeys([key, *texts.values()]))
    rows = rows.repartition(cores) if docs.rdd.getNumPartitions() < cores else rows
    made = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), *split).mapInArrow(_inverted(len(texts)), schema)
    names = F.array(*map(F.lit, texts))
    return made.withColumn("field", F.element_at(names, F.col("field") + 1))


def postings_of(blocks: DataFrame, key: str) -> DataFrame:
    """field, term, row, key, tf, dl, places: a row for each posting."""
    zipped = F.arrays_zip(F.col("rows").alias("row"), F.col("keys").alias(key), F.col("tf").alias("tf"), F.col("dl").alias("dl"), F.col("places").alias("places"))
    rest = [c for c in blocks.columns if c not in _COLUMNS]
    return blocks.select("field", "term", *rest, F.inline(zipped))


def build_postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """field, term, row, key, tf, dl, places of all documents; documents without a word have none."""
    return postings_of(posting_blocks(docs, key, {"text": text}), key)


def bm25(docs: DataFrame, query: str, top_k: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of the documents that fit, from the table itself: one pass that keeps the query's words only.

    Queries of other than words have their postings made first.
    """
    node = parse(query, ("text",))
    if not _any_of(node) or any(x.kind != "word" or x.boost != 1 for x in leaves(node)):
        blocks = cut(posting_blocks(docs, key, {"text": text}), "blocks")
        return _Search(blocks, dictionary_of(blocks), _sizes(blocks, docs.count()), key).run(node, top_k)
    terms = sorted({x.words[0] for x in leaves(node)})
    tf = lambda term: F.size(F.filter("t", lambda x: x == term))
    split = docs.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("t")).select(key, F.size("t").alias("dl"), *(tf(t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = split.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    scored = split.where(" or ".join(f"tf{i} > 0" for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    total = F.lit(0.0)
    for i in range(len(terms)):
        total = total + _weight(F.col("n"), F.col(f"df{i}"), F.col(f"tf{i}"), F.col("dl"), F.col("avgdl"))
    out = scored.groupBy(key).agg(F.sum(total).alias("score"))
    return out if top_k is None else out.orderBy(F.desc("score"), key).limit(top_k)


def _weight(n: Column, df: Column, tf: Column, dl: Column, avgdl: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + K1 * (1 - B + B * dl / avgdl))


def dictionary_of(blocks: DataFrame) -> DataFrame:
    """field, term, df, cf of all words."""
    return blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("cf").alias("cf"))


def _sizes(blocks: DataFrame, n: int) -> dict[str, tuple[int, float]]:
    """Of each field the number of documents and the mean number of words."""
    return {r["field"]: (n, r["words"] / n) for r in blocks.groupBy("field").agg(F.sum("cf").alias("words")).collect()}


def _like(pattern: str) -> str:
    return re.sub(r"[%_\\]", r"\\\g<0>", pattern).replace("*", "%").replace("?", "_")


@dataclass
class _Search:
    """A query over blocks and their dictionary."""

    blocks: DataFrame
    dictionary: DataFrame
    sizes: dict[str, tuple[int, float]]
    key: str
    default: str | None = None
    #: Blocks that can't reach this score were left out of the last top-k.
    pruned_below: float = field(default=0.0, init=False)

    def _expanded(self, node: Node) -> DataFrame:
        """field, term, leaf, boost, constant, df of all words that the query means."""
        every, scored = leaves(node), set(leaves(node, True))
        out, met = [], {}
        known = self.dictionary
        for i, x in enumerate(every):
            of = x.field or self.default or next(iter(self.sizes), "text")
            mine = F.col("field") == of
            if x.kind == "wild":
                # the letters before the first sign bound the range of words that is read
                start = re.match(r"[^*?]*", x.words[0])[0]
                found = known.where(mine & F.col("term").startswith(start) & F.col("term").like(_like(x.words[0])))
                out.append(found.select("field", "term", F.lit(i).alias("leaf"), F.lit(x.boost if x in scored else 0.0).alias("boost"), F.lit(True).alias("constant"), "df"))
            elif x.kind == "fuzzy":
                word, edits = F.lit(x.words[0]), x.edits
                distance = F.levenshtein("term", word, edits)
                near = mine & F.char_length("term").between(len(x.words[0]) - edits, len(x.words[0]) + edits) & (distance >= 0)
                boost = F.lit(x.boost if x in scored else 0.0) * (1 - distance / F.least(F.char_length("term"), F.char_length(word)))
                out.append(known.where(near).select("field", "term", F.lit(i).alias("leaf"), boost.alias("boost"), F.lit(False).alias("constant"), "df"))
            else:
                weights = {w: 0.0 for w in x.words}
                if x in scored:
                    # a word counts once, by its highest boost
                    others = [y for y in scored if y.kind in ("word", "phrase") and (y.field or self.default) == (x.field or self.default)]
                    for w in weights:
                        best = max(y.boost for y in others if w in y.words)
                        if met.setdefault((of, w), i) == i:
                            weights[w] = best
                boost = F.element_at(F.create_map(*(F.lit(v) for pair in weights.items() for v in pair)), F.col("term"))
                out.append(known.where(mine & F.col("term").isin(*weights)).select("field", "term", F.lit(i).alias("leaf"), boost.alias("boost"), F.lit(False).alias("constant"), "df"))
        return reduce(DataFrame.unionByName, out)

    def _avgdl(self) -> Column:
        return F.element_at(F.create_map(*(F.lit(v) for f, (_, a) in self.sizes.items() for v in (f, float(a or 1.0)))), F.col("field"))

    def run(self, node: Node, top_k: int | None = None) -> DataFrame:
        if not self.sizes:
            return self.blocks.select(F.explode("keys").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        every = leaves(node)
        n = next(iter(self.sizes.values()))[0]
        wanted = self.blocks.join(self._expanded(node), ["field", "term"])
        weight = lambda tf, dl: F.col("boost") * _weight(F.lit(float(n)), F.col("df"), tf, dl, self._avgdl())
        if top_k is not None and _any_of(node) and all(x.kind == "word" for x in every):
            wanted = self._pruned(wanted.withColumn("most", weight(F.col("max_tf"), F.col("min_dl"))), weight, top_k)
        hits = postings_of(wanted, self.key).withColumn("w", F.when(F.col("constant"), F.lit(0.0)).otherwise(weight(F.col("tf"), F.col("dl"))))
        total, has = F.sum("w"), {}
        asked = []
        for i, x in enumerate(every):
            if x.kind == "wild":
                total = total + F.coalesce(F.max(F.when(F.col("leaf") == i, F.col("boost"))), F.lit(0.0))
            if x.kind == "phrase":
                asked.append(F.map_from_entries(F.collect_list(F.when(F.col("leaf") == i, F.struct("term", "places")))).alias(f"m{i}"))
                has[x] = _in_order(x.words, F.col(f"m{i}"))
            else:
                asked.append(F.bool_or(F.col("leaf") == i).alias(f"m{i}"))
                has[x] = F.col(f"m{i}")
        rows = hits.groupBy(self.key, "row").agg(total.alias("score"), *([] if _any_of(node) else asked))
        if not _any_of(node):
            rows = rows.where(_matches(node, has))
        out = rows.groupBy(self.key).agg(F.sum("score").alias("score"))
        return out if top_k is None else out.orderBy(F.desc("score"), self.key).limit(top_k)

    def _pruned(self, wanted: DataFrame, weight, top_k: int) -> DataFrame:
        """The blocks that can hold one of the best: their highest weight, with the highest ones of all other words,
        reaches the k-th best score found in the blocks of highest weight. A row for each word goes to the driver, and one score."""
        bounds = wanted.groupBy("field", "term").agg(F.max("most").alias("m")).collect()
        # the blocks of highest weight are read first; their sums are no higher than the true scores
        best = wanted.orderBy(F.desc("most")).limit(top_k)
        partial = postings_of(best, self.key).groupBy(self.key, "row").agg(F.sum(weight(F.col("tf"), F.col("dl"))).alias("s")).groupBy(self.key).agg(F.max("s").alias("s"))
        kth = partial.orderBy(F.desc("s")).limit(top_k).agg(F.min("s").alias("s"), F.count("*").alias("n")).first()
        self.pruned_below = kth["s"] * (1 - 1e-9) if kth["n"] == top_k else 0.0
        if not bounds or not self.pruned_below:
            return wanted
        others = sum(r["m"] for r in bounds)
        own = F.element_at(F.create_map(*(F.lit(v) for r in bounds for v in (f"{r['field']}\0{r['term']}", r["m"]))), F.concat("field", F.lit("\0"), "term"))
        return wanted.where(F.col("most") + F.lit(others) - own >= self.pruned_below)


def search_postings(postings: DataFrame, n_docs: int, avgdl: float, query: str, top_k: int | None = None, key: str = "doc_id") -> DataFrame:
    """key, score over a table as ``build_postings`` makes it."""
    one = {"n": F.lit(1), "cf": F.col("tf").cast("long"), "max_tf": F.col("tf"), "min_dl": F.col("dl"), "rows": F.array("row"), "keys": F.array(key), "tf": F.array("tf"), "dl": F.array("dl"), "places": F.array("places")}
    blocks = postings.select("field", "term", *(c.alias(name) for name, c in one.items()))
    return _Search(blocks, dictionary_of(blocks), {"text": (n_docs, avgdl)}, key).run(parse(query, ("text",)), top_k)


@dataclass(frozen=True)
class FullTextIndex:
    """A written index at ``path``: postings by part, dictionary, parts' ranges, statistics."""

    spark: SparkSession
    path: str
    key: str = "doc_id"

    @classmethod
    def create(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str | dict[str, str] = "text", parts: int | None = None) -> FullTextIndex:
        """``text`` names a column or, for several fields, their columns; the first field is searched where none is named."""
        texts = {"text": text} if isinstance(text, str) else text
        # written once: sorting by ranges looks at its input twice
        blocks = cut(posting_blocks(docs, key, texts), "blocks")
        full = (F.col("n") * 4 >= BLOCK).alias("full")
        sums = {r["full"]: r["n"] for r in blocks.groupBy(full).agg(F.sum("n").alias("n")).collect()}
        total = max(1, sum(sums.values()))
        parts = parts or max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART))
        order, made, first = ["field", "term", F.col("rows")[0]], cls(docs.sparkSession, path, key), 0
        # blocks of frequent words and the short ones of rare words apart, in parts by their postings: ranges are even by rows
        for kind in (True, False):
            own = max(1, round(parts * sums.get(kind, 0) / total))
            spread = blocks.where(full if kind else ~full).repartitionByRange(own, *order).sortWithinPartitions(*order)
            spread.withColumn("part", F.spark_partition_id() + first).write.mode("overwrite" if kind else "append").partitionBy("part").parquet(f"{path}/postings")
            first += own
        ends = F.min(F.struct("field", "term")).alias("first"), F.max(F.struct("field", "term")).alias("last")
        written = docs.sparkSession.read.schema(f"field string, {_SCHEMA.format(key=docs.schema[key].dataType.simpleString())}, part int").parquet(f"{path}/postings")
        written.groupBy("part").agg(*ends, F.sum("n").alias("postings")).coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
        dictionary_of(blocks).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/dictionary")
        words = made.dictionary().groupBy("field").agg(F.sum("cf").alias("words"))
        names = docs.sparkSession.createDataFrame([(i, f) for i, f in enumerate(texts)], "number int, field string")
        sizes = names.join(words, "field", "left").withColumn("n", F.lit(docs.count())).withColumn("words", F.coalesce("words", F.lit(0))).withColumn("key_type", F.lit(docs.schema[key].dataType.simpleString()))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")
        return made

    def blocks(self) -> DataFrame:
        kind = self._statistics[0]["key_type"]
        return self.spark.read.schema(f"field string, {_SCHEMA.format(key=kind)}, part int").parquet(f"{self.path}/postings")

    def postings(self) -> DataFrame:
        """field, term, row, key, tf, dl, places: a row for each posting."""
        return postings_of(self.blocks().drop("part"), self.key)

    def dictionary(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/dictionary")

    @cached_property
    def _statistics(self) -> list:
        return self.spark.read.parquet(f"{self.path}/statistics").orderBy("number").collect()  # a row for each field

    @property
    def _sizes(self) -> dict[str, tuple[int, float]]:
        return {r["field"]: (r["n"], r["words"] / r["n"] if r["n"] else 0.0) for r in self._statistics}

    def parts_of(self, node: Node) -> list[int]:
        """The parts whose range of words the query can meet (their table has a row for each part)."""
        default = next(iter(self._sizes))
        wanted = []
        for x in leaves(node):
            of = x.field or default
            if x.kind == "wild":
                start = re.match(r"[^*?]*", x.words[0])[0]
                wanted.append(((of, start), (of, start + "\U0010ffff")))
            elif x.kind == "fuzzy":
                wanted.append(((of, ""), (of, "\U0010ffff")))
            else:
                wanted += [((of, w), (of, w)) for w in x.words]
        bytes_of = lambda pair: tuple(p.encode() for p in pair)
        rows = self.spark.read.parquet(f"{self.path}/parts").collect()
        return sorted(r["part"] for r in rows if any(bytes_of(a) <= bytes_of(r["last"]) and bytes_of(b) >= bytes_of(r["first"]) for a, b in wanted))

    def search(self, query: str, top_k: int | None = None) -> DataFrame:
        """key, score of the documents that fit, best first with ``top_k``, ties by key."""
        return self._search(query).run(parse(query, tuple(self._sizes)), top_k)

    def _search(self, query: str) -> _Search:
        blocks = self.blocks().where(F.col("part").isin(self.parts_of(parse(query, tuple(self._sizes))))).drop("part")
        return _Search(blocks, self.dictionary(), self._sizes, self.key, next(iter(self._sizes)))
