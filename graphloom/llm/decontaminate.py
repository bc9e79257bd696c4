"""Benchmark decontamination with DataFrame functions only (operator 9).

A distributed positional inverted index. Term frequencies over all documents tell the rarest term
of each test window. The documents' word lists are stored once, in order of position. Only postings (document, position) of those anchor terms are stored, each with
the words around it; joined with the anchors of the test items and aligned by offset, equal words
left and right of the anchor give the exact phrase matches. A window of which the anchor and at least
``NEAR_SHARE`` of all words stand at their offsets is a proximity match; one whose rarest word no
document holds has no anchor and none.

Test items are a query set: they go through in blocks of at most ``BLOCK_WORDS`` words, so that what
is broadcast (vocabulary, anchors with their context) is bounded. Documents are never grouped by
term; hits are aggregated by document, and a document's hits are bounded by its own words.

Null and empty texts have no words. Rows are judged one by one, repeated rows included. Null items
and items without words match nothing. Rows of one item id are judged each by its own text and reported
as one id. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
RATIO = 20
#: Share of a window's words that must stand at their offsets for a proximity match.
NEAR_SHARE = 0.8
#: Bound of one block of test items.
BLOCK_WORDS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands after a document's last word, and so carries the number of words; no word is empty.
_LAST = ""


def words(text: Column) -> Column:
    """Runs outside ASCII punctuation, space and control characters, with A-Z lower-cased."""
    low = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _same(a: Column, b: Column) -> Column:
    """At each place whether both lists have the same word there; the end of one is a difference."""
    return F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))


def _leading(same: Column) -> Column:
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1)


def _best_window(left: Column, right: Column, sl: Column, sr: Column, need: Column) -> Column:
    """The most equal words, anchor included, that one window of ``need`` words around the anchor has."""

    def equal(i: Column) -> Column:
        j = need - 1 - i
        inside = (i <= F.size(left)) & (j <= F.size(right))
        held = F.concat(F.slice(sl, F.lit(1), i), F.slice(sr, F.lit(1), j))
        return F.when(inside, F.size(F.filter(held, lambda x: x)) + 1).otherwise(0)

    return F.array_max(F.transform(F.sequence(F.lit(0), need - 1), equal))


def _before(words: Column, pos: Column, n: int) -> Column:
    """The up to n words before position pos (from 0), nearest first."""
    return F.reverse(F.slice(words, F.greatest(pos - n + 1, F.lit(1)), F.least(pos, F.lit(n))))


def _after(words: Column, pos: Column, n: int) -> Column:
    return F.slice(words, pos + 2, F.lit(n))


def test_anchors(items: DataFrame, frequencies: DataFrame, window: int) -> DataFrame:
    """For each window of each item its rarest term: item, term, pos, n, words around it."""
    listed = items.select("item", F.xxhash64("w").alias("of"), "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "term"))
    rated = listed.join(F.broadcast(frequencies), "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    ahead = Window.partitionBy("item", "of").orderBy("pos").rowsBetween(0, window - 1)
    rarest = rated.withColumn("best", F.min(F.struct("tf", "term", "pos")).over(ahead)).where(F.col("pos") <= F.greatest(F.col("n") - window, F.lit(0)))
    anchors = rarest.where("best.tf > 0").select("item", "of", "w", "n", F.col("best.term").alias("term"), F.col("best.pos").alias("pos")).dropDuplicates(["item", "of", "pos"])
    return anchors.select("term", "item", "n", "pos", _before(F.col("w"), F.col("pos"), window - 1).alias("left"), _after(F.col("w"), F.col("pos"), window - 1).alias("right"))


def find_matches(docs: DataFrame, items: DataFrame, window: int, with_ends: bool) -> DataFrame:
    """A row for each aligned anchor: row, key, item and span matched exactly, else item nearly so.

    ``with_ends``: also a row for each document whose ``last``, without ``first``, is its number of words.
    """
    vocabulary = items.select(F.explode("w").alias("term")).distinct()
    terms = docs.select(F.explode("w").alias("term"))
    frequencies = terms.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.count("*").alias("tf"))
    anchors = test_anchors(items, frequencies, window)
    if with_ends:
        none = F.array().cast("array<string>")
        anchors = anchors.unionByName(docs.sparkSession.range(1).select(F.lit(_LAST).alias("term"), F.lit(None).cast("string").alias("item"), F.lit(0).alias("n"), F.lit(0).alias("pos"), none.alias("left"), none.alias("right")))
    anchors = cut(anchors, "anchors")  # bounded by the block
    listed = docs.select("row", "key", "w", F.posexplode(F.array_append("w", F.lit(_LAST))).alias("at", "term"))
    hits = listed.join(F.broadcast(anchors), "term")
    # The words around leave the generated code of explode and join; the whole list never does, as
    # that would be a copy of the document for each of its words. No filter follows: it would move
    # into the join, whose condition then could not be generated.
    left, right = _before(F.col("w"), F.col("at"), window - 1), _after(F.col("w"), F.col("at"), window - 1)
    aligned = hits.select("row", "key", "item", "n", "at", left.alias("dl"), right.alias("dr"), F.col("left"), F.col("right"))
    sl, sr = _same(F.col("dl"), F.col("left")), _same(F.col("dr"), F.col("right"))
    need = F.least(F.col("n"), F.lit(window))
    around = F.size(F.filter(F.concat(sl, sr), lambda x: x)) + 1  # no window has more
    alike = F.when(F.col("item").isNotNull() & (around >= NEAR_SHARE * need), _best_window(F.col("left"), F.col("right"), sl, sr, need)).otherwise(0)
    measured = aligned.select("row", "key", "item", "at", need.alias("need"), _leading(sl).alias("l"), _leading(sr).alias("r"), alike.alias("alike"))
    exact = F.col("item").isNotNull() & (F.col("l") + F.col("r") + 1 >= F.col("need"))
    near = F.col("item").isNotNull() & ~exact & (F.col("alike") >= NEAR_SHARE * F.col("need"))
    first, last = F.when(exact, F.col("at") - F.col("l")), F.when(F.col("item").isNull(), F.col("at")).when(exact, F.col("at") + F.col("r"))
    return measured.select("row", "key", first.cast("long").alias("first"), last.cast("long").alias("last"), F.when(exact, F.col("item")).alias("item"), F.when(near, F.col("item")).alias("near"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, ratio: int = RATIO) -> DataFrame:
    """row, key, n_words, n_hit, items (sorted ids of exact matches), near_items, contaminated."""
    # tokenised once, and a row keeps its number when a task is lost
    listed = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("w")), "words")
    split = items.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    split = cut(split.distinct(), "items")
    total = split.agg(F.sum(F.size("w")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    found = []
    for b in range(blocks):
        block = split.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else split
        found.append(find_matches(listed, block, window, with_ends=b == 0))
    hits = reduce(DataFrame.unionByName, found)
    of_row = hits.groupBy("row").agg(
        F.min("key").alias(key),
        F.max(F.when(F.col("first").isNull(), F.col("last"))).alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("item").isNotNull(), F.struct("first", "last")))).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("items"),
        F.array_sort(F.collect_set("near")).alias("near"),
    )
    start = F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(F.greatest(a.end, s.last).alias("end"), (a.n + F.greatest(F.lit(0), s.last - F.greatest(a.end, s.first - 1))).alias("n")), lambda a: a.n)
    return of_row.select("row", key, "n_words", covered.alias("n_hit"), "items", F.array_except("near", "items").alias("near_items")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (ratio * F.col("n_hit") >= F.col("n_words"))
    )
