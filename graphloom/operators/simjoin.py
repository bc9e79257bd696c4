"""Exact similarity joins: names by the weighted fuzzy ratio, vectors by cosine. No pair above the threshold is lost.

**Names.** A ratio of r between two strings means that they share many characters and, where r is high, many
bigrams; how many follows from the lengths. With the rarest first, two strings that share ``need`` of their
parts share one within each one's first ``all - need + 1`` (prefix filter), so strings meet by those only. The
weighted ratio is the largest of several: of the names as they are, with words sorted, by common
words, and by the best window of a longer name. Each has a signature of its own; pairs that meet are compared once.

**Names by edit distance.** Names within k edits, the longer one cut in k // 2 + 1 pieces, agree in a piece but for one edit, so the
piece and what stands there in the shorter one have a text in common after a character is left out. They meet by the whole of it.

**Vectors.** Pivots taken from the vectors make cells; by the triangle inequality of angles a vector can only
match in cells whose radius, widened by the threshold's angle, reaches it (equal keys have as many cells as keep blocks full), and there only members
whose angle to the pivot is like its own. Cells of more than ``CELL`` members are cut in blocks, their visitors
too; a block of members meets one of visitors as a product of two matrices.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.similarity import weighted_ratio_udf
from graphloom.session import ship
from graphloom.sources.scratch import cut

#: Vectors that stand for cells at most; members that a block of a cell has, about.
PIVOTS, CELL = 32, 4096
#: Visitors of a block that meet it in one task, about; those of one product.
VISITORS, STRIP = 16384, 512
_NEAR = 1e-9
#: Numbers of 64 bits that stand for a name's characters.
MASKS = 2


def _grams(text: str, size: int) -> list[str]:
    """Runs of ``size`` characters, the second of a kind marked as the second."""
    seen: dict[str, int] = {}
    out = []
    for i in range(len(text) - size + 1):
        g = text[i : i + size]
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}\0{seen[g]}")
    return out


def _share_of_characters(ratio: float) -> float:
    """A string shares at least this part of its characters with any other of such a ratio."""
    return ratio / (2 - ratio)


def _shared_bigrams(n: int, ratio: float) -> float:
    """A string of n characters shares at least so many bigrams with any other of such a ratio.

    By the longest common subsequence l, 3 l - n - m - 1 bigrams stay, where l is ratio (n + m) / 2 or more and
    m is at least n times the share of characters.
    """
    return (3 * ratio - 2) / (2 - ratio) * n - 1


def signatures(text: str, threshold: float) -> list[tuple[str, int, str, int, float]]:
    """(kind, role, part, weight, need): pairs meet by role 1 of one and, in kinds that end in <, role 2 of a longer name, else role 1 of the other."""
    words = text.split()
    ordered, distinct = " ".join(sorted(words)), " ".join(sorted(set(words)))
    out: list[tuple[str, int, str, int, float]] = []

    def same_length(kind: str, view: str, ratio: float, bigrams: bool = True) -> None:
        if not 0 < ratio <= 1 + _NEAR or not view:
            return
        ratio = min(ratio, 1.0)
        share = _share_of_characters(ratio)
        # from this length on a bigram is shared; pairs with a shorter string meet by characters
        long = math.inf if not bigrams or 3 * ratio - 2 <= _NEAR else 2 * (2 - ratio) / (3 * ratio - 2) + _NEAR
        if len(view) >= long:
            out.extend((f"{kind}2", 1, g, 1, _shared_bigrams(len(view), ratio) - _NEAR) for g in _grams(view, 2))
        if len(view) < long or share * len(view) < long + _NEAR:
            out.extend((f"{kind}1", 1, g, 1, share * len(view) - _NEAR) for g in _grams(view, 1))

    def window(kind: str, view: str, ratio: float) -> None:
        if not 0 < ratio <= 1 + _NEAR or not view:
            return
        ratio = min(ratio, 1.0)
        need = _shared_bigrams(len(view), ratio) - _NEAR
        if need > _NEAR:
            out.extend((f"{kind}2<", 1, g, 1, need) for g in _grams(view, 2))
        else:
            out.extend((f"{kind}1<", 1, g, 1, _share_of_characters(ratio) * len(view) - _NEAR) for g in _grams(view, 1))
        out.extend((f"{kind}2<", 2, g, 1, 0.0) for g in _grams(view, 2))
        out.extend((f"{kind}1<", 2, g, 1, 0.0) for g in _grams(view, 1))

    same_length("plain", text, threshold)
    same_length("sorted", ordered, threshold / 0.95)
    same_length("words", distinct, threshold / 0.95, bigrams=False)
    if threshold / 0.95 <= 1 + _NEAR:
        need = _share_of_characters(min(1.0, threshold / 0.95)) * len(distinct) - _NEAR
        out += [("covered*", 1, w, len(w) + 1, need) for w in set(words)] + [("covered*", 2, w, len(w) + 1, 0.0) for w in set(words)]
    for scale, longest in ((0.9, 8), (0.6, math.inf)):
        if threshold <= scale + _NEAR:
            window(f"window{longest}", text, threshold / scale)
            window(f"sorted window{longest}", ordered, threshold / scale / 0.95)
            window(f"words window{longest}", distinct, threshold / scale / 0.95)
            if threshold <= 0.95 * scale + _NEAR:
                out += [(f"word{longest}", 1, w, 1, 0.0) for w in set(words)]
    return out


def _views(text: str) -> dict[str, str]:
    """By kind of signature, what must be within the edits of its ratio (a set's words in any order: its characters in order)."""
    words = text.split()
    ordered, letters = " ".join(sorted(words)), "".join(sorted(" ".join(sorted(set(words)))))
    return {"plain1": text, "plain2": text, "sorted1": ordered, "sorted2": ordered, "words1": letters}


def _masks(view: str) -> list[int]:
    """A bit for each character of the view, the second of a kind apart from the first."""
    bits = 0
    for g in _grams(view, 1):
        bits |= 1 << zlib.crc32(g.encode("utf-8", "surrogatepass")) % (64 * MASKS)
    return [((bits >> 64 * i) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(MASKS)]


def _may_reach(threshold: float) -> Column:
    """Of two names x, y that met: whether their lengths and views let the kind's ratio reach the threshold. Runs before any Python."""
    ratio = F.when(F.col("kind").startswith("plain"), F.lit(min(1.0, threshold))).otherwise(F.lit(min(1.0, threshold / 0.95)))
    nx, ny = F.char_length("vx"), F.char_length("vy")
    # characters that each may have beyond the common subsequence; a bit that only one has is at least one of them
    spare = {"x": F.floor(nx - ratio * (nx + ny) / 2 + 1e-6), "y": F.floor(ny - ratio * (nx + ny) / 2 + 1e-6)}
    own = lambda a, b: sum((F.bit_count(F.col(f"m{i}{a}").bitwiseAND(F.bitwise_not(f"m{i}{b}"))) for i in range(MASKS)), F.lit(0))
    near = (own("x", "y") <= spare["x"]) & (own("y", "x") <= spare["y"])
    near = near & (F.call_function("levenshtein", "vx", "vy", (spare["x"] + spare["y"]).cast("int")) >= 0)
    longer = F.greatest("nx", "ny") >= 1.5 * F.least("nx", "ny")
    windows = F.col("kind").rlike("window|^word[^s]")
    viewed = F.col("kind").isin("plain1", "plain2", "sorted1", "sorted2", "words1")
    return F.when(windows, longer).when(viewed, near).otherwise(True)


def name_candidates(nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b, ta, tb: pairs of one label that may reach the threshold, each once; ``nodes`` has id, label, t (not empty)."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    kind = nodes.schema["id"].dataType.simpleString(), nodes.schema["label"].dataType.simpleString()
    masked = [f"m{i}" for i in range(MASKS)]
    ship(nodes.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch["t"].to_pylist()):
                found, views = signatures(text, threshold), _views(text)
                at += [i] * len(found)
                masks = {v: _masks(v) for v in {"", *views.values()}}
                rows += [(*r, v, len(text), *masks[v]) for r in found for v in (views.get(r[0], ""),)]
            columns = [batch[c].take(pa.array(at, pa.int64())) for c in ("id", "label")]
            columns += [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int32(), *[pa.int64()] * MASKS))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "kind", "role", "part", "weight", "need", "view", "n", *masked])

    signed = cut(nodes.select("id", "label", "t").mapInArrow(sign, f"id {kind[0]}, label {kind[1]}, kind string, role int, part string, weight int, need double, view string, n int, {', '.join(f'{m} long' for m in masked)}"), "signatures")
    known = signed.groupBy("label", "kind", "part").agg(F.count("*").alias("rows"))
    # rarest first; what follows a part, itself included, must be able to hold the need
    rest = F.sum("weight").over(Window.partitionBy("id", "kind", "role").orderBy(F.desc("rows"), F.desc("part")))
    kept = cut(signed.join(known, ["label", "kind", "part"]).withColumn("rest", rest).where(F.col("rest") >= F.col("need")).select("id", "label", "kind", "role", "part", "view", "n", *masked), "prefixes")
    left = kept.where("role = 1").select(F.col("id").alias("x"), "label", "kind", "part", F.col("view").alias("vx"), F.col("n").alias("nx"), *(F.col(m).alias(f"{m}x") for m in masked))
    partner = F.when(F.col("kind").rlike("[<*]$"), 2).otherwise(1)
    right = kept.where(F.col("role") == partner).select(F.col("id").alias("y"), "label", "kind", "part", F.col("view").alias("vy"), F.col("n").alias("ny"), *(F.col(m).alias(f"{m}y") for m in masked))
    met = left.join(right, ["label", "kind", "part"]).where(F.when(F.col("kind").rlike("[<*]$"), F.col("x") != F.col("y")).otherwise(F.col("x") < F.col("y"))).where(_may_reach(threshold))
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    texts = nodes.select("id", "t")
    return pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")


def name_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b) of one label whose weighted ratio reaches the threshold; ids are distinct. Equal names meet as one."""
    ready = nodes.where(F.col("t").isNotNull() & (F.col("t") != ""))
    # names, not nodes, are compared: copies of a name are joined to it afterwards
    names = cut(ready.groupBy("label", "t").agg(F.min("id").alias("id")), "names")
    found = name_candidates(names, threshold).where(weighted_ratio_udf("ta", "tb") >= threshold)
    similar = found.join(names.select(F.col("id").alias("a"), "label"), "a").select("label", "ta", "tb")
    same = names.select("label", F.col("t").alias("ta"), F.col("t").alias("tb"))
    both = similar.unionByName(similar.select("label", F.col("tb").alias("ta"), F.col("ta").alias("tb"))).unionByName(same)
    of = lambda node, text: ready.select(F.col("id").alias(node), "label", F.col("t").alias(text))
    return both.join(of("a", "ta"), ["label", "ta"]).join(of("b", "tb"), ["label", "tb"]).where("a < b").select("a", "b").distinct()


def _without_one(text: str) -> set[str]:
    return {text[:i] + text[i + 1 :] for i in range(len(text))} or {""}


def edit_signatures(text: str, threshold: float) -> tuple[set[tuple], set[tuple]]:
    """What a name meets others by, as the longer one of a pair (or as long) and as the shorter one: length of the longer, piece, kind, part."""
    n = len(text)
    allowed = lambda m: math.floor((1 - threshold) * m + _NEAR)
    cuts = lambda m: [m * j // (allowed(m) // 2 + 1) for j in range(allowed(m) // 2 + 2)]
    long, short = set(), set()
    at = cuts(n)
    for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        long |= {(n, j, "less", w) for w in _without_one(text[a:b])}
        if len(at) > 2:
            long.add((n, j, "same", text[a:b]))
    m = n
    while m - n <= allowed(m):
        at = cuts(m)
        for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            # of the pieces before each has two edits at least, else it would do
            reach = min(2 * j + 1, allowed(m)) if j else 0
            for start in range(max(0, a - reach), min(n, a + reach) + 1):
                for size in (b - a - 1, b - a, b - a + 1):
                    stop = start + size
                    if size < 0 or stop > n or (j == len(at) - 2 and stop != n):
                        continue
                    part = text[start:stop]
                    if size < b - a:
                        short.add((m, j, "less", part))
                    elif size == b - a:
                        short |= {(m, j, "less", w) for w in _without_one(part)}
                    else:
                        short |= {(m, j, "same", w) for w in _without_one(part)}
        m += 1
    return long, short


def _edit_names(nodes: DataFrame, text: str, threshold: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """id, name of each node, and x, y: names (numbers, each of one text and of equal ``keys``) that are as alike as the threshold."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    ship(nodes.sparkSession)
    ready = nodes.select("id", *keys, F.col(text).alias("t")).dropna(subset=["id", *keys, "t"])
    names = cut(ready.groupBy(*keys, "t").agg(F.min("id").alias("least")).withColumn("name", F.monotonically_increasing_id()), "names")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch["t"].to_pylist()):
                for role, found in enumerate(edit_signatures(t, threshold)):
                    at += [i] * len(found)
                    rows += [(role, "%d %d %s %s" % r) for r in found]
            yield pa.RecordBatch.from_arrays([*(batch[c].take(pa.array(at, pa.int64())) for c in ("name", "k")), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["name", "k", "role", "part"])

    signed = names.select("name", F.xxhash64(*keys, F.lit(0)).alias("k"), "t").mapInArrow(sign, "name long, k long, role int, part string")
    signed = cut(signed.select("name", "role", F.xxhash64("k", "part").alias("part")), "signatures")
    met = signed.where("role = 0").select(F.col("name").alias("x"), "part").join(signed.where("role = 1").select(F.col("name").alias("y"), "part"), "part").where("x <> y")
    pairs = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda n: names.select(F.col("name").alias(n), F.struct(*keys).alias(f"k{n}"), F.col("t").alias(f"t{n}"))
    alike = 1 - F.levenshtein("tx", "ty") / F.greatest(F.char_length("tx"), F.char_length("ty"), F.lit(1)) >= threshold
    pairs = pairs.join(side("x"), "x").join(side("y"), "y").where((F.col("kx") == F.col("ky")) & alike).select("x", "y")
    named = ready.join(names, [*keys, "t"]).select("id", "name", "least")
    return named, cut(pairs, "similar names")


def edit_pairs(nodes: DataFrame, text: str, threshold: float, keys: list[str]) -> DataFrame:
    """a, b (a < b) of equal ``keys`` whose Levenshtein distance is at most 1 - threshold of the longer name; nulls take no part."""
    named, pairs = _edit_names(nodes, text, threshold, keys)
    named = cut(named.select("id", "name"), "named")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(named.select(F.col("name").alias("x"), F.col("name").alias("y")).distinct())
    return both.join(named.toDF("a", "x"), "x").join(named.toDF("b", "y"), "y").where("a < b").select("a", "b").distinct()


def edit_links(nodes: DataFrame, text: str, threshold: float, keys: list[str]) -> DataFrame:
    """a, b: as ``edit_pairs``, but of the copies of a name only the smallest id is linked to other names, and each copy to it."""
    named, pairs = _edit_names(nodes, text, threshold, keys)
    named = cut(named, "named")
    least = named.select("name", "least").distinct()
    links = pairs.join(least.toDF("x", "a"), "x").join(least.toDF("y", "b"), "y").select("a", "b")
    return links.unionByName(named.where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))).where("a <> b").distinct()


def _placing(chosen: np.ndarray):
    """To batches of vectors (v, n: the cells that their keys have): the angles to the first n pivots, the nearest one and its angle."""

    def placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, pivots, cells = batch["v"].value_lengths().to_numpy(), len(chosen), batch["n"].to_numpy()
            angles = np.empty((len(batch), pivots))
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                rows = _rows(batch["v"].take(pa.array(at)))
                fit = np.zeros((pivots, size))  # what one of the two does not have counts as zeros
                fit[:, : chosen.shape[1]] = chosen[:, :size]
                with np.errstate(invalid="ignore", over="ignore"):
                    cosines = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) @ fit.T
                angles[at] = np.arccos(np.clip(np.where(np.isnan(cosines), 1.0, cosines), -1.0, 1.0))
            cell = np.where(np.arange(pivots) < cells[:, None], angles, np.inf).argmin(axis=1)
            r = angles[np.arange(len(batch)), cell]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * pivots, pa.int32()), pa.array(angles.ravel()))
            added = {"angles": flat, "cell": pa.array(cell, pa.int32()), "r": pa.array(r)}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], [*batch.schema.names, *added])

    return placing


def _placed(nodes: DataFrame, vector: str, threshold: float, keys: list[str], pivots: int) -> tuple[DataFrame, DataFrame, float] | None:
    """Members of cells (cell, block, x, vx, r) and their visitors (cell, block, y, vy, own, s), with ``keys`` and the threshold's angle."""
    ship(nodes.sparkSession)
    squares = F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x)
    vectors = cut(nodes.select("id", *keys, F.col(vector).alias("v")).where(squares > 0), "vectors")
    alpha = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    found = [[float(x) for x in r["v"]] for r in vectors.orderBy(F.xxhash64("id")).limit(pivots).collect()]  # a bounded number of vectors
    if not found:
        return None
    chosen = np.zeros((len(found), max(map(len, found))))
    for row, p in zip(chosen, found, strict=True):
        row[: len(p)] = np.array(p) / math.sqrt(sum(x * x for x in p))
    # a cell spares less than its visitors cost where it has few members: as many as keep blocks full
    few = F.least(F.ceil(F.count("*") / F.lit(CELL)), F.lit(len(found))).cast("int").alias("n")
    counted = vectors.join(cut(vectors.groupBy(keys).agg(few), "sizes"), keys)
    schema = T.StructType([*counted.schema.fields, T.StructField("angles", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType()), T.StructField("r", T.DoubleType())])
    placed = cut(counted.mapInArrow(_placing(chosen), schema), "placed")
    radius = {r["cell"]: r["r"] for r in placed.groupBy("cell").agg(F.max("r").alias("r")).collect()}  # a row for each pivot
    blocks = cut(placed.groupBy(*keys, "cell").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("blocks")), "cells")
    members = placed.join(blocks, [*keys, "cell"]).select(*keys, "cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), F.col("id").alias("x"), F.col("v").alias("vx"), "r")
    reach = F.array(*(F.lit(radius.get(i, -math.inf)) + alpha for i in range(len(chosen))))
    # a vector goes to its own cell and to the cells before it that it can reach
    cells = F.filter(F.sequence(F.lit(0), F.col("cell")), lambda i: (i == F.col("cell")) | (F.get("angles", i) <= F.get(reach, i)))
    probes = placed.select("id", "v", *keys, "angles", F.col("cell").alias("own"), F.explode(cells).alias("cell"))
    probes = probes.join(blocks, [*keys, "cell"]).select(*keys, "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("id").alias("y"), F.col("v").alias("vy"), "own", F.get("angles", F.col("cell")).alias("s"))
    return members, probes, alpha


def vector_candidates(nodes: DataFrame, vector: str, threshold: float, keys: list[str], pivots: int = PIVOTS) -> DataFrame:
    """a, b, va, vb: pairs of equal ``keys`` that may reach the cosine, each once; vectors of length zero take no part."""
    sides = _placed(nodes, vector, threshold, keys, pivots)
    if sides is None:
        return nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col(vector).alias("va"), F.col(vector).alias("vb")).limit(0)
    members, probes, alpha = sides
    near = (F.abs(F.col("r") - F.col("s")) <= alpha) & ((F.col("own") != F.col("cell")) | (F.col("x") < F.col("y")))
    met = members.join(probes, [*keys, "cell", "block"]).where(near)
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("vx")).otherwise(F.col("vy")).alias("va"), F.when(first, F.col("vy")).otherwise(F.col("vx")).alias("vb"))


def _rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """With the sums in the order of the expression ``cosine``."""
    total = lambda x, y: sum(map(float.__mul__, x.tolist(), y.tolist()), 0.0)
    return total(a, b) / (math.sqrt(total(a, a)) * math.sqrt(total(b, b)))


def _products(threshold: float):
    """a, b of a block of members and one of visitors that reach the cosine, by a product of matrices."""

    def products(members: pa.Table, probes: pa.Table) -> pa.Table:
        if not len(members) or not len(probes):
            none = pa.array([], (members["x"] if len(members) else probes["y"]).type)
            return pa.table([none, none], names=["a", "b"])
        v, w = _rows(members["vx"]), _rows(probes["vy"])
        p, q = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (v, w))
        at: tuple[list, list] = ([], [])
        for start in range(0, len(q), STRIP):
            near = p @ q[start : start + STRIP].T
            i, j = np.nonzero(~(near < threshold - _NEAR))
            # so near the threshold the order of the sums decides
            close = np.flatnonzero(near[i, j] < threshold + _NEAR)
            lost = [k for k in close.tolist() if _cosine(v[i[k]], w[start + j[k]]) < threshold]
            at[0].append(np.delete(i, lost))
            at[1].append(np.delete(j, lost) + start)
        i, j = (pa.array(np.concatenate(x)) for x in at)
        x, y = members["x"].combine_chunks().take(i), probes["y"].combine_chunks().take(j)
        first, other = pc.less(x, y), pc.not_equal(probes["own"].combine_chunks().take(j), probes["cell"][0])
        keep = pc.and_(pc.not_equal(x, y), pc.or_(first, other))
        return pa.table([pc.if_else(first, x, y), pc.if_else(first, y, x)], names=["a", "b"]).filter(keep)

    return products


def vector_pairs(nodes: DataFrame, vector: str, threshold: float, keys: list[str], pivots: int = PIVOTS) -> DataFrame:
    """a, b (a < b) of equal ``keys`` whose cosine reaches the threshold, which is over 0; null vectors take no part."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    kind = nodes.schema["id"].dataType.simpleString()
    ready = nodes.where(F.col(vector).isNotNull() & F.col("id").isNotNull()).withColumn("_size", F.size(vector)).dropna(subset=keys)
    sides = _placed(ready, vector, threshold, [*keys, "_size"], pivots)
    if sides is None:
        return ready.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    members, probes, _ = sides
    at = [*keys, "_size", "cell", "block"]
    # visitors of a block are dealt in parts, to each of which the block goes
    parts = cut(probes.groupBy(at).agg(F.ceil(F.count("*") / F.lit(VISITORS)).cast("int").alias("parts")), "visitors")
    members = members.join(parts, at).select(*at, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "x", "vx")
    probes = probes.join(parts, at).select(*at, F.pmod(F.xxhash64("y", F.lit(1)), "parts").cast("int").alias("part"), "y", "vy", "own")
    of = [*at, "part"]
    members, probes = members.toDF(*members.columns), probes.toDF(*probes.columns)  # columns of their own: both come from one table
    return members.groupBy(of).cogroup(probes.groupBy(of)).applyInArrow(_products(threshold), f"a {kind}, b {kind}").distinct()
