"""Profiles of every column in one pass, as sketches that merge.

A sketch of a column is a row of bounded size: counts, least and greatest values, sizes of lists, a
HyperLogLog sketch of the values, a KLL sketch of the numbers and, where there are few, the texts.
Sketches of parts (days, files, labels) add up to the sketch of the whole, so a new part costs a scan
of that part alone. Groups below ``EXHAUSTIVE_BELOW`` rows are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.introspect import EXHAUSTIVE_BELOW, MAX_OPTIONS, type_name
from graphloom.sources.scratch import cut

#: Bits of the HyperLogLog sketch: a relative standard error of 0.65 %.
PRECISION = 14
#: Size parameter of the KLL sketch: a rank error of 1.3 % at most, with 99 % confidence.
KLL_SIZE = 200
#: Distinct texts that are followed; the options are given where a column has at most ``MAX_OPTIONS``, and are exact then.
TRACKED = 200
TEXT_LENGTH = 50
QUANTILES = (0.25, 0.5, 0.75)

_SKETCH = "struct<property:string,type:string,n:bigint,n_null:bigint,whole:struct<a:bigint,b:bigint>,real:struct<a:double,b:double>,text:struct<a:string,b:string>,size:struct<a:int,b:int>,hll:binary,kll:binary,options:array<string>>"


def _bounds(c: Column) -> Column:
    return F.struct(F.min(c).alias("a"), F.max(c).alias("b"))


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _hash(c: Column, kind: T.DataType) -> Column:
    """What counts as one value; maps, which have no hash, by their entries in order."""
    if isinstance(kind, T.MapType):
        c = F.to_json(F.array_sort(F.map_entries(c)))
    elif isinstance(kind, T.VariantType):
        c = F.to_json(c)
    return F.when(c.isNotNull(), F.xxhash64(c))


def _options(text: Column, hll: Column) -> Column:
    """The beginnings of all texts where these are few. The counters drop what is rare among many, so the sketch must say that all were followed."""
    top = F.call_function("approx_top_k", text, F.lit(MAX_OPTIONS + 1), F.lit(TRACKED))
    found = F.array_sort(F.filter(F.transform(top, lambda x: x.item), lambda x: x.isNotNull()))
    return F.when(F.hll_sketch_estimate(hll) <= MAX_OPTIONS, found)


def _sketch(name: str, kind: T.DataType) -> Column:
    c = _name(name)
    parts = {
        "property": F.lit(name), "type": F.lit(type_name(kind)), "n": F.count(F.lit(1)), "n_null": F.count_if(c.isNull()),
        "whole": F.lit(None), "real": F.lit(None), "text": F.lit(None), "size": F.lit(None), "kll": F.lit(None), "options": F.lit(None),
        "hll": F.hll_sketch_agg(_hash(c, kind), PRECISION),
    }
    if isinstance(kind, T.NumericType):
        number = c.cast("double")
        parts["whole" if isinstance(kind, T.IntegralType) else "real"] = _bounds(c.cast("bigint") if isinstance(kind, T.IntegralType) else number)
        parts["kll"] = F.kll_sketch_agg_double(number, F.lit(KLL_SIZE))
    elif isinstance(kind, T.ArrayType | T.MapType):
        parts["size"] = _bounds(F.when(c.isNotNull(), F.size(c)))
    elif isinstance(kind, T.AtomicType) and not isinstance(kind, T.BinaryType):
        text = F.substring(c.cast("string"), 1, TEXT_LENGTH)
        parts["text"] = _bounds(text)
        if isinstance(kind, T.StringType):
            parts["options"] = _options(text, parts["hll"])
    fields = T._parse_datatype_string(_SKETCH)
    return F.struct(*(parts[f.name].cast(f.dataType).alias(f.name) for f in fields))


def sketch(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, and a row for each other column: one aggregation, one scan, no rows expanded.

    An empty table without ``by`` gives rows with n = 0, with ``by`` none. Texts are compared by their
    first 50 characters. A column named twice raises, as any reference to it does.
    """
    parts = [_sketch(f.name, f.dataType) for f in df.schema.fields if f.name not in by]
    return df.groupBy(*(_name(c) for c in by)).agg(F.array(*parts).alias("_p")).select(*(_name(c) for c in by), F.inline("_p"))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of parts as those of the whole; a column of several types is text where one is, else FLOAT."""

    def bounds(name: str) -> Column:
        return F.struct(F.min(f"{name}.a").alias("a"), F.max(f"{name}.b").alias("b")).alias(name)

    kinds = F.array_sort(F.collect_set("type"))
    numbers = F.forall(kinds, lambda k: k.isin("INTEGER", "FLOAT"))
    kind = F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(numbers, F.lit("FLOAT")).otherwise(F.lit("STRING"))
    every = F.array_distinct(F.flatten(F.collect_set("options")))
    few = (F.count_if(F.col("type") != "STRING") == 0) & (F.count("options") == F.count_if(F.col("n") > F.col("n_null"))) & (F.hll_sketch_estimate(F.hll_union_agg("hll")) <= MAX_OPTIONS)
    out = sketches.groupBy(*(_name(c) for c in by), "property").agg(
        kind.alias("type"), F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), *(bounds(c) for c in ("whole", "real", "text", "size")),
        F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"), F.when(few, F.array_sort(every)).alias("options"),
    )
    return out.select(*(_name(c) for c in by), *(f.name for f in T._parse_datatype_string(_SKETCH)))


def read(sketches: DataFrame) -> DataFrame:
    """The figures of sketches: n_distinct and quantiles within the sketches' errors, the rest exact."""
    end = lambda e: F.coalesce(
        F.col(f"text.{e}"), F.when(F.col(f"real.{e}").isNotNull(), F.when(F.col(f"whole.{e}").isNotNull(), (F.least if e == "a" else F.greatest)(f"real.{e}", f"whole.{e}")).otherwise(F.col(f"real.{e}"))).cast("string"), F.col(f"whole.{e}").cast("string")
    )
    filled = F.col("kll").isNotNull() & (F.kll_sketch_get_n_double("kll") > 0)
    ranks = F.array(*(F.lit(q) for q in QUANTILES))
    return sketches.withColumns({
        "n_distinct": F.hll_sketch_estimate("hll"), "exact": F.lit(False), "least": end("a"), "greatest": end("b"),
        "shortest": F.col("size.a"), "longest": F.col("size.b"), "quantiles": F.when(filled, F.kll_sketch_get_quantile_double("kll", ranks)),
    }).drop("whole", "real", "text", "size", "hll", "kll")


def profile(df: DataFrame, by: Sequence[str] = (), exact_below: int = EXHAUSTIVE_BELOW) -> DataFrame:
    """``by``, property, type, n, n_null, options, n_distinct, exact, least, greatest, shortest, longest, quantiles.

    Groups of fewer than ``exact_below`` rows have exact distinct counts, from a second scan that keeps
    only these groups; the others keep the sketch's. NaN counts as a value and has no quantile.
    """
    by = list(by)
    found = cut(read(sketch(df, by)), "profile")
    small = found.where(F.col("n") < exact_below).select(*(_name(c).alias(f"_by{i}") for i, c in enumerate(by)), F.lit(1).alias("_small")).distinct()
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & _name(c).eqNullSafe(F.col(f"_by{i}"))
    rows = df.join(small, same, "left_semi")
    values = F.array(*(F.struct(F.lit(f.name).alias("property"), _hash(_name(f.name), f.dataType).alias("h")) for f in df.schema.fields if f.name not in by))
    counted = rows.select(*(_name(c).alias(f"_by{i}") for i, c in enumerate(by)), F.inline(values)).groupBy(*(f"_by{i}" for i in range(len(by))), "property").agg(F.count_distinct("h").alias("_exact"))
    counted = counted.withColumnRenamed("property", "_property")
    out = found.join(counted, same & (F.col("property") == F.col("_property")), "left")
    exact = F.col("_exact").isNotNull() | (F.col("n") == 0)
    return out.select(*(F.when(exact, F.coalesce("_exact", F.lit(0).cast("long"))).otherwise(F.col(c)).alias(c) if c == "n_distinct" else exact.alias(c) if c == "exact" else _name(c) for c in found.columns))


def property_profile(rows: DataFrame, by: str, props: str = "props") -> DataFrame:
    """``by``, property, type, n, n_null, n_distinct, least, greatest, options of generic rows with a map of texts.

    Nodes by label and relationships by type alike. A property is INTEGER or FLOAT where each of its
    values reads as one, else STRING; least and greatest follow that type. A null or empty map has no property.
    """
    long = rows.select(_name(by).alias(by), F.explode(props).alias("property", "value"))
    value = F.col("value")
    text = F.substring(value, 1, TEXT_LENGTH)
    hll = F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), PRECISION)
    whole, real = value.try_cast("bigint"), value.try_cast("double")
    agg = long.groupBy(by, "property").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(value.isNull()).alias("n_null"), F.count_if(value.isNotNull() & whole.isNull()).alias("_w"), F.count_if(value.isNotNull() & real.isNull()).alias("_r"),
        F.hll_sketch_estimate(hll).alias("n_distinct"), _bounds(whole).alias("_a"), _bounds(real).alias("_b"), _bounds(text).alias("_c"), _options(text, hll).alias("_o"),
    )
    kind = F.when((F.col("_w") == 0) & (F.col("n") > F.col("n_null")), "INTEGER").when((F.col("_r") == 0) & (F.col("n") > F.col("n_null")), "FLOAT").otherwise("STRING")
    end = lambda e: F.when(F.col("type") == "INTEGER", F.col(f"_a.{e}").cast("string")).when(F.col("type") == "FLOAT", F.col(f"_b.{e}").cast("string")).otherwise(F.col(f"_c.{e}"))
    named = agg.withColumn("type", kind)
    return named.select(by, "property", "type", "n", "n_null", "n_distinct", end("a").alias("least"), end("b").alias("greatest"), F.when(F.col("type") == "STRING", F.col("_o")).alias("options"))
