"""Schemas inferred from the payloads that are there."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from .graph import PropertyGraph

_NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"
#: What a variant's type may be, the first known ones before UNKNOWN.
_TYPES = ["BOOL", "NUMERIC", "OBJECT", "STRING", "[BOOL]", "[NUMERIC]", "[OBJECT]", "[STRING]", "[UNKNOWN]", "UNKNOWN"]


def _kind(v: Column) -> Column:
    """Type name of a variant; an array's is that of its first item in brackets."""
    def scalar(x: Column) -> Column:
        t = F.schema_of_variant(x)
        return F.when(t == "STRING", "STRING").when(t == "BOOLEAN", "BOOL").when(t.rlike(_NUMBER), "NUMERIC").when(t.startswith("OBJECT"), "OBJECT").otherwise("UNKNOWN")

    items = F.try_variant_get(v, "$", "array<variant>")
    return F.when(F.schema_of_variant(v).startswith("ARRAY"), F.concat(F.lit("["), F.coalesce(scalar(F.get(items, 0)), F.lit("UNKNOWN")), F.lit("]"))).otherwise(F.coalesce(scalar(v), F.lit("UNKNOWN")))


def _typed_kind(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return f"[{_typed_kind(t.elementType)}]"
    if isinstance(t, T.NumericType):
        return "NUMERIC"
    if isinstance(t, T.BooleanType):
        return "BOOL"
    if isinstance(t, (T.StructType, T.MapType)):
        return "OBJECT"
    return "UNKNOWN" if isinstance(t, T.NullType) else "STRING"


def _fields(df: DataFrame, keys: list[str], depth: int = 3) -> DataFrame:
    """(keys, field, type): the first known type of each field path, objects up to the given depth.

    Rows are combined by hash as they are read: flags and numbers allow that, the
    least of texts would sort all rows of a task first.
    """
    kind = df.schema["data"].dataType
    if isinstance(kind, T.VariantType):
        out = None
        level = df.select(*keys, F.lit("").alias("at"), F.col("data").alias("v"))
        for _ in range(depth):
            pairs = level.select(*keys, "at", F.explode(F.try_variant_get("v", "$", "map<string,variant>")).alias("k", "v"))
            level = pairs.select(*keys, F.concat("at", F.when(F.col("at") != "", ".").otherwise(""), "k").alias("at"), "v")
            got = level.select(*keys, F.col("at").alias("field"), _kind(F.col("v")).alias("type"))
            out = got if out is None else out.unionByName(got)
            level = level.where(F.schema_of_variant("v").startswith("OBJECT"))
        types = F.array(*[F.lit(t) for t in _TYPES])
        first = out.groupBy(*keys, "field").agg(F.min(F.array_position(types, F.col("type"))).alias("first"))
        return first.select(*keys, "field", F.get(types, (F.col("first") - 1).cast("int")).alias("type"))

    def walk(t: T.StructType, col: Column, at: str):
        for f in t.fields:
            c = col.getField(f.name)
            yield at + f.name, _typed_kind(f.dataType), c.isNotNull()
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, c, at + f.name + ".")

    entries = list(walk(kind, F.col("data"), ""))
    if not entries:
        return df.select(*keys, F.lit("").alias("field"), F.lit("").alias("type")).where("false")
    entries.sort(key=lambda x: x[:2])
    there = df.groupBy(*keys).agg(*[F.max(held).alias(f"__f{i}") for i, (_, _, held) in enumerate(entries)])
    # a name with a dot may be the path of another field
    paths: dict[str, list[Column]] = {}
    for i, (name, t, _) in enumerate(entries):
        paths.setdefault(name, []).append(F.when(F.col(f"__f{i}"), F.struct(F.lit(name).alias("field"), F.lit(t).alias("type"))))
    found = F.array(*[F.coalesce(*same) for same in paths.values()])
    return there.select(*keys, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*keys, "f.field", "f.type")


def _some(df: DataFrame, keys: list[str], n: int | None) -> DataFrame:
    """n rows of each key, chosen by a hash of gid; all rows if n is None."""
    if n is None:
        return df
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("gid"), "gid"))
    return df.withColumn("__n", nth).where(F.col("__n") <= n).drop("__n")


def vertex_schema(graph: "PropertyGraph", n: int | None = None) -> DataFrame:
    """(label, field, type) of the vertices."""
    return _fields(_some(graph.vertices, ["label"], n), ["label"])


def edge_schema(graph: "PropertyGraph", n: int | None = None) -> DataFrame:
    """(from, label, to, field, type) of the edges, by the labels at both ends; edges without data have one row with a null field."""
    v = graph.vertices
    e = graph.edges.withColumnsRenamed({"from": "f", "to": "t"})
    e = e.join(v.select(F.col("gid").alias("f"), F.col("label").alias("from")), "f").join(v.select(F.col("gid").alias("t"), F.col("label").alias("to")), "t")
    keys = ["from", "label", "to"]
    e = _some(e.select("gid", *keys, "data"), keys, n)
    return e.select(*keys).distinct().join(_fields(e, keys), keys, "left")
