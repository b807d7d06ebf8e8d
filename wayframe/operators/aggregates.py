"""Named aggregations over travelers, as rows (name, key, value)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..functions.conditions import number
from ..functions.paths import Value
from .loops import cut

#: Exact percentiles look for a value this share of all values below and above it, twice what approximate ones of this accuracy err.
NEAR, ACCURACY = 2e-3, 1000


def group_key(v: Value) -> Column:
    """Something to group by that tells apart what strict equality does."""
    if v.variant:
        n = F.when(F.schema_of_variant(v.col).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"), F.try_variant_get(v.col, "$", "double"))
        return F.struct(n.alias("n"), F.when(n.isNull(), F.to_json(v.col)).alias("s"))
    return F.to_json(F.struct(v.col)) if isinstance(v.kind, T.MapType) else v.col


def type_name(v: Value) -> Column:
    """NUMERIC, STRING, BOOL or UNKNOWN (also for what is null or missing)."""
    unknown = F.lit("UNKNOWN")
    if v.col is None:
        return unknown
    if v.variant:
        t = F.schema_of_variant(v.col)
        return F.coalesce(F.when(t == "STRING", "STRING").when(t == "BOOLEAN", "BOOL").when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|TINYINT|SMALLINT)"), "NUMERIC"), unknown)
    name = "NUMERIC" if isinstance(v.kind, T.NumericType) else "BOOL" if isinstance(v.kind, T.BooleanType) else "STRING" if isinstance(v.kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) else "UNKNOWN"
    return F.when(v.col.isNotNull(), F.lit(name)).otherwise(unknown)


def _scalar_text(v: Value) -> Column:
    """A scalar as text; null for null, arrays and objects."""
    if v.col is None or isinstance(v.kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.lit(None).cast("string")
    if v.variant:
        t = F.schema_of_variant(v.col)
        return F.when(~t.rlike("^(ARRAY|OBJECT|VOID)"), F.try_variant_get(v.col, "$", "string"))
    return v.col.cast("string")


def _keys(v: Value) -> Column:
    if v.variant:
        return F.map_keys(F.try_variant_get(v.col, "$", "map<string,variant>"))
    if isinstance(v.kind, T.MapType):
        return F.map_keys(v.col)
    if isinstance(v.kind, T.StructType):
        return F.filter(F.array(*[F.when(v.col.getField(n).isNotNull(), F.lit(n)) for n in v.kind.names]), lambda x: x.isNotNull())
    return F.lit(None).cast("array<string>")


def _percentiles(values: DataFrame, shares: list[float]) -> DataFrame:
    """One row with the array q, the exact percentiles of column x; no row if there are no values.

    Approximate percentiles a little below and above each one part the values.
    The parts are counted, and only of those that hold a wanted rank the values
    are counted one by one and ranked, so no task gets all values.  The bounds
    decide how much is ranked, not what comes out.
    """
    near = sorted({min(max(s + d, 0.0), 1.0) for s in shares for d in (-NEAR, NEAR)})
    bounds = values.agg(F.percentile_approx("x", F.array(*[F.lit(s) for s in near]), ACCURACY).alias("bounds"))
    above = [F.coalesce(F.col("x") > F.col("bounds")[i], F.lit(False)).cast("int") for i in range(len(near))]
    placed = values.crossJoin(F.broadcast(bounds)).select(reduce(Column.__add__, above).alias("part"), "x")

    at = [(F.col("total") - 1) * F.lit(s) for s in shares]
    size = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + p["n"])
    sizes = placed.groupBy("part").agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"))
    starts = sizes.select("parts", size(F.col("parts")).alias("total"), F.posexplode("parts").alias("i", "p")).select("p.*", "total", size(F.slice("parts", 1, F.col("i"))).alias("start"))
    holds = reduce(Column.__or__, [(F.col("start") <= r) & (r < F.col("start") + F.col("n")) for x in at for r in (F.floor(x), F.ceil(x))])
    few = placed.join(F.broadcast(starts.where(holds).select("part", "start", "total")), "part").groupBy("part", "start", "total", "x").agg(F.count("*").alias("n"))

    upto = F.sum("n").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = few.select("x", "n", "total", (F.col("start") + upto).alias("stop"))
    one = lambda r: F.max(F.when((r < F.col("stop")) & (r >= F.col("stop") - F.col("n")), F.col("x")))
    found = ranked.agg(F.max("total").alias("total"), *[one(f(x)).alias(f"{w}{i}") for i, x in enumerate(at) for w, f in (("lo", F.floor), ("hi", F.ceil))])
    between = [F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}")).otherwise((F.ceil(x) - x) * F.col(f"lo{i}") + (x - F.floor(x)) * F.col(f"hi{i}")) for i, x in enumerate(at)]
    return found.where("total is not null").select(F.array(*between).alias("q"))


def aggregate(df: DataFrame, aggs: list[dict], lookup: Callable[[str], Value], steady: bool = True) -> DataFrame:
    """All aggregations in one pass: a traveler becomes one small row for each, and these are grouped once.

    Percentiles alone are aggregated on their own, exactly by default.  That reads
    df more than once; steady: whether it then has the same travelers each time,
    else their values are written to the shared folder first.
    """
    items: list[Column] = []
    hist: dict[str, float] = {}
    sizes: dict[str, int] = {}
    parts: list[DataFrame] = []

    for a in aggs:
        name = a["name"]
        kinds = [k for k in a if k != "name"]
        if len(kinds) != 1:
            raise PlanError(f"aggregation {name} has no single kind")
        kind, body = kinds[0], a[kinds[0]]
        v = lookup(body["field"]) if "field" in body else Value(None, None)
        if kind == "term":
            text = _scalar_text(v)
            items.append(F.array(F.struct(F.lit(name).alias("name"), type_name(v).alias("tag"), text.alias("key"), F.lit(None).cast("double").alias("num"))))
            if body.get("size"):
                sizes[name] = body["size"]
        elif kind == "histogram":
            step = float(body["interval"])
            if step <= 0:
                raise PlanError("a histogram's interval must be positive")
            x = F.floor(number(v) / step) * F.lit(step)
            hist[name] = step
            items.append(F.array(F.struct(F.lit(name).alias("name"), F.lit("").alias("tag"), F.when(x.isNotNull(), "").alias("key"), x.cast("double").alias("num"))))
        elif kind == "field":
            keys = F.coalesce(_keys(v) if v.col is not None else F.lit(None).cast("array<string>"), F.expr("cast(array() as array<string>)"))
            items.append(F.transform(keys, lambda k: F.struct(F.lit(name).alias("name"), F.lit("").alias("tag"), k.alias("key"), F.lit(None).cast("double").alias("num"))))
        elif kind == "type":
            items.append(F.array(F.struct(F.lit(name).alias("name"), F.lit("").alias("tag"), type_name(v).alias("key"), F.lit(None).cast("double").alias("num"))))
        elif kind == "count":
            parts.append(df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), F.lit("count").alias("key"), "value"))
        elif kind == "percentile":
            ps = [float(p) for p in body.get("percents") or (1, 5, 25, 50, 75, 95, 99)]
            if not all(0 <= p <= 100 for p in ps):
                raise PlanError("percentiles go from 0 to 100")
            shares = [p / 100 for p in ps]
            if body.get("approximate"):
                got = df.agg(F.percentile_approx(number(v), F.array(*[F.lit(s) for s in shares]), 10_000).alias("q"))
            else:
                values = df.select(number(v).alias("x")).where("x is not null")
                got = _percentiles(values if steady else cut(values, "values"), shares)
            pairs = F.arrays_zip(F.array(*[F.lit(_number_text(p)) for p in ps]).alias("key"), F.col("q"))
            rows = got.where("q is not null").select(F.explode(pairs).alias("p"))
            parts.append(rows.select(F.lit(name).alias("name"), F.col("p.key").alias("key"), F.col("p.q").cast("double").alias("value")))
        else:
            raise PlanError(f"no aggregation is named {kind}")
    if items:
        flat = df.select(F.explode(F.concat(*items)).alias("i")).select("i.*").where("key is not null")
        grouped = flat.groupBy("name", "tag", "key", "num").agg(F.count("*").cast("double").alias("value"))
        plain = [n for n in {a["name"] for a in aggs} if n not in hist]
        if plain and len(plain) > sum("percentile" in a or "count" in a for a in aggs):
            terms = grouped.where(~F.col("name").isin(list(hist))) if hist else grouped
            if sizes:
                cap = F.create_map(*[x for n, s in sizes.items() for x in (F.lit(n), F.lit(s))])[F.col("name")]
                nth = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("value"), "key"))
                terms = terms.withColumn("nth", nth).where(cap.isNull() | (F.col("nth") <= cap))
            parts.append(terms.select("name", "key", "value"))
        for name, step in hist.items():
            h = grouped.where(F.col("name") == name)
            counts = h.agg(F.map_from_entries(F.collect_list(F.struct("num", "value"))).alias("m"), F.min("num").alias("lo"), F.max("num").alias("hi")).where("lo is not null")
            n = ((F.col("hi") - F.col("lo")) / step).cast("long")
            every = counts.select("m", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.col("lo") + i * F.lit(step))).alias("num"))
            parts.append(every.select(F.lit(name).alias("name"), F.col("num").cast("string").alias("key"), F.coalesce(F.try_element_at("m", "num"), F.lit(0.0)).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def _number_text(p: float) -> str:
    return str(int(p)) if p == int(p) else str(p)
