"""Rules on tables of records: statuses, labels, lookups, identifiers, orders, sets.

Defined cases of all of them: nulls in a compared column compare as unknown and keep their row
unless said otherwise; ties are broken by the columns named as order; repeated rows are rows of
their own; an empty table gives an empty one (an aggregate without keys gives one row of nulls);
further columns are kept by functions that keep rows and dropped by those that aggregate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions._cols import Num, c

# -- validity -----------------------------------------------------------------------------------


def mask_invalid(rows: DataFrame, layers: list[str], valid: Column) -> DataFrame:
    """The layers null where a row isn't valid; rows stay, so shapes do."""
    return rows.withColumns({k: F.when(valid, F.col(k)) for k in layers})


def reject(rows: DataFrame, out: Column, status: str = "status", detail: str = "detail", bit: int = 2, automatic: int = 1) -> DataFrame:
    """Set a bit of the status of rejected rows and say that an algorithm did; others keep theirs."""
    old = F.coalesce(F.col(detail), F.lit(0)) if detail in rows.columns else F.lit(0)
    return rows.withColumns({status: F.when(out, F.col(status).bitwiseOR(F.lit(bit))).otherwise(F.col(status)), detail: F.when(out, F.lit(automatic)).otherwise(old)})


def translate_status(rows: DataFrame, codes: dict[int, int], status: str = "status", other: int = 0) -> DataFrame:
    """One format's status codes as another's; unknown ones become ``other``."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return rows.withColumn(status, F.coalesce(F.element_at(table, F.col(status).cast("int")), F.lit(other)))


def remove_invalid(rows: DataFrame, layers: list[str]) -> DataFrame:
    """Rows in which every layer has a finite value."""
    bad = lambda k: F.col(k).isNull() | F.isnan(F.col(k).cast("double")) | (F.abs(F.col(k).cast("double")) == float("inf"))
    return rows.filter(~reduce(lambda a, b: a | b, map(bad, layers)))


def keep_between(rows: DataFrame, layer: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose layer lies in [low, high]; a bound of None is open."""
    ok = F.col(layer).isNotNull()
    ok = ok if low is None else ok & (F.col(layer) >= low)
    return rows.filter(ok if high is None else ok & (F.col(layer) <= high))


def linear_layer(rows: DataFrame, layer: str, a: float, b: float) -> DataFrame:
    """The layer as a x + b."""
    return rows.withColumn(layer, F.col(layer) * a + b)


# -- bounds -------------------------------------------------------------------------------------


def bounds(rows: DataFrame, columns: dict[str, str], keys: list[str] = ()) -> DataFrame:
    """Least and greatest of each column under the two names "low high" given for it, and n."""
    aggs = [f(k).alias(name) for k, names in columns.items() for f, name in zip((F.min, F.max), names.split())]
    return rows.groupBy(*keys).agg(*aggs, F.count("*").alias("n"))


def shorter_than(rows: DataFrame, keys: list[str], t: str, span: int, aggs: list[Column]) -> DataFrame:
    """Aggregates of the groups whose times span at most ``span``."""
    g = rows.groupBy(*keys).agg(*aggs, (F.max(t) - F.min(t)).alias("_span"))
    return g.filter(F.col("_span") <= span).drop("_span")


def most_frequent(rows: DataFrame, keys: list[str], aggs: list[Column], n: int | None = None) -> DataFrame:
    """Groups with their count n, the fullest first, of equals by key; ``n`` makes it a report."""
    g = rows.groupBy(*keys).agg(*aggs, F.count("*").alias("n")).orderBy(F.desc("n"), *keys)
    return g if n is None else g.limit(n)


# -- labels and lookups -------------------------------------------------------------------------


def set_where(rows: DataFrame, layer: str, where: Column, value: Num) -> DataFrame:
    """layer = value where the condition holds; unknown keeps the old one."""
    return rows.withColumn(layer, F.when(where, c(value) if isinstance(value, Column) else F.lit(value)).otherwise(F.col(layer)))


def relabel(rows: DataFrame, mapping: dict[str, str], label: str = "cdi") -> DataFrame:
    """Labels renamed by a dictionary; those it doesn't name stay."""
    if not mapping:
        return rows
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return rows.withColumn(label, F.coalesce(F.element_at(table, F.col(label)), F.col(label)))


def label_missing(rows: DataFrame, name: str, where: Column, label: str = "cdi") -> DataFrame:
    """Label the rows without one for which the condition holds."""
    return rows.withColumn(label, F.coalesce(F.col(label), F.when(where, F.lit(name))))


def by_label(rows: DataFrame, label: str = "cdi", count: str = "value_count") -> DataFrame:
    """What a split by label gives: cells and values of each part."""
    return rows.groupBy(label).agg(F.count("*").alias("cells"), F.sum(count).alias("values"))


def look_up(rows: DataFrame, dictionary: DataFrame, on: Column, value: str, name: str, default: str = "") -> DataFrame:
    """rows with the dictionary's value, or the default."""
    return rows.join(dictionary, on, "left").select(*(rows[k] for k in rows.columns), F.coalesce(dictionary[value], F.lit(default)).alias(name))


def bias_to(rows: DataFrame, reference: DataFrame, keys: list[str], value: str, ref: str, name: str = "bias") -> DataFrame:
    """rows with value less the reference cell's; null where there is none."""
    return rows.join(reference.select(*keys, F.col(ref).alias("_ref")), keys, "left").withColumn(name, F.col(value) - F.col("_ref")).drop("_ref")


def best_match(left: DataFrame, right: DataFrame, on: Column, key: str, distance: Column, value: str) -> DataFrame:
    """For each key of left the right row at the least distance, of equals the smallest value."""
    return left.join(right, on).groupBy(key).agg(F.min_by(value, F.struct(distance, value)).alias(value))


def to_list(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """A multi-value dictionary: the sorted values of each key, nulls left out."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables of one row per key under one another by key; where several have a column the greatest
    value stays.  One shuffle however many tables there are."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return u.groupBy(*keys).agg(*(F.max(k).alias(k) for k in u.columns if k not in keys))


def dense_ids(rows: DataFrame, columns: list[str], name: str, cut: Callable[[DataFrame], DataFrame], first: int = 1) -> DataFrame:
    """rows with a dense number of their distinct values of ``columns``, in their order.

    Distinct values are ranged and numbered within each range; the driver only adds up one count a
    range, so no task ranks them all.  ``cut`` writes an intermediate table."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    distinct = cut(rows.select(*columns).distinct().repartitionByRange(n, *columns).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["count"]) for r in distinct.groupBy("_range").count().collect())
    before, at = [], first
    for part, size in sizes:
        before += [F.lit(part), F.lit(at)]
        at += size
    if not before:
        return rows.withColumn(name, F.lit(None).cast("int"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*columns)) - 1
    ids = distinct.withColumn(name, (F.element_at(F.create_map(*before), F.col("_range")) + rank).cast("int")).drop("_range")
    same = reduce(lambda a, b: a & b, (rows[k].eqNullSafe(ids[k]) for k in columns))
    return rows.join(ids, same).select(*(rows[k] for k in rows.columns), ids[name])


# -- sets and orders ----------------------------------------------------------------------------


def together(parts: list[DataFrame], order: list[str] = ()) -> DataFrame:
    """Records of several files under one another, by columns' names, sorted if an order is given."""
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.orderBy(*order) if order else u


def in_both(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of columns that both have; nulls equal nulls."""
    return a.select(*columns).intersect(b.select(*columns))


def not_in(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows of columns that only a has; nulls equal nulls."""
    return a.select(*columns).subtract(b.select(*columns))
