"""Relational steps of nested selections: aggregate a relationship before joining it, restrict children to surviving parents, mark rows for
which related rows exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys_equal(left: DataFrame, left_names: list[str], right: DataFrame, right_names: list[str]) -> Column:
    out = None
    for a, b in zip(left_names, right_names, strict=True):
        c = left[a] == right[b]
        out = c if out is None else out & c
    return out


def restrict(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_keys: list[str]) -> DataFrame:
    """Children of the parents that are left; worth it only if parents were filtered or limited."""
    keys = parent.select(*(F.col(k).alias(f"_p{i}") for i, k in enumerate(parent_keys)))
    return child.join(keys, keys_equal(child, child_keys, keys, keys.columns), "left_semi")


def attach_many(parent: DataFrame, parent_keys: list[str], child: DataFrame, child_keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Parents with an array of their children's values, in the order of ``order`` and then of the values; without children it is empty.

    Values that hold maps have no order: theirs is that of their JSON text.
    """
    if "map<" in child.select(value.alias("v")).dtypes[0][1]:
        order, made = [*order, "_text"], F.to_json(F.struct(value.alias("v")))
        child = child.withColumn("_text", made)
        return _attached(parent, parent_keys, child, child_keys, F.struct(*(F.col(k).alias(f"o{i}") for i, k in enumerate(order)), value.alias("v")), name, _by_fields(len(order)))
    sortable = F.struct(*(F.col(k).alias(f"o{i}") for i, k in enumerate(order)), value.alias("v")) if order else F.struct(value.alias("v"))
    return _attached(parent, parent_keys, child, child_keys, sortable, name)


def _by_fields(n: int):
    """Compares structs by their first n fields."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i in range(n - 1, -1, -1):
            x, y = a[f"o{i}"], b[f"o{i}"]
            out = F.when(x.eqNullSafe(y), out).when(x.isNull() | (x < y), -1).otherwise(1)
        return out

    return compare


def _attached(parent: DataFrame, parent_keys: list[str], child: DataFrame, child_keys: list[str], sortable: Column, name: str, compare=None) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(child_keys))]
    grouped = child.groupBy(*(F.col(c).alias(k) for c, k in zip(child_keys, keys, strict=True))).agg(F.array_sort(F.collect_list(sortable), *[compare] * (compare is not None)).alias("_many"))
    grouped = grouped.select(*keys, F.transform("_many", lambda x: x["v"]).alias("_many"))
    joined = parent.join(grouped, keys_equal(parent, parent_keys, grouped, keys), "left")
    return joined.select(*(parent[f"`{c}`"] for c in parent.columns), F.coalesce(F.col("_many"), F.array()).alias(name))


def attach_one(parent: DataFrame, parent_keys: list[str], child: DataFrame, child_keys: list[str], value: Column, name: str) -> DataFrame:
    """Parents with the one child that a unique key leads to, or null."""
    keys = [f"_k{i}" for i in range(len(child_keys))]
    one = child.select(*(F.col(c).alias(k) for c, k in zip(child_keys, keys, strict=True)), value.alias("_one"))
    joined = parent.join(one, keys_equal(parent, parent_keys, one, keys), "left")
    return joined.select(*(parent[f"`{c}`"] for c in parent.columns), F.col("_one").alias(name))


def attach_each(parent: DataFrame, parent_keys: list[str], child: DataFrame, child_keys: list[str]) -> DataFrame:
    """A row with both sides' columns for each child of each parent, but for the keys; parents without children are left out."""
    return parent.join(child, keys_equal(parent, parent_keys, child, child_keys)).drop(*parent_keys, *child_keys)


def mark_exists(parent: DataFrame, parent_keys: list[str], related: DataFrame, related_keys: list[str], name: str) -> DataFrame:
    """Parents with a boolean: whether a related row has their key. Works under ``or`` and ``not`` as well; keys are made distinct, so no row multiplies."""
    keys = [f"_k{i}" for i in range(len(related_keys))]
    found = related.select(*(F.col(c).alias(k) for c, k in zip(related_keys, keys, strict=True))).distinct().withColumn("_found", F.lit(True))
    joined = parent.join(found, keys_equal(parent, parent_keys, found, keys), "left")
    return joined.select(*(parent[f"`{c}`"] for c in parent.columns), F.coalesce(F.col("_found"), F.lit(False)).alias(name))
