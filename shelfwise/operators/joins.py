"""Joins on explicit keys, fan-out diagnostics and referential integrity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.text import name_col

# Fixed values.
JOIN_TYPES = ("inner", "left", "right", "outer", "full")
MAX_FANOUT_RATIO = 3.0
ORPHAN_SAMPLES = 5


class Relationship(NamedTuple):
    parent: str
    child: str
    parent_key: str
    child_key: str
    expected: str


# The known relationships of commerce tables.
RELATIONSHIPS = (
    Relationship("customers", "orders", "customer_id", "customer_id", "1:N"),
    Relationship("orders", "order_items", "order_id", "order_id", "1:N"),
    Relationship("products", "order_items", "product_id", "product_id", "1:N"),
    Relationship("products", "inventory", "product_id", "product_id", "1:1"),
    Relationship("stores", "orders", "store_id", "store_id", "1:N"),
    Relationship("stores", "inventory", "store_id", "store_id", "1:N"),
)

# Products of two row counts of one key can pass 64 bits.
ROW_COUNT = "decimal(38,0)"


def _require(df: DataFrame, column: str, table: str) -> None:
    if column not in df.columns:
        raise ValueError(f"'{table}' has no column '{column}' to join on")


def key_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    right_name: str = "right",
    left_name: str = "left",
    null_safe: bool = False,
) -> DataFrame:
    """Equi-join on explicit keys.

    Right columns whose name the left side has get the suffix
    ``_<right_name>``; keys of equal name become one column. Null keys do not
    match unless ``null_safe``. No side is forced into a broadcast: the size
    decides, and skewed keys are split at run time. A full join, whose skew
    Spark does not split, is a left join and the right rows without a partner.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type '{how}'")
    _require(left, left_on, left_name)
    _require(right, right_on, right_name)
    same_key = left_on == right_on
    taken = set(left.columns) - ({left_on} if same_key else set())
    renamed = {c: f"{c}_{right_name}" for c in right.columns if c in taken}
    key = "__right_key"  # a second copy: the right key column itself is kept too
    side = right.select(
        name_col(right_on).alias(key),
        *[
            name_col(c).alias(renamed.get(c, c))
            for c in right.columns
            if not (same_key and c == right_on)
        ],
    )

    def match(a, b):
        return a.eqNullSafe(b) if null_safe else a == b

    full = how in ("outer", "full")
    on = match(left[f"`{left_on}`"], F.col(key))
    joined = left.join(side, on, "left" if full else how)
    if full:
        keys = left.select(name_col(left_on).alias("__left_key"))
        alone = side.join(keys, match(F.col(key), F.col("__left_key")), "left_anti")
        joined = joined.unionByName(alone, allowMissingColumns=True)
    if not same_key:
        return joined.drop(key)
    if full or how == "right":
        joined = joined.withColumn(left_on, F.coalesce(name_col(left_on), F.col(key)))
    return joined.drop(key)


def key_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.groupBy(name_col(column).alias("key")).agg(F.count(F.lit(1)).alias(name))


def join_diagnostics(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    max_fanout_ratio: float = MAX_FANOUT_RATIO,
) -> DataFrame:
    """One row: rows on both sides and of the join, fan-out ratio and warning.

    The join itself never runs: each side is counted by key first, so even a
    key with very many rows on both sides is one row here.
    """
    _require(left, left_on, "left")
    _require(right, right_on, "right")
    both = key_counts(left, left_on, "l").join(key_counts(right, right_on, "r"), "key", "full")
    wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(19,0)")
    pairs = wide("l") * wide("r")
    alone_left = F.when(F.col("r").isNull(), wide("l")).otherwise(F.lit(0))
    alone_right = F.when(F.col("l").isNull(), wide("r")).otherwise(F.lit(0))
    joined = {
        "inner": pairs,
        "left": pairs + alone_left,
        "right": pairs + alone_right,
        "outer": pairs + alone_left + alone_right,
        "full": pairs + alone_left + alone_right,
    }[how]
    totals = both.agg(
        F.coalesce(F.sum("l"), F.lit(0)).cast("bigint").alias("rows_left"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("rows_right"),
        F.coalesce(F.sum(joined.cast(ROW_COUNT)), F.lit(0)).cast(ROW_COUNT).alias("rows_joined"),
    )
    base = (
        F.col("rows_left")
        if how in ("inner", "left")
        else F.greatest("rows_left", "rows_right")
    )
    share = F.col("rows_joined").cast("double") / base
    ratio = F.when(base > 0, F.round(share.cast("decimal(38,6)"), 2).cast("double")).otherwise(1.0)
    return totals.withColumn("fanout_ratio", ratio).withColumn(
        "fanout_warning", F.col("fanout_ratio") > max_fanout_ratio
    )


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows with a key no parent has; rows without a key are no orphans."""
    keys = parent.select(name_col(parent_key).alias("__key")).where("__key IS NOT NULL")
    filled = child.where(name_col(child_key).isNotNull())
    return filled.join(keys, child[f"`{child_key}`"] == keys["__key"], "left_anti")


def matched_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    keys = parent.select(name_col(parent_key).alias("__key"))
    return child.join(keys, child[f"`{child_key}`"] == keys["__key"], "left_semi")


def _key_overlap(parent, parent_key, child, child_key) -> DataFrame:
    """(key, p, c): rows per key on both sides, null keys left out."""
    p = key_counts(parent, parent_key, "p").where("key IS NOT NULL")
    c = key_counts(child, child_key, "c").where("key IS NOT NULL")
    return p.join(c, "key", "full")


def referential_integrity(
    parent: DataFrame, parent_key: str, child: DataFrame, child_key: str
) -> DataFrame:
    """One row: distinct keys, orphan keys, orphan rows and up to five samples."""
    _require(parent, parent_key, "parent")
    _require(child, child_key, "child")
    both = _key_overlap(parent, parent_key, child, child_key)
    orphan = F.col("p").isNull()
    counts = both.agg(
        F.count("p").alias("parent_distinct_keys"),
        F.count("c").alias("child_distinct_keys"),
        F.count_if(orphan).alias("orphaned_keys_count"),
        F.coalesce(F.sum(F.when(orphan, F.col("c"))), F.lit(0)).alias("orphaned_child_rows"),
    )
    samples = both.where(orphan).orderBy("key").limit(ORPHAN_SAMPLES)
    # The five samples and the row of counts meet in one tiny aggregate.
    names = counts.columns
    tagged = counts.withColumn("sample", F.lit(None).cast("string")).unionByName(
        samples.select(
            *[F.lit(None).cast("bigint").alias(n) for n in names],
            F.col("key").cast("string").alias("sample"),
        )
    )
    return tagged.agg(
        *[F.max(n).alias(n) for n in names],
        F.sort_array(F.collect_list("sample")).alias("sample_orphaned_keys"),
    )


def relationship_report(
    tables: Mapping[str, DataFrame], relationships: Iterable[Relationship] = RELATIONSHIPS
) -> DataFrame:
    """One row per relationship: key counts, orphans, join size and the observed
    cardinality beside the expected one. Pairs with a missing table are left out."""
    rows = []
    for r in relationships:
        if r.parent not in tables or r.child not in tables:
            continue
        both = _key_overlap(tables[r.parent], r.parent_key, tables[r.child], r.child_key)
        orphan = F.col("p").isNull()
        side = lambda c, many: F.when(F.coalesce(F.max(c), F.lit(0)) > 1, many).otherwise("1")
        product = F.col("p").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
        rows.append(
            both.agg(
                F.count("p").alias("parent_keys"),
                F.count("c").alias("child_keys"),
                F.count_if(orphan).alias("orphaned_keys"),
                F.coalesce(F.sum(F.when(orphan, F.col("c"))), F.lit(0)).alias("orphaned_rows"),
                F.coalesce(F.sum(product.cast(ROW_COUNT)), F.lit(0)).cast(ROW_COUNT).alias("rows_joined"),
                F.concat(side("p", "M"), F.lit(":"), side("c", "N")).alias("observed"),
            ).select(
                F.lit(r.parent).alias("parent"),
                F.lit(r.child).alias("child"),
                F.lit(r.parent_key).alias("parent_key"),
                F.lit(r.child_key).alias("child_key"),
                F.lit(r.expected).alias("expected"),
                "observed",
                "parent_keys",
                "child_keys",
                "orphaned_keys",
                "orphaned_rows",
                "rows_joined",
            )
        )
    if not rows:
        raise ValueError("no relationship has both of its tables")
    return reduce(DataFrame.unionByName, rows)
