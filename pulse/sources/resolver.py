"""Schema discovery: existence probes and ordered candidate column lists.

The operations and top-10 queries of the source application probe the catalog for
their columns and degrade when one is missing.  Here the probes are plain Python
over ``df.columns`` at plan-build time (no catalog round trips), and the result is
a :class:`ResolvedOrders` frame with canonical column names.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulse.functions.dates import day, day_range
from pulse.functions.filters import FilterSpec, where

# The column names a role may have in each table, first existing one wins.
CANDIDATES = {
    "orders": {
        "at": ["created_at", "order_created_at", "order_date", "date", "day"],
        "status": ["status", "order_status", "state", "order_state"],
        "user": ["user_id", "customer_id", "uid"],
        "vendor": ["vendor_id", "store_id", "merchant_id"],
        "total": ["order_total", "gmv", "total", "amount", "order_amount", "subtotal"],
    },
    "users": {
        "user": ["user_id", "id"],
        "city": ["city", "ciudad"],
        "channel": ["acquisition_channel", "channel", "canal"],
        "device": ["device", "platform"],
    },
    "vendors": {
        "vendor": ["vendor_id", "id"],
        "category": ["category", "categoria"],
    },
}
#: Roles without which a table is of no use, and the types of those that may be missing.
KEYS = {"orders": ("at", "user"), "users": ("user",), "vendors": ("vendor", "category")}
MISSING = {"total": "decimal(18,2)", "vendor": "bigint"}


def has_col(df: DataFrame | None, col: str) -> bool:
    return df is not None and col in df.columns


def pick_existing_col(df: DataFrame | None, candidates: list[str]) -> str | None:
    """First candidate, in list order, that exists in ``df``; else None."""
    if df is None:
        return None
    cols = set(df.columns)
    return next((c for c in candidates if c in cols), None)


def table_exists(tables: dict[str, DataFrame | None], name: str) -> bool:
    return tables.get(name) is not None


def table_has_columns(df: DataFrame | None, required: list[str]) -> bool:
    return df is not None and set(required) <= set(df.columns)


def catalog_frame(spark, tables: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """Metadata frame (table_schema, table_name, column_name) of named DataFrames."""
    rows = [(s, t, c) for (s, t), df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string")


def find_table_by_columns(meta: DataFrame, table_hints: list[str], required: list[str],
                          schema_priority: tuple[str, ...] = ("mp", "public")) -> DataFrame:
    """One row (table_schema, table_name): a table that has every required column.

    Hinted names first (in hint order), then any table; schemas ordered mp, public,
    then others.  Empty result = not found (the caller raises).
    """
    req = list(dict.fromkeys(required))
    having = (meta.filter(F.col("column_name").isin(req))
              .groupBy("table_schema", "table_name")
              .agg(F.countDistinct("column_name").alias("n"))
              .filter(F.col("n") == len(req)))
    hint_rank = F.lit(len(table_hints))
    for i, h in reversed(list(enumerate(table_hints))):
        hint_rank = F.when(F.col("table_name") == h, F.lit(i)).otherwise(hint_rank)
    schema_rank = F.lit(len(schema_priority))
    for i, s in reversed(list(enumerate(schema_priority))):
        schema_rank = F.when(F.col("table_schema") == s, F.lit(i)).otherwise(schema_rank)
    return (having.withColumn("_hint", hint_rank).withColumn("_schema", schema_rank)
            .orderBy("_hint", "_schema", "table_schema", "table_name")
            .select("table_schema", "table_name").limit(1))


@dataclasses.dataclass(frozen=True)
class ResolvedOrders:
    """Joined orders x users (inner) [x vendors (left)], canonical columns.

    ``frame`` columns: day, status (NULL when absent), total (NULL when absent), city,
    channel, device (NULL when absent), category (NULL without vendors).  ``ok`` is
    False when a key column is missing: the caller returns an empty typed result.
    """
    frame: DataFrame | None
    has_status: bool
    has_total: bool
    has_vendor_category: bool
    has_city: bool
    has_channel: bool
    has_device: bool

    @property
    def ok(self) -> bool:
        return self.frame is not None


def by_role(df: DataFrame | None, table: str) -> tuple[DataFrame | None, set[str]]:
    """The live rows of ``df`` with its roles as columns ``<table>_<role>`` (NULL if missing), and the roles found.

    None when the table or one of its key roles is missing.
    """
    roles = {role: pick_existing_col(df, names) for role, names in CANDIDATES[table].items()}
    found = {role for role, col in roles.items() if col is not None}
    if not set(KEYS[table]) <= found:
        return None, set()
    if "deleted_at" in df.columns:
        df = df.filter(F.col("deleted_at").isNull())
    cols = [F.col(col) if col else F.lit(None).cast(MISSING.get(role, "string")) for role, col in roles.items()]
    return df.select(*[c.alias(f"{table}_{role}") for role, c in zip(roles, cols, strict=True)]), found


def resolve_orders(users: DataFrame, orders: DataFrame, vendors: DataFrame | None, spec: FilterSpec) -> ResolvedOrders:
    """Apply the resolver rules and the list filters (no status filter: callers decide)."""
    (o, in_orders), (u, in_users) = by_role(orders, "orders"), by_role(users, "users")
    if o is None or u is None:
        return ResolvedOrders(None, False, False, False, False, False, False)
    lists = {role: f"users_{role}" if role in in_users else None for role in ("city", "channel", "device")}
    rows = (day_range(o, "orders_at", spec.date_from, spec.date_to)
            .join(where(u, spec.user_predicate(*lists.values())), F.col("orders_user") == F.col("users_user")))
    v, in_vendors = by_role(vendors, "vendors") if "vendor" in in_orders else (None, set())
    if v is None:
        rows = rows.withColumn("category", F.lit(None).cast("string"))
    else:
        rows = (rows.join(v, F.col("orders_vendor") == F.col("vendors_vendor"), "left")
                .withColumn("category", F.col("vendors_category").cast("string")))
        if spec.categories:
            rows = rows.filter(F.col("category").isin(list(spec.categories)))
    frame = rows.select(
        day("orders_at").alias("day"), F.col("orders_status").alias("status"),
        F.col("orders_total").cast("decimal(18,2)").alias("total"), *[F.col(f"users_{r}").alias(r) for r in lists], "category")
    return ResolvedOrders(frame, "status" in in_orders, "total" in in_orders, bool(in_vendors),
                          *[role in in_users for role in lists])
