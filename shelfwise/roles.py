"""Finding columns by their role: schema only, no Spark job."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

# Column names by role. The first column in table order wins.
EXACT_NAMES = {
    "revenue": ("total_amount", "revenue", "sales", "total_price", "amount", "total"),
    "category_revenue": ("total_amount", "revenue", "sales", "price"),
    "customer_revenue": ("total_amount", "revenue", "sales", "amount"),
    "status": ("status", "order_status"),
    "stock": ("stock", "stock_level", "quantity", "inventory_level"),
    "units": ("quantity", "units_sold", "qty"),
    "price": ("price", "unit_price"),
    "cost": ("cost", "unit_cost"),
}
NAME_PARTS = {
    "category": ("category",),
    "brand": ("brand",),
    "sku": ("sku",),
    "customer": ("customer",),
    "date": ("date", "time", "created_at", "updated_at", "timestamp", "day"),
    "issue_date": ("date", "time", "created_at", "timestamp"),
    "currency": ("price", "cost", "revenue", "amount", "sales", "discount", "margin", "total", "tax"),
    "category_like": ("category", "type", "department", "segment", "region", "status"),
}
NAME_ENDINGS = {"identifier": ("_id", "id", "sku", "code")}
KEY_COLUMNS = {
    "order": ("order_id",),
    "product": ("product_id", "sku"),
    "customer": ("customer_id",),
}
ITEM_KEY = ("order_id", "product_id")


def has_role(column: str, role: str) -> bool:
    name = column.lower()
    if role in EXACT_NAMES:
        return name in EXACT_NAMES[role]
    if role in NAME_ENDINGS:
        return name.endswith(NAME_ENDINGS[role])
    return any(part in name for part in NAME_PARTS[role])


def resolve_role(
    columns: Iterable[str], role: str, overrides: Mapping[str, str] | None = None
) -> str | None:
    if overrides and role in overrides:
        return overrides[role]
    return next((c for c in columns if has_role(c, role)), None)


def require_role(
    columns: Iterable[str], role: str, overrides: Mapping[str, str] | None = None
) -> str:
    columns = list(columns)
    found = resolve_role(columns, role, overrides)
    if found is None or found not in columns:
        raise ValueError(f"no column for role '{role}' among {columns}")
    return found


def base_name(table: str) -> str:
    return table.lower().replace("_raw", "").replace("_clean", "")


def key_columns(
    table: str, columns: Iterable[str], keys: Mapping[str, tuple[str, ...]] | None = None
) -> list[tuple[str, ...]]:
    """The keys a table is checked against; none is guessed for an unknown table.

    ``keys`` maps a table name to its own key. Order lines are keyed by order
    and product, so that they are never collapsed to one row per order.
    """
    name = base_name(table)
    by_lower = {c.lower(): c for c in columns}
    if keys and name in keys:
        return [tuple(keys[name])]
    if name.startswith(("order_item", "order_line")):
        return [tuple(by_lower[k] for k in ITEM_KEY)] if set(ITEM_KEY) <= set(by_lower) else []
    for prefix, candidates in KEY_COLUMNS.items():
        if name.startswith(prefix):
            return [(by_lower[k],) for k in candidates if k in by_lower]
    return []
