"""Column expressions for orders, products and display fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import UNKNOWN_ADDRESS


def norm_order_type(t: Column) -> Column:
    """Upper-case and strip all white space ('Buy Online, ...' -> 'BUYONLINE,...')."""
    return F.regexp_replace(F.upper(t), r"\s+", "")


def shipping_method(t: Column) -> Column:
    """``lower(type)`` contains 'store' -> bopis, else home."""
    return F.when(F.lower(t).contains("store"), F.lit("bopis")).otherwise(F.lit("home"))


def order_address(t: Column, user_address: Column, store_address: Column) -> Column:
    """bopis: store address; home: user address; no method: 'Unknown address'."""
    method = F.when(t.isNull(), F.lit(None)).otherwise(shipping_method(t))
    return (F.when(method == "bopis", store_address)
             .when(method == "home", user_address)
             .otherwise(F.lit(UNKNOWN_ADDRESS)))


def epoch_ms_to_ts(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def pretty_date(ts: Column) -> Column:
    """'Jan 1, 2000 at 12:00:00 AM' (session time zone)."""
    return F.date_format(ts, "MMM d, yyyy 'at' h:mm:ss a")


def embedding_text(*fields: Column) -> Column:
    """Fields joined by one blank; missing fields are skipped."""
    if not fields:
        fields = tuple(F.col(c) for c in ("name", "description", "brand",
                                          "articleType", "subCategory"))
    return F.concat_ws(" ", *fields)


def filter_array(arr: Column) -> Column:
    """Drop null and '' elements."""
    return F.filter(arr, lambda x: x.isNotNull() & (x != F.lit("")))


def concat_history(old: Column, new: Column) -> Column:
    """old ++ new, a missing side counting as empty."""
    empty = F.array().cast("array<string>")
    return F.concat(F.coalesce(old, empty), F.coalesce(new, empty))


def price_label(amount: Column) -> Column:
    """'$' + amount as JavaScript prints a number (an integral value has no
    decimal part: 900 -> '$900', 12.5 -> '$12.5')."""
    whole = amount == F.floor(amount)
    text = F.when(whole, amount.cast("long").cast("string")).otherwise(amount.cast("string"))
    return F.concat(F.lit("$"), text)
