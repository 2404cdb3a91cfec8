"""Filter specification: the explicit replacement for the dashboard's params dict.

Rules kept from the source application:

* an empty selection list means "no filter" (the predicate is not emitted at all);
* NULL values never match a non-empty list (``col IN (...)`` is NULL for NULL);
* user filters (city, channel, device) apply to every query; category and status
  filters apply to order queries only, and only where the source query used them.
"""

from __future__ import annotations

import dataclasses
from datetime import date, timedelta
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Dim(str, Enum):
    """Breakdown dimensions and where each one lives."""

    NONE = "none"
    CITY = "city"          # users.city
    CHANNEL = "channel"    # users.acquisition_channel
    DEVICE = "device"      # users.device
    CATEGORY = "category"  # vendors.category
    STATUS = "status"      # orders.order_status

    @property
    def is_user_dim(self) -> bool:
        return self in (Dim.CITY, Dim.CHANNEL, Dim.DEVICE)

    @property
    def is_order_dim(self) -> bool:
        return self in (Dim.CATEGORY, Dim.STATUS)


# Canonical column that carries each dimension in the marts.
USER_DIM_COLUMN = {Dim.CITY: "city", Dim.CHANNEL: "acquisition_channel", Dim.DEVICE: "device"}

# The source application's breakdown/cross-filter labels and their dimensions.
SOURCE_DIM_LABELS = {
    "(ninguno)": Dim.NONE,
    "Ciudad": Dim.CITY,
    "Canal": Dim.CHANNEL,
    "Device": Dim.DEVICE,
    "Categoría (vendor)": Dim.CATEGORY,
    "Categoría": Dim.CATEGORY,
    "Category": Dim.CATEGORY,
    "Order status": Dim.STATUS,
    "Order Status": Dim.STATUS,
}


@dataclasses.dataclass(frozen=True)
class FilterSpec:
    date_from: date
    date_to: date
    cities: tuple[str, ...] = ()
    channels: tuple[str, ...] = ()
    devices: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    series_dim: Dim = Dim.NONE
    show_total_series: bool = True

    def __post_init__(self):
        for name in ("cities", "channels", "devices", "categories", "statuses"):
            v = getattr(self, name)
            object.__setattr__(self, name, tuple(v or ()))
        object.__setattr__(self, "series_dim", Dim(self.series_dim))
        if self.date_to < self.date_from:
            raise ValueError("date_to precedes date_from")

    @classmethod
    def from_params(cls, params: dict) -> "FilterSpec":
        """Build from the source application's params dict (date_from, date_to, cities,
        channels, devices, categories, statuses, series_dim label, show_total_series)."""
        label = params.get("series_dim", "(ninguno)")
        dim = SOURCE_DIM_LABELS.get(label, Dim(label) if label in {d.value for d in Dim} else Dim.NONE)
        return cls(params["date_from"], params["date_to"],
                   cities=params.get("cities") or (), channels=params.get("channels") or (),
                   devices=params.get("devices") or (), categories=params.get("categories") or (),
                   statuses=params.get("statuses") or (), series_dim=dim,
                   show_total_series=bool(params.get("show_total_series", True)))

    # ---- dates -------------------------------------------------------------------------------
    @property
    def days(self) -> int:
        return (self.date_to - self.date_from).days + 1

    def previous_window(self) -> tuple[date, date]:
        """Window of the same length that ends the day before ``date_from``."""
        prev_to = self.date_from - timedelta(days=1)
        return prev_to - timedelta(days=self.days - 1), prev_to

    def with_dates(self, date_from: date, date_to: date) -> "FilterSpec":
        return dataclasses.replace(self, date_from=date_from, date_to=date_to)

    def replace(self, **kw) -> "FilterSpec":
        return dataclasses.replace(self, **kw)

    # ---- predicates --------------------------------------------------------------------------
    def user_predicate(self, city="city", channel="acquisition_channel", device="device") -> Column | None:
        """AND of the non-empty user lists; ``None`` when no list is set.

        A column name given as ``None`` (absent in the input) drops that filter,
        which is how the schema-resolving queries degrade.
        """
        parts = []
        for col, vals in ((city, self.cities), (channel, self.channels), (device, self.devices)):
            if vals and col is not None:
                parts.append(F.col(col).isin(list(vals)))
        return _and(parts)

    def order_predicate(self, category="category", status="order_status") -> Column | None:
        parts = []
        if self.categories and category is not None:
            parts.append(F.col(category).isin(list(self.categories)))
        if self.statuses and status is not None:
            parts.append(F.col(status).isin(list(self.statuses)))
        return _and(parts)

    def series_values(self) -> tuple[Dim, tuple[str, ...]]:
        """(dimension, selected values) of the breakdown: the filter list of that dimension."""
        d = self.series_dim
        vals = {
            Dim.CITY: self.cities,
            Dim.CHANNEL: self.channels,
            Dim.DEVICE: self.devices,
            Dim.CATEGORY: self.categories,
            Dim.STATUS: self.statuses,
        }.get(d, ())
        return (d, vals) if d is not Dim.NONE else (Dim.NONE, ())

    def cross_filter(self, dim: Dim, chosen: list[str] | tuple[str, ...]) -> "FilterSpec":
        """Intersect one dimension's list with chosen values (chosen-values order kept).

        An empty current list takes the chosen values; an empty intersection
        removes the filter (empty list = no filter).
        """
        dim = Dim(dim)
        if dim is Dim.NONE or not chosen:
            return self
        field = {
            Dim.CITY: "cities",
            Dim.CHANNEL: "channels",
            Dim.DEVICE: "devices",
            Dim.CATEGORY: "categories",
            Dim.STATUS: "statuses",
        }[dim]
        current = getattr(self, field)
        if not current:
            new = tuple(chosen)
        else:
            keep = set(current)
            new = tuple(x for x in chosen if x in keep)
        return dataclasses.replace(self, **{field: new})


def _and(parts: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, parts) if parts else None


def where(df, pred: Column | None):
    """Apply an optional predicate."""
    return df if pred is None else df.filter(pred)


def filter_in(df, selections: dict):
    """Row filter on a table: ``col IN (values)`` for each column that exists and whose
    list is non-empty (empty list or missing column = no filter)."""
    parts = [F.col(c).isin(list(v)) for c, v in selections.items() if v and c in df.columns]
    return where(df, _and(parts))
