"""Pinned parameter sets of the registered queries (FIXTURES.md §3).

Filter lists are parameters, so the value lists below are fixed inputs: the
reference's default selects every option of each list.
"""

from __future__ import annotations

from datetime import date

from pulse.functions.filters import Dim, FilterSpec

# Fixed option lists of the fixture marts (every value of each dimension).
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
DEVICES = ("android", "ios", "web")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
DEFAULT_STATUSES = ("completed", "cancelled")

# P1: events mart, 14 days, the reference default filters (F1), breakdown by city.
P1 = FilterSpec(date(2024, 1, 8), date(2024, 1, 21), cities=SEGMENTS, channels=REGIONS, devices=DEVICES,
                categories=PART_TYPES, statuses=DEFAULT_STATUSES, series_dim=Dim.CITY)
# P1 with a two-value city selection (F2) for the selected-series breakdowns.
P1_F2 = P1.replace(cities=("BUILDING", "MACHINERY"))
# P1, breakdown by first-order category, three categories selected.
P1_CAT = P1.replace(categories=("PROMO", "SMALL", "STANDARD"), series_dim=Dim.CATEGORY)
# P1 with no lists at all (F0): NULL cities are counted.
P1_F0 = FilterSpec(date(2024, 1, 8), date(2024, 1, 21), series_dim=Dim.CITY)
# P2: events mart, 7 days; the MAU month runs past d2.
P2 = P1.replace(date_from=date(2024, 1, 15), date_to=date(2024, 1, 21))
# P3: sales mart, one quarter, no lists.
P3 = FilterSpec(date(1998, 1, 1), date(1998, 3, 31))
# P3 with F3: category and status lists (sales mart categories are regions).
P3_F3 = P3.replace(categories=("AMERICA", "EUROPE", "ASIA"), statuses=("completed",))
# P4: empty range.
P4 = P1.replace(date_from=date(2025, 1, 1), date_to=date(2025, 1, 7))

# Churn mart: as-of date, windows and label horizon (FIXTURES §2.3).
CHURN_AS_OF = date(2000, 1, 1)
CHURN_SHORT_DAYS = 90
CHURN_LONG_DAYS = 365
CHURN_LABEL_DAYS = 180
HIGH_RISK_THRESHOLD = 0.60
