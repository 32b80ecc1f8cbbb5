"""Where samples come from: stored series and samples, or any table read as time series."""

from .store import SeriesStore, StoreSource
from .tables import TableSource, events_source, orders_source

__all__ = ["SeriesStore", "StoreSource", "TableSource", "events_source", "orders_source"]
