"""Record datasets on Spark: scan, page, search, navigate JSON, export, catalogue."""

from rowlantern.sources import catalog, format_of, open_dataset

__all__ = ["catalog", "format_of", "open_dataset"]
