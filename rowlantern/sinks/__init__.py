from rowlantern.sinks.export import CONVERSIONS, export_records, export_subtree

__all__ = ["CONVERSIONS", "export_records", "export_subtree"]
