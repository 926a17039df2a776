from rowlantern.sources.catalog import catalog
from rowlantern.sources.csv_files import read_csv, read_standard_csv
from rowlantern.sources.json_files import read_json
from rowlantern.sources.jsonl_files import read_jsonl
from rowlantern.sources.open import format_of, open_dataset
from rowlantern.sources.parquet_files import as_records, read_parquet, read_parquet_rows

__all__ = ["as_records", "catalog", "format_of", "open_dataset", "read_csv", "read_json", "read_jsonl",
           "read_parquet", "read_standard_csv", "read_parquet_rows"]
