from rowlantern.operators.counting import (
    hits_by, match_spans, occurrence_counts, occurrence_total, row_count)
from rowlantern.operators.jsontree import (
    children, children_page, node_summary, nodes, select_children, subtree, subtree_as_records, subtree_search)
from rowlantern.operators.paging import hits_after, hits_page, next_page, page_at
from rowlantern.operators.profile import approx_top_values, column_filter, json_schema, merged_schema, missing_rate, read_typed, top_values
from rowlantern.operators.record_index import changed_files, dataset_page, index_records, indexed_files, locate, lookup
from rowlantern.operators.records import get_records, json_validity, record_view
from rowlantern.operators.search import search, search_hits, search_page
from rowlantern.operators.select import select_by_ids, subtract_ids, union_ids, whole_dataset_ids
from rowlantern.operators.stopping import first_hits
from rowlantern.operators.token_index import build_index, index_hits, indexed_search, word_counts

__all__ = [
    "approx_top_values", "build_index", "changed_files", "children", "children_page", "column_filter", "dataset_page", "first_hits", "get_records", "hits_after", "hits_by", "hits_page", "index_hits",
    "index_records", "indexed_files", "indexed_search", "json_schema", "json_validity",
    "locate", "lookup", "match_spans", "merged_schema", "missing_rate", "next_page", "node_summary", "nodes", "occurrence_counts", "occurrence_total", "page_at",
    "read_typed", "record_view", "row_count", "search", "search_hits", "search_page", "select_by_ids", "select_children",
    "subtract_ids", "subtree", "subtree_as_records", "subtree_search", "top_values", "union_ids",
    "whole_dataset_ids", "word_counts",
]
