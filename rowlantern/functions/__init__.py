from rowlantern.functions.json_text import kind_of_text, path_label, text_at, value_preview
from rowlantern.functions.render import cut, row_line, row_object
from rowlantern.functions.search_text import matches, needles, occurrences

__all__ = ["cut", "kind_of_text", "matches", "needles", "occurrences", "path_label", "row_line",
           "row_object", "text_at", "value_preview"]
