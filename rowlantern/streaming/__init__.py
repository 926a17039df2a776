from rowlantern.streaming.search import start_file_search, start_search, stream_hits

__all__ = ["start_file_search", "start_search", "stream_hits"]
