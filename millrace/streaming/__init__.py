"""The text aggregations over streams."""

from millrace.streaming.aggregate import start, stream_lines, stream_pair_stats, stream_word_count

__all__ = ["start", "stream_lines", "stream_pair_stats", "stream_word_count"]
