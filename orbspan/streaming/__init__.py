from .cover import cover_stream, late_counts

__all__ = ["cover_stream", "late_counts"]
