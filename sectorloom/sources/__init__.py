"""Container sources and sinks."""
