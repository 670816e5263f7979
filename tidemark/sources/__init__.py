"""Bar sources and sinks."""
