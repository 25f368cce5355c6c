"""Text sources and sinks, and reads derived from event tables."""
