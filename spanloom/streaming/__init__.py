"""streaming of the timeline library."""
