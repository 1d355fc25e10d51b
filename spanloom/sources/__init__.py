"""sources of the timeline library."""
