"""operators of the timeline library."""
