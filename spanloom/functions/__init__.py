"""functions of the timeline library."""
