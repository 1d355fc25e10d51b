"""plans of the timeline library."""
