"""Queries over the test tables and independent SQL for each of them."""
