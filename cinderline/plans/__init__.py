"""Report plans and the query catalog."""
