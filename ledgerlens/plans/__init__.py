"""Plan helpers and the query catalog."""
