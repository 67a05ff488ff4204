"""Stand-in tables, whole-study plans and the query catalogue."""
