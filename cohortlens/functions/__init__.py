"""Column functions: codes, demographics, statistics and note text."""
