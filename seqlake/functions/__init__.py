"""Column functions: numbers, qualities, comments, read groups, CIGARs and tags, low complexity."""
