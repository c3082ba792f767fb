"""DataFrame operators of rubric-based judging."""
