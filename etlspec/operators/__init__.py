"""Table operators and transforms."""
