"""Results to files."""
