"""DataFrame operators over flat and nested tables."""
