"""streaming of textlake."""
