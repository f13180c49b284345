"""operators of textlake."""
