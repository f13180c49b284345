"""sources of textlake."""
