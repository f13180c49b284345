"""functions of textlake."""
