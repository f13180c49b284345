"""plans of textlake."""
