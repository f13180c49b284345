"""Text analytics as Spark plans."""
