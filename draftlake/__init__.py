"""Document and drawing analytics as Spark plans."""
