"""millrace: text-corpus and record analytics as Spark plans."""
