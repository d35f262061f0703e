"""Event catalogue, text and recommendation analytics as Spark DataFrame functions."""
