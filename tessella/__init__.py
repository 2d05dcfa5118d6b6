"""Question-bank analytics on Spark: relational, text, document and state operators as DataFrame functions."""
