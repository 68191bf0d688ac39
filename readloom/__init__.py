"""readloom: read-level analytics and training-data operators, written as Spark plans."""
