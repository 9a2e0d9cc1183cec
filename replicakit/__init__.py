"""replicakit: keep a replica of a table in step with its source, cut over to
it, and prove that both sides agree, as Spark DataFrame and Structured
Streaming jobs."""

__version__ = "0.1.0"
