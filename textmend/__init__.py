"""textmend: a Spark-first engine for auditing and repairing document corpora."""
