"""sphaera: a Spark-first engine for granular-ball clustering, its evaluation and the data work around it."""

__version__ = "0.1.0"
