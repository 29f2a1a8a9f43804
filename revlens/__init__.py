"""revlens: review analytics expressed as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` (or a small
composition of them) built from Spark SQL expressions, aggregations,
joins and windows, so Catalyst can prune columns, push filters into the
parquet scan and pick the physical strategy.
"""

__version__ = "0.1.0"
