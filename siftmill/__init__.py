"""siftmill: rule evaluation over text corpora and analytics over its findings, on Spark."""

__version__ = "0.1.0"
