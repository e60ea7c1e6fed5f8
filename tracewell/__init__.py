"""Query-audit analytics on Spark: trace events in, attributed statements out."""

__version__ = "0.1.0"
