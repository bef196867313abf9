"""Analytics over ordered session logs, replay runs, benchmarks and corpora on Spark."""

__version__ = "0.1.0"
