"""deadwire: find JSON payload fields that one side of a web API sends and the
other side never reads, across a whole corpus of repositories, on Spark."""

__version__ = "0.1.0"
