"""findling: document search and data-preparation operators on Spark DataFrames."""

__version__ = "0.1.0"
