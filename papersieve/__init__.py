"""papersieve: literature screening and topic analytics as Spark DataFrame operators."""

__version__ = "0.1.0"
