"""Millrace: move and shape data between tables, databases and HTTP-style sources on Spark."""

__version__ = "0.1.0"
