"""Readers: tables, databases, HTTP-style APIs, files, the catalog."""
