"""Recurrent runs as streams."""
