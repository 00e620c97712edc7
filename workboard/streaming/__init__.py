"""Structured Streaming forms of intake and change application."""
