"""Versioned text and source evidence analytics, expressed as Spark plans."""
