"""Scoring of responses as they arrive (an extension)."""
