"""Structured Streaming: notices are flagged as they arrive."""
