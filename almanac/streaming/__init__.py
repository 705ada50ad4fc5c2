"""Structured Streaming: live segments, distinct messages, and watched folders."""
