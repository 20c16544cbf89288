"""Structured Streaming versions of the recent-window watch."""
