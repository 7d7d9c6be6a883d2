"""Learners and scorers on Structured Streaming."""
