"""DataFrame-to-DataFrame operators and trained models."""
