"""Streams of run events: changes, stalls, bounded batches."""
