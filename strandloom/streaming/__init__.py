"""Structured Streaming over FASTA text and running unit frequencies."""
