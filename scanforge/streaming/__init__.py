"""Structured Streaming over arriving spectra."""
