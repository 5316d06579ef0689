"""Delimited sources and sinks with explicit schemas."""
