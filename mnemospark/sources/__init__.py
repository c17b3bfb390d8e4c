"""Readers, versioned tables and sinks."""
