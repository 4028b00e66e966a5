"""Readers, the finding manifest and sinks."""
