"""Readers and writers for the binary and text formats."""
