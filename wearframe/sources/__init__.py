"""Readers, sinks and adapters."""
