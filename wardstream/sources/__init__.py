"""Readers, dataset connectors and sinks."""
