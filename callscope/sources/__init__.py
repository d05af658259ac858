"""Readers of event logs, counters, mount tables, environments and stored samples."""
