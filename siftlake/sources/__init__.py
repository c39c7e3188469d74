"""Readers, sinks, file listings and the commit-partitioned table."""
