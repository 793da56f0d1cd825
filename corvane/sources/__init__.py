"""Readers and writers: directory scans, line ranges, versioned table snapshots."""
