"""Readers, snapshots and other file-backed steps."""
