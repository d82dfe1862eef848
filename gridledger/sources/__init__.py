"""Readers and writers: register exports, snapshots, dimensions, payloads, logs."""
