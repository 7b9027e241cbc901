"""Stored forms: segments, snapshots, logs and generated vectors."""
