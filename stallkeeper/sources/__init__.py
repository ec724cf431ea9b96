"""Readers: paged listing feeds, nested book snapshots, item bytes."""
