"""Continuous forms: listings until sold or given up, windows, deduplication, positions."""
