"""Readers: driver tables, fixture views derived from them, JSON / CSV / text maps."""
