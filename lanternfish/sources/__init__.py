"""Readers: tables, files, archive indexes, seeded carriers."""
