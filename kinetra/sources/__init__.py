"""Readers, writers and audits of reaction evidence."""
