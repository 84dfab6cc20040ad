"""Readers of landed payloads and writers that keep tables up to date."""
