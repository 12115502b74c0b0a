"""Verification engine: sources."""
