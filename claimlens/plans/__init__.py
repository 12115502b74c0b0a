"""Verification engine: plans."""
