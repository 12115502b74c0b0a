"""Verification engine: streaming."""
