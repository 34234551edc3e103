"""Landed payloads and logs as typed rows."""
