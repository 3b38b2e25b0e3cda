"""Structured Streaming counterparts of the event spotter."""
