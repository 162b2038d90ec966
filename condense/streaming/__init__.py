"""Structured Streaming jobs; each equals its batch counterpart."""
