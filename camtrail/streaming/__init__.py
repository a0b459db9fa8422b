"""Structured Streaming forms of the live-camera operators."""
