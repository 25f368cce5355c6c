"""Streaming front-ends of the model."""
