"""Relational operators of the model: evidence, decoding, evaluation, validation, replay order."""
