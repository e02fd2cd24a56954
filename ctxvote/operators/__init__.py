"""Relational operators: vocabularies, count models, prediction, types, metrics, datasets."""
