"""Readers and writers of corpora, vocabularies, models and archives."""
