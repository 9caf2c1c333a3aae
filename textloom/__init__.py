"""Corpus analytics as DataFrame operators."""
