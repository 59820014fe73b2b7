"""Corpus operators for preparing training data; see the README's table of methods."""
