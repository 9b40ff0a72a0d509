"""Operators that prepare texts, vectors and web pages for training language models."""
