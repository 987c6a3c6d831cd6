"""Operators that prepare text, vectors and web captures for model training."""
