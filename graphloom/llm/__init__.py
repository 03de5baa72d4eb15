"""Operators for building training corpora, one module each; ``registry`` holds their queries."""
