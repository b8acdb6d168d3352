"""Operators for building training corpora: tokenising, de-duplication, filtering, mixing, search and scoring."""
