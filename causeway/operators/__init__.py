"""Relational operators over documents, passages and causal edges."""
