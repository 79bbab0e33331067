"""Adapters that give the corpus and relational tables span semantics."""
