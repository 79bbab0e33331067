"""Retrieval and verification plans over the operators."""
