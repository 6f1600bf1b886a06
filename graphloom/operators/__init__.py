"""Relational and serialising operators over relations."""
