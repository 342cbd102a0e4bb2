"""Fixture views, registered queries and the end-to-end pipeline."""
