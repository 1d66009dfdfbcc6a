"""Incremental versions of the mergeable operators."""
