"""Operators over frames, pairs, segments, maps and scores."""
