"""Whole jobs: preparation, evaluation, staged refinement."""
