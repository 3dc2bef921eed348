"""Whole jobs: the weekly load, the recommender, and the registered queries."""
