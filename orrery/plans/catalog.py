"""Imports every query module, so that the registry is full."""

from orrery.plans import q_eval, q_kg, q_loaders, q_more, q_network, q_overlay, q_ranking, q_rest, q_scores, q_spatial, q_streams, q_temporal, q_windows

FLAGSHIP = "kg_statistics"

__all__ = ["FLAGSHIP", "q_eval", "q_kg", "q_loaders", "q_more", "q_network", "q_overlay", "q_ranking", "q_rest", "q_scores", "q_spatial", "q_streams", "q_temporal", "q_windows"]
