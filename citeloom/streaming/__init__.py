"""Questions that arrive over time, answered against a fixed index."""
