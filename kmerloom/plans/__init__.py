"""The graph model and what keeps long plans short."""
