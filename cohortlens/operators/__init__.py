"""DataFrame operators of the cluster analysis."""
