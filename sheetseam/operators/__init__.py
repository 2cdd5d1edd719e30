"""DataFrame operators of the stitching engine."""
