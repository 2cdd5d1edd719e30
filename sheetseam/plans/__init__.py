"""End-to-end plans: identify/merge passes, whole-layer stitching, import/process/export."""
