"""sheetseam: stitch map-sheet-split vector layers back into seamless layers on Spark.

Layers are DataFrames with a feature key, attributes and a columnar geometry
struct (see :mod:`sheetseam.schemas`).  Candidate pairs come from equi-joins on
sheet-boundary faces, groups from iterative label propagation, merged geometry
from edge cancellation / endpoint-degree tests, all as DataFrame plans.
"""

from sheetseam.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
