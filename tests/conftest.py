import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sheetseam.schemas import GEOMETRY  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sheetseam.session import get_spark

    s = get_spark("local[4]", 8, app="sheetseam-tests", driver_memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rect(w, s, e, n):
    ring = [(w, s), (e, s), (e, n), (w, n), (w, s)]
    return ("POLYGON", [[[{"x": float(x), "y": float(y)} for x, y in ring]]])


def poly(*rings):
    return ("POLYGON", [[[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]])


def line(*pts):
    return ("LINESTRING", [[[{"x": float(x), "y": float(y)} for x, y in pts]]])


LAYER_DDL = "ogc_fid long, ufid long, kind string, cls string, geom " + GEOMETRY.simpleString()


def make_layer(spark, rows):
    """rows: (ufid, kind, cls, geom)"""
    return spark.createDataFrame([(u, u, k, c, g) for u, k, c, g in rows], LAYER_DDL)
