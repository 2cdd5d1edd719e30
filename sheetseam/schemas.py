"""Types shared by every module.

Geometry is a plain struct so Parquet can prune and Catalyst can see inside it::

    geom: struct<gtype: string,
                 parts: array<array<array<struct<x: double, y: double>>>>>

``parts`` is part -> ring/path -> vertex.  A LINESTRING is one part with one
path, a POLYGON one part whose first ring is the shell, MULTI forms have
several parts.  The EPSG code travels as column metadata (``srid``).
"""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
PATH = T.ArrayType(POINT)
PART = T.ArrayType(PATH)
PARTS = T.ArrayType(PART)
GEOMETRY = T.StructType([T.StructField("gtype", T.StringType()), T.StructField("parts", PARTS)])

GEOM_DDL = "struct<gtype:string,parts:array<array<array<struct<x:double,y:double>>>>>"

# Fixed values of the data model (must equal the reference for equal results).
DEFAULT_SRID = 2193
KEY_FALLBACK_NAME = "ufid"
OUTPUT_PREFIX = "new_"
FINAL_ID_START = 100_000_000
BOUNDARY_ERROR_MSG = "Mapsheet boundary-join error for table {table}"
OUTSIDE_MSG = "Features outside all regions in table {table}"
COLLISION_MSG = "UFID Collision in table {table}"

# Columns never treated as attributes.
#: Prefix of every internal column; attributes may have any other name.
INTERNAL = "__seam_"
REGIONS = INTERNAL + "regions"
GROUP = INTERNAL + "group"
SYSTEM_COLUMNS = ("ogc_fid", "geom", "ufid_components", REGIONS)

POLYGON_TYPES = ("POLYGON", "MULTIPOLYGON")
LINE_TYPES = ("LINESTRING", "MULTILINESTRING")
MULTI_TYPES = ("MULTILINESTRING", "MULTIPOLYGON")

ASSOCIATIONS_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("layer", T.StringType()),
        T.StructField("ufid", T.LongType()),
        T.StructField("ufid_components", T.ArrayType(T.LongType())),
    ]
)

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("ref", T.LongType()),
        T.StructField("msg", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

REGION_SCHEMA = T.StructType([T.StructField("region", T.StringType()), T.StructField("geom", GEOMETRY)])
