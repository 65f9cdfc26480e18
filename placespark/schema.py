"""Column types shared by all jobs."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
LINE = T.ArrayType(POINT)
PART = T.ArrayType(LINE)
GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(PART))])
OSM_KEY = T.StructType([T.StructField("id", T.StringType()), T.StructField("type", T.StringType())])

GEOMETRY_DDL = "struct<kind:string,parts:array<array<array<struct<x:double,y:double>>>>>"

# One row per node of a location expression.
OPS_DDL = (
    "expr_id string, node_id int, parent_id int, slot int, op string, depth int, "
    "shp_id int, distance int, unit string, cardinal string"
)

# What an <entity> element is read as; p keeps its inner XML in document order.
ENTITY_XML_DDL = (
    "_id string, _wikipedia string, _osm string, _type string, _status string, p array<string>"
)

# Geometry kinds (fixed values).
POINT_KINDS = ("Point", "MultiPoint")
LINE_KINDS = ("LineString", "MultiLineString")
AREA_KINDS = ("Polygon", "MultiPolygon")
