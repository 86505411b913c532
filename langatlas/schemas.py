"""Explicit schemas for every input and staged dataset (no inference)."""

from pyspark.sql import types as T

OWNER = T.StructType([
    T.StructField("login", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("repos", T.LongType()),
    T.StructField("followers", T.LongType()),
])

LANG_ENTRY = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("loc", T.LongType()),
])

# One repository with its owner profile and ordered language list
REPO = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("owner", OWNER),
    T.StructField("langs", T.ArrayType(LANG_ENTRY)),
])

# D3: density export, one element per language
DIST = T.StructType([
    T.StructField("lang", T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("value", T.StringType()),
    ])),
    T.StructField("coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
])

# Same export when a producer wrote the triples as text (lenient cast input)
DIST_TEXT = T.StructType([
    T.StructField("lang", DIST["lang"].dataType),
    T.StructField("coords", T.ArrayType(T.ArrayType(T.StringType()))),
])

# Geocoded location
GEO = T.StructType([
    T.StructField("location", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lng", T.DoubleType()),
])

# Raw geocoder reply
GEOCODE_BODY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("results", T.ArrayType(T.StructType([
        T.StructField("address_components", T.ArrayType(T.StructType([
            T.StructField("long_name", T.StringType()),
            T.StructField("types", T.ArrayType(T.StringType())),
        ]))),
        T.StructField("geometry", T.StructType([
            T.StructField("location", T.StructType([
                T.StructField("lat", T.DoubleType()),
                T.StructField("lng", T.DoubleType()),
            ])),
        ])),
    ]))),
])
