"""Fixed record layouts. Every read names its schema; nothing is inferred on a hot path."""

from __future__ import annotations

from pyspark.sql import types as T

MAPPING_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("ticker", T.StringType()),
    ]
)

POINT_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("interval", T.LongType()),
        T.StructField("valueUnit", T.StringType()),
    ]
)

#: The six-column price table.
PRICE_SCHEMA = T.StructType(
    [
        T.StructField("company_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        *POINT_SCHEMA.fields,
    ]
)

#: The price table together with the position of each point in its source array.
POSITIONED_PRICE_SCHEMA = T.StructType([*PRICE_SCHEMA.fields, T.StructField("pos", T.LongType())])

_VALUES = T.MapType(T.StringType(), T.VariantType())

#: The known fields of a company document as it stands on disk. ``id`` may be a string or a number; maps
#: and price points keep their JSON values, so that one odd value cannot blank its neighbours and numbers
#: stay numbers.
DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("indices", T.ArrayType(T.StringType())),
        T.StructField("exchanges", T.ArrayType(T.StringType())),
        T.StructField("aggregations", _VALUES),
        T.StructField(
            "insights",
            T.StructType([T.StructField("stock_price", T.ArrayType(T.VariantType()))]),
        ),
        T.StructField("lastUpdated", _VALUES),
    ]
)

#: Where the other fields of a document go, by name, as JSON values.
EXTRA = "extra"

#: A company record after shaping: typed id, empty collections in place of nulls, typed points, and the
#: fields that are not known.
COMPANY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *DOCUMENT_SCHEMA.fields[1:9],
        T.StructField(
            "insights",
            T.StructType([T.StructField("stock_price", T.ArrayType(POINT_SCHEMA))]),
        ),
        T.StructField("lastUpdated", _VALUES),
        T.StructField(EXTRA, _VALUES),
    ]
)

SCALAR_FIELDS = ["name", "ticker", "sector", "industry", "description"]
LIST_FIELDS = ["indices", "exchanges"]
MAP_FIELDS = ["aggregations", "insights", "lastUpdated"]
