"""Tolerant reading of JSON that a model wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tolerant_object(text: Column) -> Column:
    """The JSON object in a text as VARIANT: code fences, prose around it and trailing commas are forgiven; else null.

    The whole text is tried first, then the span from the first opening to the last
    closing brace, then that span without trailing commas.  A list that holds one
    object counts as that object.
    """
    bare = F.regexp_replace(text, r"```[A-Za-z]*", "")
    span = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(span, r",\s*([}\]])", "$1")

    def as_object(t):
        v = F.try_parse_json(t)
        kind = F.schema_of_variant(v)
        return F.when(kind.startswith("OBJECT"), v).when(kind.startswith("ARRAY<OBJECT"), F.try_variant_get(v, "$[0]", "variant"))

    return F.coalesce(as_object(F.trim(bare)), as_object(span), as_object(mended))
