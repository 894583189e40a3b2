"""XML document to JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names given to attributes and to the text of mixed elements.
_ATTRIBUTE_PREFIX = "-"
_TEXT_MEMBER = "#content"

_ROOT = r"^(?s)(?:\s*+(?:<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?\s*>))*+\s*+<([^\s/>!?]+)"


def xml_to_json(text: Column) -> Column:
    """``{"root": value}`` with typed leaves, or NULL where the text is not XML.

    The variant reader throws on malformed input, so a corrupt-record read
    guards it. Both run inside one lambda: the text is bound once, and Spark
    evaluates it there without generating code for the variant reader.
    """
    options = {"attributePrefix": _ATTRIBUTE_PREFIX, "valueTag": _TEXT_MEMBER}

    def convert(document: Column) -> Column:
        broken = F.from_xml(document, "`_corrupt_record` STRING, `_none` STRING", options)["_corrupt_record"]
        root = F.regexp_extract(document, _ROOT, 1)
        value = F.to_json(F.from_xml(document, "variant", options))
        # A document without content has no JSON value of its own.
        value = F.coalesce(value, F.lit("null"))
        quoted = F.to_json(root.cast("variant"))
        return F.when((root != "") & broken.isNull(), F.concat(F.lit("{"), quoted, F.lit(":"), value, F.lit("}")))

    return F.get(F.transform(F.array(text), convert), F.lit(0))
