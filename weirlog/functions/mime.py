"""Content type header: media type, parameters, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 2045 token and quoted-string grammar.
_TOKEN = r"[!#$%&'*+\-.0-9A-Z^_`a-z{|}~]+"
_QUOTED = r'"(?:[^"\\\r\n]|\\[^\r\n])*"'
_PARAMETER = rf";\s*({_TOKEN})\s*=\s*({_TOKEN}|{_QUOTED})"
_HEADER = rf"^\s*{_TOKEN}(?:/{_TOKEN})?\s*(?:;\s*{_TOKEN}\s*=\s*(?:{_TOKEN}|{_QUOTED})\s*)*;?\s*$"
_ESCAPED_SPECIAL = r'\\([()<>@,;:\\"/\[\]?=])'


def _unquote(value: Column) -> Column:
    inner = F.substring(value, F.lit(2), F.length(value) - 2)
    return F.when(
        F.startswith(value, F.lit('"')), F.regexp_replace(inner, _ESCAPED_SPECIAL, "$1")
    ).otherwise(value)


def split_content_type(header: Column) -> Column:
    """STRUCT(media_type, parameters) of a header; NULL where it is not well formed.

    A parameter named twice with different values makes the header invalid.
    """
    media_type = F.lower(F.trim(F.substring_index(header, ";", 1)))
    names = F.transform(F.regexp_extract_all(header, F.lit(_PARAMETER), 1), F.lower)
    values = F.transform(F.regexp_extract_all(header, F.lit(_PARAMETER), 2), _unquote)
    pairs = F.array_distinct(F.arrays_zip(names.alias("name"), values.alias("value")))
    repeated = F.size(F.array_distinct(names)) < F.size(pairs)
    parameters = F.when(header.contains(";") & (F.size(pairs) > 0) & ~repeated, F.map_from_entries(pairs))
    valid = header.rlike(_HEADER) & ~(header.contains(";") & repeated)
    return F.when(
        valid, F.struct(media_type.alias("media_type"), parameters.alias("parameters"))
    )
