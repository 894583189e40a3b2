"""Text and JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_JSON_STRING_OR_BLANKS = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]+'


def blank_to_null(column: Column) -> Column:
    """An empty text counts as absent."""
    return F.nullif(column, F.lit(""))


def trim_space(column: Column) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` strips blanks only)."""
    return F.btrim(column, F.lit(WHITE_SPACE))


# The reader's own limits lifted and its leniency switched off.
_STRICT_JSON = {
    "maxNestingDepth": str(2**31 - 1),
    "maxNumLen": str(2**31 - 1),
    "maxStringLen": str(2**31 - 1),
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
    "columnNameOfCorruptRecord": "broken",
}


def is_json(text: Column) -> Column:
    """True where the whole text is one JSON value, however deep and long.

    The parser stops at the end of the first value and ignores what follows.
    Wrapped as a list member and as an object member, trailing characters
    break at least one of the two.
    """

    def whole(wrapped: Column) -> Column:
        # The member is skipped, not copied: copying has a depth limit of its own.
        return F.from_json(wrapped, "other int, broken string", _STRICT_JSON)["broken"].isNull()

    as_item = whole(F.concat(F.lit('{"x":['), text, F.lit("]}")))
    as_member = whole(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.coalesce(text.isNotNull() & as_item & as_member, F.lit(False))


def compact_json(text: Column) -> Column:
    """Drop the blanks between JSON tokens; strings stay as they are."""
    return F.regexp_replace(text, _JSON_STRING_OR_BLANKS, "$1")


def looks_like_object(text: Column) -> Column:
    return F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}"))


def has_markup(json_text: Column) -> Column:
    return json_text.rlike("[<>&\u2028\u2029]")


def escape_markup(json_text: Column) -> Column:
    """Escape ``<``, ``>``, ``&`` and the two Unicode line separators in JSON text.

    They can occur only inside JSON strings, so plain replacement is safe.
    """
    for character, escaped in (
        ("<", "\\u003c"),
        (">", "\\u003e"),
        ("&", "\\u0026"),
        ("\u2028", "\\u2028"),
        ("\u2029", "\\u2029"),
    ):
        json_text = F.replace(json_text, F.lit(character), F.lit(escaped))
    return json_text
