"""Request target: path, query text, query map, normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Without a scheme two slashes begin a path.
_SCHEME_AND_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/]*)?)?"
_BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# Characters that stand for themselves in a path.
_PATH_SAFE = r"[A-Za-z0-9\-_.~!$&'()*+,;=:@%/\[\]]"


def url_decode(text: Column) -> Column:
    """Percent-decoding with ``+`` as a blank; NULL where an escape is broken."""
    return F.when(~text.rlike(_BAD_ESCAPE), F.try_url_decode(text))


def split_url(target: Column, method: Column | None = None) -> Column:
    """STRUCT(url, url_raw, path, query_raw, query) of a request target.

    A request target has no fragment: ``#`` belongs to the path or the query. That
    of the ``method`` CONNECT is a host and port where it does not begin with a slash.
    """
    if method is not None:
        asked = target
        authority = (method == "CONNECT") & ~F.startswith(asked, F.lit("/"))
        # Behind two slashes and a scheme the same rules find the host; the scheme goes again.
        target = F.when(authority, F.concat(F.lit("http://"), asked)).otherwise(asked)
        found = split_url(target)
        url = F.when(authority, F.substr(found["url"], F.lit(6))).otherwise(found["url"])
        return F.struct(
            url.alias("url"), asked.alias("url_raw"), *[found[n].alias(n) for n in ("path", "query_raw", "query")]
        )
    before = F.substring_index(target, "?", 1)
    query_raw = F.when(
        F.contains(target, F.lit("?")), F.substring(target, F.length(before) + 2, F.length(target))
    )
    origin = F.regexp_extract(before, _SCHEME_AND_AUTHORITY, 0)
    raw_path = F.substring(before, F.length(origin) + 1, F.length(before))
    # A plus sign in a path is a plus sign.
    path = F.coalesce(url_decode(F.replace(raw_path, F.lit("+"), F.lit("%2B"))), raw_path)
    escaped = F.array_join(
        F.transform(
            F.split(raw_path, ""),
            lambda c: F.when(c.rlike(_PATH_SAFE), c).otherwise(
                F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
            ),
        ),
        "",
    )
    normal_path = F.when(raw_path.rlike(rf"^{_PATH_SAFE}*$"), raw_path).otherwise(escaped)
    scheme = F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.\-]*:", 0)
    normal_origin = F.concat(F.lower(scheme), F.substring(origin, F.length(scheme) + 1, F.length(origin)))
    url = F.concat(normal_origin, normal_path, F.coalesce(F.concat(F.lit("?"), query_raw), F.lit("")))
    return F.struct(
        url.alias("url"),
        target.alias("url_raw"),
        F.nullif(path, F.lit("")).alias("path"),
        F.nullif(query_raw, F.lit("")).alias("query_raw"),
        query_map(query_raw).alias("query"),
    )


def query_map(query_raw: Column) -> Column:
    """MAP(name -> values in order); pairs that cannot be decoded are left out.

    ``str_to_map`` refuses repeated names, so names are listed once and each
    collects its own values.
    """
    parts = F.filter(F.split(query_raw, "&"), lambda p: (p != "") & ~p.contains(";"))
    pairs = F.filter(
        F.transform(
            parts,
            lambda p: F.struct(
                url_decode(F.substring_index(p, "=", 1)).alias("name"),
                url_decode(
                    F.when(p.contains("="), F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(
                        F.lit("")
                    )
                ).alias("value"),
            ),
        ),
        lambda pair: pair["name"].isNotNull() & pair["value"].isNotNull(),
    )
    # `aggregate` binds the decoded pairs once for the grouping below.
    grouped = F.transform(
        F.array(pairs),
        lambda ps: F.map_from_entries(
            F.transform(
                F.array_distinct(F.transform(ps, lambda pair: pair["name"])),
                lambda name: F.struct(
                    name,
                    F.transform(
                        F.filter(ps, lambda pair: pair["name"] == name), lambda pair: pair["value"]
                    ),
                ),
            )
        ),
    )
    found = F.get(grouped, F.lit(0))
    return F.when(F.size(found) > 0, found)
