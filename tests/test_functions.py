import json

import pytest
from pyspark.sql import functions as F

from weirlog.functions.maps import normalise_headers
from weirlog.functions.mime import split_content_type
from weirlog.functions.text import WHITE_SPACE, compact_json, escape_markup, is_json, trim_space
from weirlog.functions.url import split_url
from weirlog.functions.xml import xml_to_json


def each(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expression(F.col("v")).alias("x")).orderBy("i").collect()]


def strict(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse)
        return True
    except ValueError:
        return False


TEXTS = [
    "null", "12", '"s"', "[1]", '{"a":1} x', '{"a":1,"a":2}', '{"a":NaN}', '{"a":01}', "1],[2", "1}", "", "  ",
    '{"a":1},"y":{"b":1}', '{"a":1}],[{"b":1}', '\t{"a": [1, {"b": null}]}\n', "tru", "-0", "1e400", '"\x01"', "[1,]",
    '{"a" : "b\\"c"}', "'a'", "{a:1}",
]


def test_is_json_agrees_with_a_strict_parser(spark):
    assert each(spark, TEXTS, is_json) == [strict(t) for t in TEXTS]


def test_compact_keeps_blanks_inside_strings(spark):
    assert each(spark, ['{ "a b" : [1 , "x \\" y"],\n"c":\t1.50 }'], compact_json) == ['{"a b":["x'.replace('"x', "1,") + '"x \\" y"],"c":1.50}']


def test_trim_covers_unicode_space(spark):
    assert each(spark, [WHITE_SPACE + "a b" + WHITE_SPACE], trim_space) == ["a b"]


def test_escape_markup(spark):
    assert each(spark, ['{"a":"<b>& "}'], escape_markup) == ['{"a":"\\u003cb\\u003e\\u0026\\u2028"}']


@pytest.mark.parametrize(
    "header, expected",
    [
        ("text/plain", ("text/plain", None)),
        ('Application/JSON; Charset="utf-8"', ("application/json", {"charset": "utf-8"})),
        ("text/plain; charset", None),
        (";;", None),
        ("text/plain;", ("text/plain", None)),
        ("text/plain; a=1; A=2", None),
        ("text/plain; a=1; a=1", ("text/plain", {"a": "1"})),
        ('x/y; q="a;b=c\\"d" ; z = 2', ("x/y", {"q": 'a;b=c"d', "z": "2"})),
        ('x/y; q=""', ("x/y", {"q": ""})),
        ("text /plain", None),
        ("text", ("text", None)),
        ("a/b/c", None),
    ],
)
def test_content_type(spark, header, expected):
    (got,) = each(spark, [header], split_content_type)
    assert (got and (got.media_type, got.parameters)) == expected


@pytest.mark.parametrize(
    "target, url, path, query_raw, query",
    [
        (
            "/p?x=1&y=2&x=3&z&w=a%20b+c&e=a=b", "/p?x=1&y=2&x=3&z&w=a%20b+c&e=a=b", "/p",
            "x=1&y=2&x=3&z&w=a%20b+c&e=a=b",
            {"x": ["1", "3"], "y": ["2"], "z": [""], "w": ["a b c"], "e": ["a=b"]},
        ),
        ("HTTP://h.example/a%20b+c", "http://h.example/a%20b+c", "/a b+c", None, None),
        ("/a#b?c#d", "/a%23b?c#d", "/a#b", "c#d", {"c#d": [""]}),
        ("/p?", "/p?", "/p", None, None),
        ("/p?a=%zz&b=1&&c;d=2", "/p?a=%zz&b=1&&c;d=2", "/p", "a=%zz&b=1&&c;d=2", {"b": ["1"]}),
        ("*", "*", "*", None, None),
    ],
)
def test_url(spark, target, url, path, query_raw, query):
    (got,) = each(spark, [target], split_url)
    assert (got.url, got.url_raw, got.path, got.query_raw, got.query) == (url, target, path, query_raw, query)


@pytest.mark.parametrize(
    "method, target, url, path, query_raw",
    [
        ("CONNECT", "example.com:443", "//example.com:443", None, None),
        ("CONNECT", "example.com:443?a=b", "//example.com:443?a=b", None, "a=b"),
        ("CONNECT", "[::1]:80", "//[::1]:80", None, None),
        ("CONNECT", "/rpc", "/rpc", "/rpc", None),
        ("connect", "/p?x=1", "/p?x=1", "/p", "x=1"),
        ("GET", "http://h/p", "http://h/p", "/p", None),
        (None, "/p", "/p", "/p", None),
    ],
)
def test_targets_of_connect(spark, method, target, url, path, query_raw):
    df = spark.createDataFrame([(target, method)], "t string, m string")
    got = df.select(split_url(F.col("t"), F.col("m")).alias("x")).first().x
    assert (got.url, got.url_raw, got.path, got.query_raw) == (url, target, path, query_raw)


def test_xml_golden_table(spark):
    cases = {
        "<r><a>1</a></r>": {"r": {"a": 1}},
        "<r><b>1</b><b>x</b></r>": {"r": {"b": [1, "x"]}},
        "<r x='1'>t<c>true</c><d>3.5</d></r>": {"r": {"-x": 1, "#content": "t", "c": True, "d": 3.5}},
        "<r><n></n></r>": {"r": {"n": None}},
        "<r/>": {"r": None},
        "<?xml version='1.0'?><!-- c --><r><a>1</a></r>": {"r": {"a": 1}},
        "<r><a>1</a": None,
        "plain words": None,
        "": None,
    }
    got = each(spark, list(cases), xml_to_json)
    assert [g and json.loads(g) for g in got] == list(cases.values())


def test_headers(spark):
    df = spark.sql(
        """select map('X-A', array('1'), 'x-a', array('2','3'), 'N', array(), 'B', array('1','2','3')) m
           union all select map('Only', array('1')) union all select null"""
    ).select(normalise_headers(F.col("m")).alias("m"))
    rows = [r.m for r in df.collect()]
    assert {"x-a": ["1", "2", "3"], "n": None, "b": ["1", "2", "3"]} in rows
    assert {"only": ["1"]} in rows and None in rows


def test_json_of_any_depth_and_length(spark):
    texts = {"[" * 1500 + "]" * 1500: True, "1" * 1500: True, '["' + "x" * 3000 + '"]': True, "[" * 1500 + "]" * 1499: False,
             "{'a': 1}": False, "NaN": False, "[1],[2]": False, "1} {": False, "01": False, "": False, " ": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ok for r in df.select("t", is_json(F.col("t")).alias("ok")).collect()} == texts


@pytest.mark.parametrize(
    "target, path", [("//foo/bar", "//foo/bar"), ("//", "//"), ("http://h/p", "/p"), ("http:", None), ("/a//b", "/a//b")]
)
def test_two_slashes_begin_a_path(spark, target, path):
    df = spark.createDataFrame([(target,)], "t string")
    assert df.select(split_url(F.col("t"))["path"]).first()[0] == path
