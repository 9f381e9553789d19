"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from loglattice.functions import columns as fn
from loglattice.functions import own
from loglattice.functions.patterns import PATTERNS, extract_pattern, patterns, template


def values(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict()


def check(spark, cases):
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for i, (c, want) in enumerate(cases):
        assert got[i] == (pytest.approx(want) if isinstance(want, float) else want), (i, c, got[i], want)


def test_regex(spark):
    t = F.lit("a1 b22 c")
    check(spark, [
        (fn.regex_match(r"b\d+", t), True), (fn.regex_match("(", t), False), (fn.regex_replace(r"(\w)(\d)", "$2$1", t), "1a 2b2 c"),
        (fn.regex_replace("a", r"\1", t), r"\11 b22 c"), (fn.regex_find_all(r"\d+", t), ["1", "22"]), (fn.regex_find_all("z", t), []),
    ])


# Values written for these tests, one or more for each pattern.
FOUND = {
    "duration": ("took 2h30m today", "2h30m"), "email": ("to a.b@c.org now", "a.b@c.org"), "fqdn": ("at www.c.org:80", "www.c.org"), "function": ("run f_1 (x)", "f_1 ("), "gitcommit": ("at 0a1b2c3d!", "0a1b2c3d"),
    "hexnum": ("is 0xFF.", "0xFF"), "hexcolor": ("in #a0b1c2;", "#a0b1c2"), "ipv4": ("from 10.0.0.255", "10.0.0.255"), "ipv4_port": ("from 10.0.0.1:80 on", "10.0.0.1:80"), "ipv6": ("x 1:2:3:4:5:6:7:8 y", "1:2:3:4:5:6:7:8"),
    "isotime": ("2024-01-02T03:04:05.6+01:00", "2024-01-02T03:04:05.6+01:00"), "json": ('x {"a": [1]} y', '{"a": [1]}'), "jwt": ("t aa.bb.cc", "aa.bb.cc"), "mac": ("00:1b:44:11:3a:b7", "00:1b:44:11:3a:b7"), "md5": ("d41d8cd98f00b204e9800998ecf8427e", "d41d8cd98f00b204e9800998ecf8427e"),
    "num": ("is -1.5", "-1.5"), "path": ("in /var/log/", "/var/log/"), "oauth": ("k abcdefghij0123456789", "abcdefghij0123456789"), "sha1": ("a" * 40, "a" * 40), "sha256": ("b" * 64, "b" * 64), "sql": ("do select 1", "select"), "url": ("see http://a.b/c?d", "http://a.b/c?d"),
    "uuid": ("1b4e28ba-2fa1-11d2-883f-0016d3cca427", "1b4e28ba-2fa1-11d2-883f-0016d3cca427"), "version": ("v 1.2.3-rc.1", "1.2.3-rc.1"), "winregistry": ("\\HKEY_X\\a", "\\HKEY_X\\a"),
}


def test_named_patterns(spark):
    assert set(FOUND) == set(PATTERNS) and len(PATTERNS) == 25
    check(spark, [(extract_pattern(n, F.lit(text)), want) for n, (text, want) in FOUND.items()])
    check(spark, [(extract_pattern("ipv4", F.lit("256.1.1.x")), None), (extract_pattern("nothing", F.lit("x")), None)])
    assert [r.name for r in patterns(spark).collect()] == sorted(PATTERNS)


def test_patterns_by_ascii(spark):
    """Letters of other scripts are no word characters, a vertical tab is no blank, and a dot stops at newlines only: as in the SQL."""
    check(spark, [
        (extract_pattern("oauth", F.lit("\u00ef" + "aition" * 4)), "aition" * 4), (extract_pattern("oauth", F.lit("aition" * 4 + "\u0301\u00e9 x")), "aition" * 4), (extract_pattern("sha1", F.lit("_" + "a" * 40)), None),
        (extract_pattern("gitcommit", F.lit("\u00e9abcdef0\u00e9")), "abcdef0"), (extract_pattern("url", F.lit("http://a\x0bb c")), "http://a\x0bb"), (extract_pattern("json", F.lit("{a\r\u2028}")), "{a\r\u2028}"), (extract_pattern("json", F.lit("{a\n}")), None),
    ])


def test_templates():
    assert template("{a} [{b:int}]")[1] == [("a", "string"), ("b", "bigint")]
    for bad in ("none", "{1a}", "{a:date}", "{a}{a}", "{}"):
        with pytest.raises(ValueError):
            template(bad)


def test_json_csv_pairs(spark):
    check(spark, [
        (fn.parse_json(F.lit('{"a":1}'), "a bigint")["a"], 1), (fn.parse_json(F.lit("{bad"), "a bigint")["a"], None), (fn.dump_json(F.struct(F.lit(1.5).alias("x"))), '{"x":1.5}'),
        (fn.parse_csv(F.lit('a,"b, ""c""",d')), {"col1": "a", "col2": 'b, "c"', "col3": "d"}), (fn.parse_csv(F.lit("a;b"), ["x", "y", "z"], ";"), {"x": "a", "y": "b", "z": ""}), (fn.parse_csv(F.lit("a,b,c"), ["x"]), {"x": "a"}),
        (fn.parse_csv(F.lit('a,"b, c')), {"col1": "a", "col2": "b, c"}), (fn.parse_csv(F.lit(""), ["x"]), {}), (fn.parse_csv(F.lit(",")), {"col1": "", "col2": ""}), (fn.dump_csv(F.array(F.lit("a,b"), F.lit("c")), ";"), "a,b;c"),
        (fn.parse_kv(F.lit("a=1 b=x=y c a=2")), {"b": "x=y", "a": "2"}), (fn.parse_kv(F.lit("a:1|b:2"), ":", "|"), {"a": "1", "b": "2"}),
    ])


def test_text(spark):
    t = F.lit("  the quick  brown fox ")
    check(spark, [
        (fn.cols(t, 0), "the"), (fn.cols(t, -1), "fox"), (fn.cols(t, 9), ""), (fn.cols(t, "0,2"), "the brown"), (fn.cols(t, "0,9"), "the"), (fn.cols(t, "1:3"), "quick brown"), (fn.cols(t, "2:"), "brown fox"), (fn.cols(t, ":-2", outsep="-"), "the-quick"),
        (fn.cols(t, "-2:"), "brown fox"), (fn.cols(t, 0, "1:2"), ["the", "quick"]), (fn.cols(F.lit("a||b"), 1, sep="|"), ""), (fn.cols(F.lit("a.b.c"), "0,-1", sep=".", outsep="+"), "a+c"), (fn.byte_length(F.lit("é")), 2),
        (fn.capitalize(F.lit("aBC")), "Abc"), (fn.removeprefix(F.lit("abc"), "ab"), "c"), (fn.removesuffix(F.lit("abc"), "bc"), "a"), (fn.removesuffix(F.lit("abc"), "x"), "abc"), (fn.partition(F.lit("k=v=w"), "="), ["k", "=", "v=w"]), (fn.partition(F.lit("kv"), "="), ["kv", "", ""]), (fn.count_of(F.lit("a.b.c"), "."), 2),
        (fn.truthy(F.lit(0), "int"), False), (fn.truthy(F.lit(0.0), "double"), True), (fn.truthy(F.lit(""), "string"), False), (fn.truthy(F.lit(None), "void"), False), (fn.truthy(F.array(), "array<string>"), True),
    ])


def test_time(spark):
    check(spark, [
        (fn.parse_ts(F.lit("2024-01-15T10:30:45Z")), 1705314645), (fn.parse_ts(F.lit("2024-01-15T11:30:45.5+01:00")), 1705314645), (fn.parse_ts(F.lit("2024-01-15 10:30:45")), 1705314645), (fn.parse_ts(F.lit("2024-01-15")), 1705276800), (fn.parse_ts(F.lit("nope")), None),
        (fn.parse_ts(F.lit("15/Jan/2024 10:30"), "%d/%b/%Y %H:%M"), 1705314600), (fn.format_ts(F.lit(1705314645)), "2024-01-15T10:30:45+00:00"), (fn.format_ts(F.lit(0), "%Y at %H"), "1970 at 00"), (fn.ts_diff(F.lit(5), F.lit(3)), 2), (fn.ts_add(F.lit(5), F.lit(3)), 8),
    ])
    guesses = ["2024-01-15T10:30:45.123456789Z", "2024-01-15 10:30:45", "2024-01-15T10:30:45", "15/Jan/2024:10:30:45 +0000", "20240115T103045", "15.01.2024 10:30:45", "2024-01-15-10.30.45.123456", "15-01-2024 10:30:45", "24/01/15 10:30:45", "[Mon Jan 15 10:30:45 2024]", "2024-01-15 10:30:45,123", "1705314645", "1705314645000", "Mon, 15 Jan 2024 10:30:45 +0000"]
    check(spark, [(fn.guess_ts(F.lit(t)), 1705314645) for t in guesses])
    check(spark, [(fn.guess_ts(F.lit("15.01.2024")), 1705276800), (fn.guess_ts(F.lit("15-01-2024")), 1705276800), (fn.guess_ts(F.lit("202401151030")), 1705314600), (fn.guess_ts(F.lit("no date")), None), (fn.guess_ts(F.lit("1511648546")), 1511648546)])
    check(spark, [(fn.guess_ts(F.lit("Jan 15 10:30:45")).isNotNull(), True)])
    with pytest.raises(ValueError):
        fn.java_pattern("%Q")


# Durations and their seconds.
DURATIONS = {"500us": 0.0005, "250ms": 0.25, "3m": 180.0, "1w": 604800.0, "3h30m": 12600.0, "1d2h3m4s5ms": 93784.005, "1.5h": 5400.0, "1h1h": 7200.0, "2h 30m": 9000.0, "1 hour 30 minutes": 5400.0, "1y": 31557600.0, "1M": 2630016.0}


def test_durations(spark):
    check(spark, [(fn.parse_duration(F.lit(t)), s) for t, s in DURATIONS.items()])
    check(spark, [(fn.parse_duration(F.lit(t)), None) for t in ("", "123", "5z", "abc s", "-5s", "invalid")])


def test_lists_and_paths(spark):
    data = F.lit('{"a":{"b":[10,{"c":"x"}]},"n":null}')
    numbers = lambda *x: F.array(*[F.lit(v) for v in x])
    check(spark, [
        (fn.get_path("a.b.0", data), "10"), (fn.get_path("a.b.1.c", data), "x"), (fn.get_path("a.x", data, "d"), "d"), (fn.get_path("a.b.9", data), None), (fn.get_path("a.b.-1", data, "d"), "d"), (fn.get_path("", F.lit("{}")), "{}"),
        (fn.list_avg(numbers(1, 2, 6)), 3.0), (fn.list_avg(F.array().cast("array<double>")), None), (fn.list_sum(F.array().cast("array<double>")), 0.0), (fn.list_avg(numbers("1", "2")), 1.5),
        (fn.list_percentile(numbers(*range(1, 6)), 50), 3.0), (fn.list_percentile(numbers(*range(1, 11)), 90), 9.1), (fn.list_percentile(numbers(4, 3, 2, 1), 25), 1.75), (fn.list_percentile(numbers(1), 101), None), (fn.list_percentile(F.array().cast("array<int>"), 5), None),
        (fn.round_half_up(F.lit(2.5)), 3.0), (fn.round_half_up(F.lit(-2.5)), -3.0), (fn.round_half_up(F.lit(1.005), 2), 1.0), (fn.power(F.lit(2), 10), 1024.0), (fn.absolute(F.lit(-3)), 3.0),
    ])


def test_values_that_cannot_be_taken_give_null(spark):
    check(spark, [
        (fn.list_sum(F.array(F.lit("1"), F.lit("x"))), None), (fn.list_avg(F.array(F.lit("1"), F.lit("x"))), None), (fn.list_percentile(F.array(F.lit("1"), F.lit("x")), 50), None), (fn.list_sum(F.array(F.lit("1"), F.lit("2.5"))), 3.5),
        (fn.round_half_up(F.lit(1e25)), 1e25), (fn.round_half_up(F.lit(-2.5)), -3.0), (fn.words(F.lit("\ta\u00a0b ")), ["a", "b"]),
    ])
    got = spark.createDataFrame([("a",), ("1",), (None,)], "x string").select(fn.evaluates(F.col("x").cast("int")).alias("ok")).collect()
    assert [r.ok for r in got] == [False, True, True]


def test_functions_of_ones_own(spark, tmp_path):
    (tmp_path / "a.sql").write_text("-- sizes\nown_size(n INT) RETURNS STRING\n  RETURN CASE WHEN n > 1 THEN 'many' ELSE 'one' END\n\nown_twice(n INT) RETURNS INT RETURN 2 * n\n")
    (tmp_path / "b.sql").write_text("own_twice(n INT) RETURNS INT RETURN n + n + 0 * own_times()\n".replace("own_times()", "1"))
    assert own.include(spark, str(tmp_path / "a.sql"), str(tmp_path / "b.sql")) == ["own_size", "own_twice", "own_twice"]
    assert spark.range(1).selectExpr("own_size(2)", "own_twice(3)").first()[:] == ("many", 6)
    own.define(spark, "own_twice(n INT) RETURNS INT RETURN 20 * n")
    plan = spark.range(5).where("own_twice(cast(id as int)) = 40")
    assert plan.count() == 1 and "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="no function"):
        own.define(spark, "nothing")
