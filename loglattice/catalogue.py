"""Registered queries of the library's own operators, each over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import columns as fn
from .functions import own
from .functions.patterns import PATTERNS, extract_pattern
from .operators import chunking, folds, joins, levels, ordering, records, sessions, sketches
from .plans.pipeline import Pipeline
from .session import shared_folder
from .sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def document_lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, LINENUM, line of every line of every document."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("LINENUM"), "line")


LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS linenum FROM documents)"

# -- flagship ---------------------------------------------------------------------------------------------------


@query("""
SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n
FROM events WHERE lower(event_type) IN ('error', 'purchase')
""")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Level filter, derived field, running count and projection in one pipeline."""
    p = Pipeline(events(spark, d), order="event_id").levels(include=["error", "purchase"], level="event_type")
    return p.derive(k="cast(get_json_object(props, '$.k') as bigint)").inc("n", by=["event_type"]).keys(["event_id", "event_type", "k", "n"]).frame


@query("SELECT user_id, count(*) AS n_errors FROM events WHERE event_type = 'error' GROUP BY user_id")
def error_sessions(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where(F.col("event_type") == "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_errors"))


# -- levels -----------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) IN ('error', 'signup')")
def filter_level(spark: SparkSession, d: str) -> DataFrame:
    return levels.filter_levels(events(spark, d), include=["ERROR", "signup"], level="event_type").select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE lower(event_type) NOT IN ('view', 'click')")
def exclude_level(spark: SparkSession, d: str) -> DataFrame:
    return levels.filter_levels(events(spark, d), exclude=["view", "click"], level="event_type").select("event_id", "event_type")


@query(
    "WITH " + LINES + " SELECT doc_id, linenum, CASE "
    + " ".join(f"WHEN regexp_matches(lower(line), '{levels.family_regex(names)}') THEN '{level}'" for level, names in levels.FAMILIES.items())
    + " END AS level FROM lines"
)
def level_from_text(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).select("doc_id", F.col("LINENUM").alias("linenum"), levels.level_from_text("line").alias("level"))


@query("""
WITH n AS (SELECT event_id, substr(lower(event_type), 1, 1) AS mark, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 80) AS BIGINT) AS row, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)
SELECT row, arg_min(t, event_id) AS timestamp, string_agg(mark, '' ORDER BY event_id) AS map FROM n GROUP BY row
""")
def levelmap(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return levels.level_map(df, "event_id", level="event_type", timestamp="ts")


# -- filters, derived fields, projections -----------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def filter_expr(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(table(spark, d, "lineitem")).filter("l_quantity >= 45 and l_returnflag = 'R'").keys(["l_orderkey", "l_linenumber", "l_quantity"]).frame


@query("SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> 0")
def filter_truthy(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(events(spark, d)).filter("cast(get_json_object(props, '$.k') as bigint)").keys(["event_id"]).frame


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS total, (l_extendedprice * (1 - l_discount)) * (1 + l_tax) AS charge FROM lineitem")
def derive_total(spark: SparkSession, d: str) -> DataFrame:
    p = Pipeline(table(spark, d, "lineitem")).derive(total="l_extendedprice * (1 - l_discount)", _taxed="1 + l_tax", charge="total * _taxed")
    return p.keys(["l_orderkey", "l_linenumber", "total", "charge"]).frame


@query("SELECT event_id, ts, user_id, event_type, value FROM events")
def derive_delete(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(events(spark, d)).derive(props=None).frame


@query("SELECT event_id || ':' || upper(event_type) AS line FROM events WHERE value IS NOT NULL")
def eval_line(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(events(spark, d)).eval("case when value is not null then concat(event_id, ':', upper(event_type)) end").frame


@query("SELECT doc_id, linenum, string_split(line, ' ')[1] AS first FROM (WITH " + LINES + " SELECT * FROM lines) WHERE line <> ''")
def text_to_data(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(spark, d).where("line <> ''")
    return Pipeline(lines).select(doc_id="doc_id", linenum="LINENUM", first="split(line, ' ')[0]").frame


@query("SELECT user_id, event_id FROM events")
def keys_project(spark: SparkSession, d: str) -> DataFrame:
    return records.keys(events(spark, d), ["user_id", "missing", "event_id"])


@query("SELECT event_id, ts, user_id, event_type FROM events")
def remove_keys(spark: SparkSession, d: str) -> DataFrame:
    return records.remove_keys(events(spark, d), ["value", "props", "missing"])


@query("SELECT ts, event_type FROM events")
def common_keys(spark: SparkSession, d: str) -> DataFrame:
    return records.common_keys(events(spark, d), ["event_type"])


@query("SELECT page_id, regexp_extract(url, '([^\\s]+)://([^\\s]+)/([+-]?\\d+)', 2) AS host, TRY_CAST(regexp_extract(url, '([^\\s]+)://([^\\s]+)/([+-]?\\d+)', 3) AS BIGINT) AS number FROM pages WHERE regexp_matches(url, '([^\\s]+)://([^\\s]+)/([+-]?\\d+)')".replace("\\\\", "\\"))
def extract_vars_url(spark: SparkSession, d: str) -> DataFrame:
    return records.extract_vars(table(spark, d, "pages"), "{scheme}://{host}/{number:int}", "url").where("scheme is not null").select("page_id", "host", "number")


# -- order: line numbers, counters, windows, exit ---------------------------------------------------------------


@query("WITH " + LINES + " SELECT doc_id, linenum, line FROM lines WHERE trim(line) <> ''")
def linenum(spark: SparkSession, d: str) -> DataFrame:
    return document_lines(spark, d).where(F.trim("line") != "").select("doc_id", F.col("LINENUM").alias("linenum"), "line")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events")
def inc_running(spark: SparkSession, d: str) -> DataFrame:
    return ordering.running_count(events(spark, d).select("event_id", "event_type"), "n", "event_id", ["event_type"]).select("event_id", "n")


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS errors FROM events")
def inc_conditional(spark: SparkSession, d: str) -> DataFrame:
    return ordering.running_count(events(spark, d).select("event_id", "event_type"), "errors", "event_id", when=F.col("event_type") == "error").select("event_id", "errors")


@query("SELECT event_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def inc_amount(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return ordering.running_total(rows, F.col("k"), "total", "event_id", ["user_id"]).select("event_id", "total")


@query("SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def inc_total(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(events(spark, d), by=("event_type",)).end(total=F.count(F.lit(1))).footer


_TRAIL = "OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, round(sum(value) {_TRAIL}, 4) AS window_sum, count(*) {_TRAIL} AS window_size FROM events")
def window_sum(spark: SparkSession, d: str) -> DataFrame:
    made = ordering.trailing(events(spark, d).select("event_id", "value"), 3, "event_id", {"window_sum": lambda w: F.round(F.sum("value").over(w), 4), "window_size": ordering.window_size()})
    return made.select("event_id", "window_sum", "window_size")


@query(f"SELECT event_id, array_to_string(list(event_type) {_TRAIL}, '|') AS window_values, len(list(value) {_TRAIL}) AS window_numbers FROM events")
def window_values_joined(spark: SparkSession, d: str) -> DataFrame:
    made = ordering.trailing(events(spark, d).select("event_id", "event_type", "value"), 3, "event_id", {"window_values": ordering.window_values("event_type"), "window_numbers": ordering.window_numbers("value")})
    return made.select("event_id", F.array_join("window_values", "|").alias("window_values"), F.size("window_numbers").cast("long").alias("window_numbers"))


@query("SELECT event_id, value - lag(value, 1) OVER (ORDER BY event_id) AS change FROM events")
def window_change(spark: SparkSession, d: str) -> DataFrame:
    made = ordering.trailing(events(spark, d).select("event_id", "value"), 2, "event_id", {"last": ordering.back("value", 1)})
    return made.select("event_id", (F.col("value") - F.col("last")).alias("change"))


@query("SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), '>') AS roles FROM conversations")
def window_by_conversation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return ordering.trailing(rows, 4, "turn", {"w": ordering.window_values("role")}, ["conv_id"]).select("conv_id", "turn", F.array_join("w", ">").alias("roles"))


@query("SELECT event_id, event_type FROM events WHERE event_id <= (SELECT min(event_id) FROM events WHERE value > (SELECT max(value) FROM events) * 0.9)")
def exit_prefix(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d)
    most = df.agg(F.max("value")).first()[0]
    return Pipeline(df, order="event_id").exit(F.col("value") > most * 0.9).keys(["event_id", "event_type"]).frame


@query("SELECT conv_id, turn, text FROM conversations c WHERE turn <= coalesce((SELECT min(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = 'assistant'), 1000000)")
def exit_by_file(spark: SparkSession, d: str) -> DataFrame:
    return ordering.until_exit(table(spark, d, "conversations"), F.col("role") == "assistant", "turn", ["conv_id"]).select("conv_id", "turn", "text")


@query("SELECT event_id FROM events WHERE event_type <> 'view'")
def skip_rows(spark: SparkSession, d: str) -> DataFrame:
    return Pipeline(events(spark, d)).skip("event_type = 'view'").keys(["event_id"]).frame


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("SELECT 0 AS part, 'begin' AS line UNION ALL SELECT 1, CAST(event_id AS VARCHAR) FROM events UNION ALL SELECT 2, CAST(count(*) AS VARCHAR) FROM events")
def begin_end(spark: SparkSession, d: str) -> DataFrame:
    lines = Pipeline(events(spark, d)).eval("event_id")
    return lines.begin(spark.createDataFrame([("begin",)], "line string")).end(line="cast(count(1) as string)").result().select("part", "line")


@query("SELECT conv_id, turn, 0 AS emission, text AS line FROM conversations UNION ALL SELECT conv_id, turn, 1, upper(role) FROM conversations UNION ALL SELECT conv_id, turn, 2, CAST(length(text) AS VARCHAR) FROM conversations")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "conversations").withColumnRenamed("text", "line")
    return Pipeline(df).emit("array(upper(role), cast(length(line) as string))").frame.select("conv_id", "turn", "emission", "line")


# -- chunks -----------------------------------------------------------------------------------------------------

_AGG = "min(linenum) AS start_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY linenum) AS text"


@query(f"WITH {LINES} SELECT doc_id, CAST(floor((linenum - 1) / 4) AS BIGINT) AS chunk, {_AGG} FROM lines GROUP BY doc_id, chunk")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_lines(document_lines(spark, d), 4, by=["doc_id"])


@query(f"WITH {LINES}, c AS (SELECT *, CAST(sum(CASE WHEN regexp_matches(line, '^(The|Der|La|Le|Los)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY linenum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM lines) SELECT doc_id, chunk, {_AGG} FROM c GROUP BY doc_id, chunk")
def chunk_start(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_start(document_lines(spark, d), "^(The|Der|La|Le|Los)", by=["doc_id"])


@query(f"WITH {LINES}, c AS (SELECT *, CAST(sum(CASE WHEN trim(line) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY linenum ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM lines) SELECT doc_id, chunk, {_AGG} FROM c WHERE trim(line) <> '' GROUP BY doc_id, chunk")
def chunk_delim(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_delimiter(document_lines(spark, d), "", by=["doc_id"])


# -- functions --------------------------------------------------------------------------------------------------


@query("SELECT doc_id, regexp_matches(text, 'the [a-z]+ing') AS found, len(regexp_extract_all(text, '[A-Za-z]+ing')) AS n, regexp_replace(text, '([a-z]+)ing', '<\\1>', 'g') AS replaced FROM documents")
def regex_functions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", fn.regex_match("the [a-z]+ing", "text").alias("found"), F.size(fn.regex_find_all("[A-Za-z]+ing", "text")).cast("long").alias("n"), fn.regex_replace("([a-z]+)ing", "<$1>", "text").alias("replaced"))


def _pattern_query(name: str, of: str, key: str, column: str) -> None:
    pattern = PATTERNS[name][0].replace("'", "''")
    sql = f"SELECT {key}, nullif(regexp_extract({column}, '{pattern}'), '') AS found FROM {of}"
    query(sql, f"extract_{name}_{of}")(lambda spark, d: table(spark, d, of).select(key, extract_pattern(name, column).alias("found")))


for _name in ("num", "version", "gitcommit", "ipv4", "email", "fqdn", "duration", "oauth", "sha1", "jwt"):
    _pattern_query(_name, "documents", "doc_id", "text")
for _name in ("url", "fqdn", "path", "num"):
    _pattern_query(_name, "pages", "page_id", "url")
for _name in ("function", "json"):
    _pattern_query(_name, "pages", "page_id", "html")


@query("SELECT part.p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[-1] AS last, array_to_string(string_split(p_name, ' ')[1:2], '-') AS two FROM part")
def cols_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", fn.cols("p_name", 0).alias("first"), fn.cols("p_name", -1).alias("last"), fn.cols("p_name", "0:2", outsep="-").alias("two"))


@query("SELECT page_id, string_split(url, '/')[3] AS host, coalesce(string_split(url, '/')[9], '') AS missing FROM pages")
def cols_sep(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", fn.cols("url", 2, sep="/").alias("host"), fn.cols("url", 8, sep="/").alias("missing"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.x.y'), 'none') AS missing FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", fn.get_path("k", "props").alias("k"), fn.get_path("x.y", "props", "none").alias("missing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", fn.parse_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey, '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' AS json FROM customer")
def dump_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.dump_json(F.struct("c_custkey", "c_name")).alias("json"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS a, event_type AS b, '' AS c FROM events")
def parse_csv(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", F.col("event_id").cast("string"), F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    record = fn.parse_csv(line, ["a", "b", "c"])
    return events(spark, d).select("event_id", record["a"].alias("a"), record["b"].alias("b"), record["c"].alias("c"))


@query("SELECT event_id, event_id || ';' || event_type AS line FROM events")
def dump_csv(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", fn.dump_csv(F.array(F.col("event_id").cast("string"), "event_type"), ";").alias("line"))


@query("SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS user FROM events")
def parse_kv(spark: SparkSession, d: str) -> DataFrame:
    kv = fn.parse_kv(F.concat(F.lit("type="), F.col("event_type"), F.lit(" junk user="), F.col("user_id").cast("string")))
    return events(spark, d).select("event_id", kv["type"].alias("type"), kv["user"].alias("user"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso, strftime(ts, '%d/%m/%Y %H:%M') AS day, CAST(floor(epoch(ts)) AS BIGINT) + 3600 AS later, 3600 AS diff FROM events")
def timestamps(spark: SparkSession, d: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    df = events(spark, d).withColumn("epoch", fn.parse_ts(text))
    later = fn.ts_add("epoch", F.lit(3600))
    return df.select("event_id", "epoch", fn.format_ts("epoch").alias("iso"), fn.format_ts("epoch", "%d/%m/%Y %H:%M").alias("day"), later.alias("later"), fn.ts_diff(later, "epoch").cast("int").alias("diff"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS apache, CAST(floor(epoch(ts)) AS BIGINT) AS german, CAST(floor(epoch(ts)) AS BIGINT) AS compact, CAST(floor(epoch(ts)) AS BIGINT) AS comma FROM events")
def guess_timestamps(spark: SparkSession, d: str) -> DataFrame:
    forms = {"apache": "dd/MMM/yyyy:HH:mm:ss '+0000'", "german": "dd.MM.yyyy HH:mm:ss", "compact": "yyyyMMdd'T'HHmmss", "comma": "yyyy-MM-dd HH:mm:ss',123'"}
    return events(spark, d).select("event_id", *[fn.guess_ts(F.date_format("ts", p)).alias(n) for n, p in forms.items()])


@query("SELECT event_id, CAST((user_id % 24) * 3600 + (event_id % 60) * 60 AS DOUBLE) AS compact, CAST((user_id % 24) * 3600 + (event_id % 60) * 60 AS DOUBLE) AS spelled FROM events")
def durations(spark: SparkSession, d: str) -> DataFrame:
    h, m = (F.col("user_id") % 24).cast("string"), (F.col("event_id") % 60).cast("string")
    return events(spark, d).select("event_id", fn.parse_duration(F.concat(h, F.lit("h"), m, F.lit("m"))).alias("compact"), fn.parse_duration(F.concat(h, F.lit(" hours "), m, F.lit(" minutes"))).alias("spelled"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def byte_len(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fn.byte_length("text").cast("long").alias("bytes"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS mean, round(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), 'quantile_cont', 0.9), 6) AS p90 FROM embeddings")
def list_functions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(fn.list_sum("embedding"), 6).alias("total"), F.round(fn.list_avg("embedding"), 6).alias("mean"), F.round(fn.list_percentile("embedding", 90), 6).alias("p90"))


@query("SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def percentile_value(spark: SparkSession, d: str) -> DataFrame:
    """Exact, without a type's values in one task: counts by value, running sums in slices, and the two values between which it lies."""
    counts = events(spark, d).where("value is not null").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = ordering.running_total(counts, F.col("n"), "upto", "value", ["event_type"])
    sizes = counts.groupBy("event_type").agg((F.lit(0.95) * (F.sum("n") - 1)).alias("at"))
    near = placed.join(sizes, "event_type")
    low = near.where((F.col("upto") > F.floor("at")) & (F.col("upto") - F.col("n") <= F.floor("at"))).select("event_type", "at", F.col("value").alias("low"))
    high = near.where((F.col("upto") > F.ceil("at")) & (F.col("upto") - F.col("n") <= F.ceil("at"))).select("event_type", F.col("value").alias("high"))
    return low.join(high, "event_type").select("event_type", F.round(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at")), 6).alias("p95"))


@query("SELECT c_custkey, sign(c_acctbal * 10) * floor(abs(c_acctbal * 10) + 0.5) / 10 AS rounded, round(power(c_acctbal, 2), 4) AS squared, abs(c_acctbal) AS absolute FROM customer")
def round_pow_abs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", fn.round_half_up("c_acctbal", 1).alias("rounded"), F.round(fn.power("c_acctbal", 2), 4).alias("squared"), fn.absolute("c_acctbal").alias("absolute"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, replace(p_name, ' ', '_') AS replaced, starts_with(p_type, 'P') AS starts, ends_with(p_type, 'S') AS ends, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS capital, len(string_split(p_name, ' ')) AS n, string_split(p_brand, '#')[1] AS before FROM part")
def string_methods(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("replaced"), F.col("p_type").startswith("P").alias("starts"), F.col("p_type").endswith("S").alias("ends"),
        fn.capitalize("p_type").alias("capital"), (fn.count_of("p_name", " ") + 1).cast("long").alias("n"), fn.partition("p_brand", "#")[0].alias("before"),
    )


@query("""
SELECT p_partkey, array_to_string(list_sort(w), ' ') AS sorted, array_to_string(list_reverse(w), ' ') AS backwards, len(list_distinct(w)) AS different, array_to_string(list_transform(w, lambda x: upper(x)), '+') AS mapped,
  len(list_filter(w, lambda x: length(x) > 4)) AS long, list_contains(w, 'red') AS has_red, list_max(list_transform(w, lambda x: length(x))) AS longest
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
""")
def list_builtins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("w"))
    return Pipeline(rows).derive(sorted="array_join(array_sort(w), ' ')", backwards="array_join(reverse(w), ' ')", different="cast(size(array_distinct(w)) as bigint)", mapped="array_join(transform(w, x -> upper(x)), '+')", long="cast(size(filter(w, x -> length(x) > 4)) as bigint)", has_red="array_contains(w, 'red')", longest="cast(array_max(transform(w, x -> length(x))) as bigint)", w=None).frame


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(event_id AS VARCHAR) || '!' AS s, TRY_CAST(event_type AS DOUBLE) AS none, CAST(value AS BIGINT) >= 0 AS positive, 'type,user' AS keys, event_type AS type, 2 AS n
FROM (SELECT * REPLACE (CAST(trunc(value) AS BIGINT) AS value) FROM events)
""")
def map_and_conversion_builtins(spark: SparkSession, d: str) -> DataFrame:
    made = events(spark, d).withColumn("m", F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")))
    p = Pipeline(made).derive(k="cast(get_json_object(props, '$.k') as bigint)", s="concat(cast(event_id as string), '!')", none="try_cast(event_type as double)", positive="cast(value as bigint) >= 0", keys="array_join(map_keys(m), ',')", type="m['type']", n="size(m)")
    return p.keys(["event_id", "k", "s", "none", "positive", "keys", "type", "n"]).frame


# -- files: written to the shared folder and read back ----------------------------------------------------------


def _files(df: DataFrame, fmt: str) -> str:
    path = f"{shared_folder(df.sparkSession)}/files-{fmt}-{uuid.uuid4().hex}"
    writers.write(df, path, fmt)
    return path


EVENT_FILES = "SELECT event_id, user_id, event_type FROM events"


def _some_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", "user_id", "event_type")


def _typed(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type")


@query(EVENT_FILES)
def files_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _typed(Pipeline.read(spark, _files(_some_events(spark, d), "jsonl"), "jsonl").frame)


@query(EVENT_FILES)
def files_csv(spark: SparkSession, d: str) -> DataFrame:
    return _typed(Pipeline.read(spark, _files(_some_events(spark, d), "csv"), "csv").frame)


@query(EVENT_FILES)
def files_tsv(spark: SparkSession, d: str) -> DataFrame:
    return _typed(Pipeline.read(spark, _files(_some_events(spark, d), "tsv"), "tsv").frame)


@query(EVENT_FILES)
def files_logfmt(spark: SparkSession, d: str) -> DataFrame:
    read = Pipeline.read(spark, _files(_some_events(spark, d), "logfmt"), "logfmt").frame
    return _typed(readers.as_columns(read, names=["event_id", "user_id", "event_type"]))


@query(EVENT_FILES)
def files_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields in no format but blanks; the widest line says how many."""
    read = Pipeline.read(spark, _files(_some_events(spark, d), "fields"), "fields").frame
    return _typed(read.withColumnsRenamed({"f1": "event_id", "f2": "user_id", "f3": "event_type"}))


@query(EVENT_FILES)
def files_lines(spark: SparkSession, d: str) -> DataFrame:
    read = Pipeline.read(spark, _files(_some_events(spark, d), "plain"))
    return read.extract_vars("{event_id:int} {user_id:int} {event_type}").keys(["event_id", "user_id", "event_type"]).frame


@query("SELECT count(*) AS lines, CAST(count(DISTINCT event_id) AS BIGINT) AS different, CAST(count(*) AS BIGINT) AS places FROM events")
def files_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Each line's place within its file is told once."""
    read = Pipeline.read(spark, _files(_some_events(spark, d), "plain")).frame
    return read.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct(F.split("line", " ")[0]).alias("different"), F.count_distinct("FILENAME", "LINENUM").alias("places"))


def _with_place(df: DataFrame, lines: str = "LINENUM") -> DataFrame:
    """df with each line's place in all files, one after another by name: lines of the files before, and its own number."""
    files = df.groupBy("FILENAME").agg(F.max(lines).alias("n"))
    before = files.select(F.col("FILENAME").alias("f"), (F.sum("n").over(Window.orderBy("FILENAME")) - F.col("n")).alias("before"))
    return df.join(F.broadcast(before), F.col("FILENAME") == F.col("f")).withColumn("place", (F.col("before") + F.col(lines)).cast("long")).drop("f", "before")


@query("""
SELECT CAST(1 AS BIGINT) AS place, 'event_id,event_type' AS line
UNION ALL SELECT 1 + row_number() OVER (ORDER BY ts, event_id), event_id || ',' || event_type FROM events
""")
def files_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold the records in order of time, from the first to the last, under one header: each line and its place."""
    path = f"{shared_folder(spark)}/files-ordered-{uuid.uuid4().hex}"
    writers.write(events(spark, d).select("event_id", "event_type", "ts"), path, "csv", order=["ts", "event_id"], drop=["ts"])
    return _with_place(readers.read_lines(spark, path)).select("place", "line")


@query("SELECT event_id, 2 * row_number() OVER (ORDER BY event_id) AS place, 'two' || chr(10) || 'lines, \"' || event_type || '\"' AS note FROM events")
def files_csv_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The line on which each record begins, in CSV files with a header each whose records have two lines each."""
    note = F.concat(F.lit('two\nlines, "'), F.col("event_type"), F.lit('"'))
    path = f"{shared_folder(spark)}/files-csv-{uuid.uuid4().hex}"
    writers.in_order(events(spark, d).select("event_id", note.alias("note")), ["event_id"]).write.options(header=True, escape='"').csv(path)
    read = Pipeline.read(spark, path, "csv").frame
    return _with_place(read.withColumn("own", F.col("LINENUM")), "own").select(F.col("event_id").cast("long").alias("event_id"), "place", "note")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, user_id FROM events")
def files_jsonl_line_numbers(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/files-jsonl-{uuid.uuid4().hex}"
    writers.write(events(spark, d).select("event_id", "user_id"), path, "jsonl", order=["event_id"])
    return _with_place(Pipeline.read(spark, path, "jsonl").frame).select("event_id", "place", "user_id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 10 <> 0")
def files_with_bad_lines(spark: SparkSession, d: str) -> DataFrame:
    """What a format doesn't take is skipped."""
    df = _some_events(spark, d)
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))).otherwise(writers.json_line(df))
    return _typed(Pipeline.read(spark, _files(df.select(line.alias("line")), "line"), "jsonl").frame)


@query("SELECT event_id % 10 = 0 AS rejected, count(*) AS n FROM events GROUP BY 1")
def files_with_rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    df = _some_events(spark, d)
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("no pair "), F.col("event_id").cast("string"))).otherwise(writers.logfmt_line(df))
    read = Pipeline.read(spark, _files(df.select(line.alias("line")), "line"), "logfmt", errors="keep").frame
    return read.groupBy(F.col("rejected").isNotNull().alias("rejected")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 100.0 / event_id AS share FROM events WHERE event_id % 7 <> 0 AND event_id > 3")
def dirty_values(spark: SparkSession, d: str) -> DataFrame:
    """Records whose step raises an error are dropped: no number, and a division by zero."""
    rows = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("x")).when(F.col("event_id") <= 3, F.lit("0")).otherwise(F.col("event_id").cast("string")).alias("line"))
    return Pipeline(rows).derive(share="cast(100 as double) / cast(line as bigint)").filter("share > 0 and event_id > 0").keys(["event_id", "share"]).frame


def _dirty(spark: SparkSession, d: str) -> Pipeline:
    """A line that is no number for each seventh record."""
    rows = events(spark, d).select("event_id", F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_id").cast("string")).alias("line"))
    return Pipeline(rows, order="event_id")


@query("SELECT event_id, sum(event_id) OVER (ORDER BY event_id) AS total FROM events WHERE event_id % 7 <> 0")
def dirty_values_inc(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).inc("total", amount="cast(line as bigint)").keys(["event_id", "total"]).frame


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id <= 2000")
def dirty_values_exit(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).exit("cast(line as bigint) = 2000").keys(["event_id"]).frame


@query("SELECT event_id, CAST(event_id + 1 AS VARCHAR) AS line FROM events WHERE event_id % 7 <> 0")
def dirty_values_emit(spark: SparkSession, d: str) -> DataFrame:
    return _dirty(spark, d).emit("array(cast(cast(line as bigint) + 1 as string))", primary=False).keys(["event_id", "line"]).frame


@query("SELECT event_id, tags FROM (SELECT event_id, event_id % 5 AS tags FROM events) WHERE tags > 2")
def dirty_values_items(spark: SparkSession, d: str) -> DataFrame:
    """Lists of none to four items, of which the third one is asked for."""
    rows = events(spark, d).select("event_id", F.slice(F.array(*[F.lit(i) for i in range(5)]), F.lit(1), (F.col("event_id") % 5).cast("int")).alias("list"))
    return Pipeline(rows).derive(third="list[2]", tags="cast(size(list) as bigint)").keys(["event_id", "tags"]).frame


# -- formats ----------------------------------------------------------------------------------------------------


@query("SELECT 'event_id=' || event_id || ' event_type=' || event_type || ' note=\"a b\" empty=\"\" gone=' AS line FROM events")
def logfmt_line(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).select("event_id", "event_type", F.lit("a b").alias("note"), F.lit("").alias("empty"), F.lit(None).cast("string").alias("gone"))
    return writers.formatted(df, "logfmt")


@query("SELECT event_id || ' ' || event_type AS line FROM events")
def fields_line(spark: SparkSession, d: str) -> DataFrame:
    return writers.formatted(events(spark, d).select("event_id", F.lit(None).cast("string").alias("gone"), "event_type"), "fields")


@query("SELECT event_id || ',' || event_type || ',\"x,\"\"y\"\"\",' AS line FROM events")
def csv_line(spark: SparkSession, d: str) -> DataFrame:
    return writers.formatted(events(spark, d).select("event_id", "event_type", F.lit('x,"y"').alias("q"), F.lit(None).cast("string").alias("gone")), "csv")


@query("SELECT '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS line FROM events")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    return writers.formatted(events(spark, d).select("event_id", "event_type", F.lit(None).cast("string").alias("gone")), "jsonl")


@query("SELECT event_id, event_type AS user_type, CAST(user_id AS BIGINT) AS user_id, event_id AS tags_0, event_id + 1 AS tags_1 FROM events")
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    df = events(spark, d).select("event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("id")).alias("user"), F.array("event_id", F.col("event_id") + 1).alias("tags"))
    flat = records.flatten(df)
    return flat.toDF(*[c.replace(".", "_") for c in flat.columns])


@query("SELECT event_id, event_type AS level, 'said \"' || user_id || '\" twice' AS msg FROM events")
def logfmt_read(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("level="), F.col("event_type"), F.lit(' msg="said \\"'), F.col("user_id").cast("string"), F.lit('\\" twice"'))
    parsed = readers.parse(events(spark, d).select("event_id", line.alias("line")), "logfmt")
    return readers.as_columns(parsed.drop("line"), names=["level", "msg"])


@query("SELECT event_id, event_id % 192 AS pri, CAST(floor((event_id % 192) / 8) AS BIGINT) AS facility, event_id % 8 AS severity, 'h' || user_id AS host, 'app' AS prog, event_id AS pid, event_type || ' seen' AS msg FROM events")
def syslog_read(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 2024-02-01T08:00:00Z h"), F.col("user_id").cast("string"), F.lit(" app "), F.col("event_id").cast("string"), F.lit(" - - "), F.col("event_type"), F.lit(" seen"))
    return readers.parse(events(spark, d).select("event_id", line.alias("line")), "syslog").select("event_id", "pri", F.col("facility").cast("long").alias("facility"), F.col("severity").cast("long").alias("severity"), "host", "prog", "pid", "msg")


@query("SELECT page_id, 'GET' AS method, regexp_extract(url, '://[^/]*(/.*)$', 1) AS path, CAST(200 + page_id % 300 AS BIGINT) AS status, CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id END AS size, url AS referer FROM pages")
def access_log_read(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    path = F.regexp_extract("url", "://[^/]*(/.*)$", 1)
    line = F.concat(F.lit('10.0.0.9 - bob [01/Feb/2024:08:00:00 +0000] "GET '), path, F.lit(' HTTP/1.1" '), (200 + F.col("page_id") % 300).cast("string"), F.lit(" "), F.when(F.col("page_id") % 7 == 0, "-").otherwise(F.col("page_id").cast("string")), F.lit(' "'), F.col("url"), F.lit('" "UA/1"'))
    return readers.parse(pages.select("page_id", line.alias("line")), "combined").select("page_id", "method", "path", "status", "size", "referer")


@query("SELECT event_id, NULL::BIGINT AS pri, 'Feb  ' || (1 + event_id % 9) || ' 08:00:00' AS ts, 'h' || user_id AS host, 'app' AS prog, CASE WHEN event_id % 2 = 0 THEN event_id END AS pid, event_type || ': seen' AS msg FROM events")
def syslog_old_read(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the older kind, without a priority, half of them without a process number."""
    pid = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("Feb  "), (1 + F.col("event_id") % 9).cast("string"), F.lit(" 08:00:00 h"), F.col("user_id").cast("string"), F.lit(" app"), pid, F.lit(": "), F.col("event_type"), F.lit(": seen"))
    return readers.parse(events(spark, d).select("event_id", line.alias("line")), "syslog").select("event_id", "pri", "ts", "host", "prog", "pid", "msg")


@query("""
SELECT event_id, '10.0.0.' || (event_id % 250) AS ip, CASE WHEN event_id % 2 = 0 THEN 'web' END AS host, 'u' || user_id AS "user", CASE WHEN event_id % 2 = 0 THEN 443 END AS port, CASE WHEN event_id % 2 = 0 THEN 'k=' || user_id END AS query, 'POST' AS method, '/' || event_type AS path, 200 AS status,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS size, CASE WHEN event_id % 2 = 0 THEN 'UA' END AS ua, CASE WHEN event_id % 4 = 0 THEN '0.25 0.5' END AS timing
FROM events
""")
def access_log_kinds_read(spark: SparkSession, d: str) -> DataFrame:
    """Extended and common lines in turn."""
    text = lambda c: F.col(c).cast("string")
    size = F.when(F.col("event_id") % 3 == 0, "-").otherwise(text("event_id"))
    ip, request = F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")), F.concat(F.lit('[01/Feb/2024:08:00:00 +0000] "POST /'), F.col("event_type"), F.lit(' HTTP/1.1" '))
    timing = F.when(F.col("event_id") % 4 == 0, " 0.25 0.5").otherwise("")
    extended = F.concat(ip, F.lit(" web - u"), text("user_id"), F.lit(" 443 "), request, F.lit('"k='), text("user_id"), F.lit('" 200 '), size, F.lit(' "-" "UA"'), timing)
    common = F.concat(ip, F.lit(" - u"), text("user_id"), F.lit(" "), request, F.lit("200 "), size)
    lines = events(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, extended).otherwise(common).alias("line"))
    return readers.parse(lines, "combined").select("event_id", "ip", "host", "user", "port", "query", "method", "path", "status", "size", "ua", "timing")


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS f1, string_split(p_name, ' ')[2] AS f2 FROM part")
def fields_read(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse(table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.col("p_name")).alias("line")), "fields", width=2)


@query("SELECT count(*) AS records, min(CAST(event_id AS VARCHAR)) AS first_ts, max(CAST(event_id AS VARCHAR)) AS last_ts, 'level,ts' AS keys, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT lower(event_type) AS t FROM events)) AS levels FROM events")
def stats(spark: SparkSession, d: str) -> DataFrame:
    return records.stats(events(spark, d).select(F.col("event_id").cast("string").alias("ts"), F.upper("event_type").alias("level")))


# -- extensions -------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'other' END AS class FROM events")
def lookup_constant(spark: SparkSession, d: str) -> DataFrame:
    return records.lookup(events(spark, d), {"error": "bad", "purchase": "good"}, "event_type", "class", "other").select("event_id", "class")


@query("SELECT n_name, r_name, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def join_lookup(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("suppliers"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_type", "user_id").distinct()


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def top_by_type(spark: SparkSession, d: str) -> DataFrame:
    """The three largest values of each type; Spark limits each task's groups before the exchange, and salted groups once more."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "event_id"))
    some = events(spark, d).select("event_type", "event_id", "value").withColumn("salt", F.col("event_id") % 64)
    best = some.withColumn("n", rank("event_type", "salt")).where("n <= 3").drop("n")
    return best.withColumn("n", rank("event_type")).where("n <= 3").select("event_type", "event_id", "value")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(sum(CASE WHEN value IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n, GROUPING(event_type) AS total FROM events GROUP BY ROLLUP (event_type)")
def rollup_types(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).rollup("event_type").agg(F.count("value").alias("n"), F.grouping("event_type").cast("long").alias("total"))


@query("SELECT o_orderkey AS id, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def union_tables(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind")).unionByName(c.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


# -- joins by order, sessions ------------------------------------------------------------------------------------


@query("""
WITH met AS (
  SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id, v.value AS view_value, row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) AS n
  FROM events p LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = p.user_id AND v.ts <= p.ts AND p.ts - v.ts <= INTERVAL 12 HOUR
  WHERE p.event_type = 'purchase'
)
SELECT event_id, user_id, view_id, view_value FROM met WHERE n = 1
""")
def asof_purchase_view(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's last view of the twelve hours before it."""
    of = events(spark, d)
    views = of.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("value").alias("view_value"), "ts", "user_id")
    joined = joins.asof_join(of.where("event_type = 'purchase'"), views, "ts", by=["user_id"], tolerance=12 * 3600)
    return joined.select("event_id", "user_id", "view_id", "view_value")


@query("""
WITH met AS (
  SELECT c.event_id, e.event_id AS error_id, row_number() OVER (PARTITION BY c.event_id ORDER BY abs(epoch_us(e.ts) - epoch_us(c.ts)), e.ts, e.event_id DESC) AS n
  FROM (SELECT * FROM events WHERE event_type = 'click') c JOIN (SELECT * FROM events WHERE event_type = 'error') e ON e.ts BETWEEN c.ts - INTERVAL 6 HOUR AND c.ts + INTERVAL 6 HOUR
)
SELECT c.event_id, error_id FROM events c LEFT JOIN met ON met.event_id = c.event_id AND n = 1 WHERE c.event_type = 'click'
""")
def asof_nearest_error(spark: SparkSession, d: str) -> DataFrame:
    """Each click with the nearest error of anyone, at most six hours away."""
    of = events(spark, d)
    errors = of.where("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("ts").alias("error_ts"))
    return joins.asof_join(of.where("event_type = 'click'").select("event_id", "ts"), errors, "ts", "error_ts", tolerance=6 * 3600, direction="nearest").select("event_id", "error_id")


SPANS = "spans AS (SELECT event_id, user_id, event_type, ts AS start, ts + to_microseconds(CAST(round(value * 60000000) AS BIGINT)) AS stop FROM events)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    """Each event lasts as many minutes as its value says."""
    of = events(spark, d)
    return of.select("event_id", "user_id", "event_type", F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60_000_000).cast("long")).alias("stop"))


@query(f"WITH {SPANS} SELECT p.event_id AS purchase_id, e.event_id AS error_id, epoch_us(least(p.stop, e.stop)) - epoch_us(greatest(p.start, e.start)) AS shared_us FROM spans p JOIN spans e ON p.start <= e.stop AND e.start <= p.stop WHERE p.event_type = 'purchase' AND e.event_type = 'error'")
def overlapping_spans(spark: SparkSession, d: str) -> DataFrame:
    """Purchases and errors that last at the same time, and for how long."""
    of = _spans(spark, d).drop("user_id")
    pairs = joins.interval_join(of.where("event_type = 'purchase'"), of.where("event_type = 'error'"), ("start", "stop"))
    shared = F.unix_micros(F.least("stop", "stop_right").cast("timestamp")) - F.unix_micros(F.greatest("start", "start_right").cast("timestamp"))
    return pairs.select(F.col("event_id").alias("purchase_id"), F.col("event_id_right").alias("error_id"), shared.alias("shared_us"))


@query(f"WITH {SPANS} SELECT a.event_id AS first_id, b.event_id AS second_id, a.user_id FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.start < b.stop AND b.start < a.stop AND a.event_id < b.event_id")
def overlapping_spans_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Events of one user that overlap, each pair once."""
    of = _spans(spark, d).drop("event_type")
    pairs = joins.interval_join(of, of, ("start", "stop"), by=["user_id"], closed=False)
    return pairs.where("event_id < event_id_right").select(F.col("event_id").alias("first_id"), F.col("event_id_right").alias("second_id"), "user_id")


@query(f"WITH {SPANS} SELECT event_id FROM spans p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM spans e WHERE e.event_type = 'error' AND e.start BETWEEN p.start AND p.stop)")
def spans_without_errors(spark: SparkSession, d: str) -> DataFrame:
    """Purchases during which no error comes: spans and points."""
    of = _spans(spark, d)
    errors = of.where("event_type = 'error'").select(F.col("start").alias("at"))
    return joins.interval_join(of.where("event_type = 'purchase'"), errors, ("start", "stop"), ("at", "at"), how="anti", key=["event_id"]).select("event_id")


SESSIONS = """
marked AS (SELECT event_id, user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 8 HOUR THEN 0 ELSE 1 END AS begins FROM events),
numbered AS (SELECT *, CAST(sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_no FROM marked)
"""


@query(f"WITH {SESSIONS} SELECT user_id, session_no, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, session_no")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's sessions, which eight hours without an event part."""
    return sessions.sessions(events(spark, d), "ts", 8 * 3600, ["user_id"], total=F.round(F.sum("value"), 2))


@query(f"WITH {SESSIONS} SELECT event_id, user_id, session_no FROM numbered")
def session_numbers(spark: SparkSession, d: str) -> DataFrame:
    return sessions.sessionize(events(spark, d), "ts", 8 * 3600, ["user_id"]).select("event_id", "user_id", "session_no")


# -- sketches: of each day and type, stored, and merged for coarser groups ---------------------------------------


def _daily(spark: SparkSession, d: str, **of: sketches.Sketch) -> DataFrame:
    """A stored table of sketches by day and type."""
    path = f"{shared_folder(spark)}/files-sketches-{uuid.uuid4().hex}"
    sketches.sketched(events(spark, d).withColumn("day", F.to_date("ts")), ["day", "event_type"], **of).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT event_type, count(*) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, true AS near_it FROM events GROUP BY event_type UNION ALL SELECT NULL, count(*), CAST(count(DISTINCT user_id) AS BIGINT), true FROM events")
def sketch_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    """Users of each type and in all, merged from those of days: whether the estimate is within three standard errors of the count."""
    of = {"users": sketches.Distinct("user_id")}
    daily = _daily(spark, d, **of)
    both = sketches.merged(daily, ["event_type"], **of).unionByName(sketches.merged(daily, [], **of), allowMissingColumns=True)
    found = sketches.estimated(both, **of).withColumnsRenamed({"users": "estimate", "event_type": "kind"})
    exact = events(spark, d).rollup("event_type").agg(F.count_distinct("user_id").alias("users"))
    return found.join(exact, F.col("kind").eqNullSafe(F.col("event_type"))).select("event_type", "n", "users", (F.abs(F.col("estimate") - F.col("users")) <= 3 * of["users"].error * F.col("users")).alias("near_it"))


@query("SELECT event_type, CAST(q AS DOUBLE) AS q, true AS near_it FROM (SELECT DISTINCT event_type FROM events), (VALUES (0.5), (0.9), (0.99)) AS t(q)")
def sketch_value_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of each type's values, merged from those of days: whether the share of values up to each is right within the error."""
    of = {"values": sketches.Quantiles("value")}
    found = sketches.estimated(sketches.merged(_daily(spark, d, **of), ["event_type"], **of), **of)
    wanted = found.select(F.col("event_type").alias("kind"), F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in of["values"].at]).alias("q"), F.col("values").alias("v"))).alias("x")).select("kind", "x.q", "x.v")
    shares = events(spark, d).join(wanted, F.col("event_type") == F.col("kind")).groupBy("event_type", "q").agg(F.avg((F.col("value") <= F.col("v")).cast("int")).alias("upto"), F.avg((F.col("value") < F.col("v")).cast("int")).alias("under"))
    error = of["values"].error
    return shares.select("event_type", F.col("q").cast("double").alias("q"), ((F.col("under") - error <= F.col("q")) & (F.col("q") <= F.col("upto") + error)).alias("near_it"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_both, true AS near_it, true AS rest_near FROM (SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'error')")
def sketch_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Users who purchase and have errors, and who purchase and have none, from stored sets."""
    of = {"users": sketches.Members("user_id")}
    sets = sketches.merged(_daily(spark, d, **of), ["event_type"], **of)
    bought, failed = (sets.where(F.col("event_type") == kind).select(F.col("users").alias(kind)) for kind in ("purchase", "error"))
    kinds = events(spark, d).groupBy("user_id").agg(F.max((F.col("event_type") == "purchase").cast("long")).alias("b"), F.max((F.col("event_type") == "error").cast("long")).alias("f"))
    exact = kinds.agg(F.sum(F.col("b") * F.col("f")).alias("n_both"), F.sum(F.col("b") * (1 - F.col("f"))).alias("rest"), F.count_if((F.col("b") + F.col("f")) > 0).alias("either"))
    near = lambda estimate, n: (F.abs(estimate - F.col(n)) <= 3 * of["users"].error * F.col("either"))
    one = lambda df: df.withColumn("one", F.lit(1))
    joined = one(exact).join(one(bought), "one").join(one(failed), "one")
    return joined.select("n_both", near(sketches.common_members(F.col("purchase"), F.col("error")), "n_both").alias("near_it"), near(sketches.members_without(F.col("purchase"), F.col("error")), "rest").alias("rest_near"))


# -- folds and reports --------------------------------------------------------------------------------------------


@query("SELECT user_id % 16 AS file, event_type, CAST(date_part('hour', ts) AS VARCHAR) AS hour, count(*) AS n FROM events GROUP BY ALL")
def fold_nested_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters in maps in maps, for each of a few files, as the footer of each, and then as rows."""
    rows = events(spark, d).select((F.col("user_id") % 16).alias("FILENAME"), "event_id", "event_type", F.hour("ts").alias("hour"))
    footer = Pipeline(rows, order="event_id", by=("FILENAME",)).fold(folds.counters("event_type", "hour"), "map<string,map<string,bigint>>", ["event_type", "hour"]).result().where("part = 2")
    by_type = footer.select(F.col("FILENAME").alias("file"), F.explode("state").alias("event_type", "hours"))
    return by_type.select("file", "event_type", F.explode("hours").alias("hour", "n"))


@query("SELECT event_type, count(*) AS n, max(value) AS largest, max_by(event_id, (value, -event_id)) AS event_id FROM events WHERE value IS NOT NULL GROUP BY event_type")
def fold_largest(spark: SparkSession, d: str) -> DataFrame:
    """A fold with a result of its own: the number of records and the record of the largest value."""
    better = lambda a, b: a if b["event_id"] is None or (a["event_id"] is not None and (a["value"], -a["event_id"]) >= (b["value"], -b["event_id"])) else b
    fold = folds.Fold(lambda: {"n": 0, "value": None, "event_id": None}, lambda s, r: better(s, r) | {"n": s["n"] + 1}, lambda a, b: better(a, b) | {"n": a["n"] + b["n"]}, lambda s: {"n": s["n"], "largest": s["value"], "event_id": s["event_id"]})
    return folds.folded(events(spark, d).where("value is not null"), fold, "n bigint, largest double, event_id bigint", ["event_type"], ["event_id", "value"]).select("event_type", "state.*")


@query("""
WITH e AS (SELECT *, event_id % 7 = 0 AS bad FROM events), f AS (SELECT * FROM e WHERE event_type <> 'view'),
n AS (SELECT (SELECT count(*) FROM e) AS n_e, (SELECT count(*) FROM f) AS n_f, (SELECT count(*) FROM f WHERE bad) AS bad, (SELECT count(*) FROM f WHERE NOT bad AND event_type = 'error') AS errors, (SELECT count(*) FROM f WHERE NOT bad AND event_type = 'error' AND user_id % 2 = 0) AS even)
SELECT 1 AS place, 'input' AS step, n_e AS came, CAST(0 AS BIGINT) AS dropped, CAST(0 AS BIGINT) AS wrong, n_e AS remained FROM n
UNION ALL SELECT 2, 'filter', n_e, n_e - n_f, 0, n_f FROM n
UNION ALL SELECT 3, 'derive', n_f, 0, bad, n_f - bad FROM n
UNION ALL SELECT 4, 'levels', n_f - bad, n_f - bad - errors, 0, errors FROM n
UNION ALL SELECT 5, 'emit', errors, -errors, 0, 2 * errors FROM n
UNION ALL SELECT 6, 'skip', 2 * errors, 2 * even, 0, 2 * (errors - even) FROM n
""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    """A run's records by step: those that came, went, were wrong and left."""
    rows = events(spark, d).select("event_id", "user_id", F.col("event_type").alias("level"), F.when(F.col("event_id") % 7 == 0, "x").otherwise("1").alias("line"))
    p = Pipeline(rows, order="event_id").reported().filter("level <> 'view'").derive(n="cast(line as int)").levels(include=["error"]).emit("array(line)", primary=True).skip("user_id % 2 = 0")
    return p.write(f"{shared_folder(spark)}/files-report-{uuid.uuid4().hex}", "jsonl").report.frame(spark)


# -- functions of one's own ---------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross, CASE WHEN l_quantity >= 25 THEN 'large' ELSE 'small' END AS size, part, l_quantity * part / 3 AS share FROM lineitem, (VALUES (1), (2)) AS t(part) WHERE l_returnflag = 'R'")
def own_functions(spark: SparkSession, d: str) -> DataFrame:
    """SQL functions of one's own in steps, one of which replaces an earlier one, and a table function of two rows a record."""
    own.define(
        spark, "loglattice_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price", "loglattice_size(n DOUBLE) RETURNS STRING RETURN CASE WHEN n >= 25 THEN 'large' ELSE 'small' END",
        "loglattice_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)", "loglattice_thirds(n DOUBLE) RETURNS TABLE (part INT, share DOUBLE) RETURN SELECT part, n * part / 3 AS share FROM explode(array(1, 2)) AS t(part)",
    )
    lines = Pipeline(table(spark, d, "lineitem")).filter("l_returnflag = 'R'").derive(gross="loglattice_net(l_extendedprice, l_discount) * (1 + l_tax)", size="loglattice_size(l_quantity)")
    lines.keys(["l_orderkey", "l_linenumber", "gross", "size", "l_quantity"]).frame.createOrReplaceTempView("loglattice_lines")
    return spark.sql("SELECT l_orderkey, l_linenumber, gross, size, part, share FROM loglattice_lines, LATERAL loglattice_thirds(l_quantity)")


class _Runs:
    """Runs of one type of events: the first one's id, and how many."""

    def __init__(self):
        self.run = None

    def eval(self, row):
        if self.run and self.run[1] == row["event_type"]:
            self.run[3] += 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["user_id"], row["event_type"], row["event_id"], 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


@query("""
WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS begins FROM events),
r AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY user_id, event_type, run
""")
def table_function_by_user(spark: SparkSession, d: str) -> DataFrame:
    """Each user's runs of events of one type, by a table function that sees a user's events in order."""
    runs = F.udtf(_Runs, returnType="user_id long, event_type string, first_id long, n long")
    return own.by_groups(events(spark, d).select("user_id", "event_id", "event_type"), runs, ["user_id"], ["event_id"])
