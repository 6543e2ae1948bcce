"""Queries: intake shapes, profiles, descriptive and inferential statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.functions.coerce import to_day, to_number
from gaugeworks.functions.joins import union_all
from gaugeworks.operators import compare, correlation, describe, findings, normalize, profile, shape, trend
from gaugeworks.plans.registry import chi2_p_sql, f_p_sql, query, t_p_sql, table, z_p_sql

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
STAT_COLUMNS = "mean median std_dev min max"
LINE_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _stats_sql(source: str, key: str, value: str, zero_std: bool = True) -> str:
    std = f"stddev_samp({value})"
    std = f"coalesce({std}, 0.0)" if zero_std else std
    return (
        f"SELECT {key}, count({value}) AS n, avg({value}) AS mean, quantile_cont({value}, 0.5) AS median, "
        f"{std} AS std_dev, min({value}) AS min, max({value}) AS max FROM {source} GROUP BY ALL"
    )


# Intake shapes.


@query("survey_rows", """
    SELECT CAST(1 AS BIGINT) AS dataset_id, CAST(NULL AS DATE) AS response_date, CAST(NULL AS VARCHAR) AS question,
           text AS response_text FROM documents""")
def survey_rows(spark, sf):
    return normalize.survey_rows(table(spark, sf, "documents"), 1)


@query("usage_rows", """
    SELECT CAST(2 AS BIGINT) AS dataset_id, CAST(ts AS DATE) AS date, event_type AS metric_name, value AS metric_value,
           '' AS category FROM events""", "metric_value")
def usage_rows(spark, sf):
    events = table(spark, sf, "events").select("ts", F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"))
    return normalize.usage_rows(events.withColumnRenamed("ts", "timestamp"), 2)


@query("circulation_rows", """
    SELECT CAST(3 AS BIGINT) AS dataset_id, CAST(l_shipdate AS DATE) AS date, l_returnflag AS metric_name,
           l_linestatus AS category, CAST(count(*) AS DOUBLE) AS metric_value FROM lineitem GROUP BY ALL""", "metric_value")
def circulation_rows(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_shipdate").alias("checkout_date"), F.col("l_returnflag").alias("material_type"),
        F.col("l_linestatus").alias("patron_type"),
    )
    return normalize.circulation_rows(rows, 3, pre_aggregate=True)


def _pivot_sql(total: str = "sum(value)") -> str:
    kinds = ("click", "error", "purchase", "signup", "view")
    cells = ", ".join(f"{total} FILTER (event_type = '{k}') AS \"{k}\"" for k in kinds)
    return f"SELECT CAST(ts AS DATE) AS date, {cells} FROM events GROUP BY ALL"


@query("pivot_daily_metrics", _pivot_sql(), "click error purchase signup view")
def pivot_daily_metrics(spark, sf):
    events = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return normalize.analysis_frame(
        events, "date", "event_type", "value", metrics=["click", "error", "purchase", "signup", "view"]
    )


@query("unpivot_periods", """
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, 'events' AS metric_name, sum(value) AS metric_value,
           event_type AS category FROM events GROUP BY ALL""", "metric_value")
def unpivot_periods(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    wide = events.groupBy(F.col("event_type").alias("Title"), F.lit("events").alias("Metric Type")).pivot("day").agg(F.sum("value"))
    return normalize.unpivot_periods(wide).where(F.col("metric_value").isNotNull())


@query("coerced_values", """
    SELECT event_type, count(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS numbers,
           count(TRY_CAST(event_type AS DOUBLE)) AS words_as_numbers,
           max(CAST(ts AS DATE)) AS last_day FROM events GROUP BY ALL""")
def coerced_values(spark, sf):
    events = table(spark, sf, "events")
    return events.groupBy("event_type").agg(
        F.count(to_number(F.get_json_object("props", "$.k"))).alias("numbers"),
        F.count(to_number("event_type")).alias("words_as_numbers"),
        F.max(to_day(F.date_format("ts", "yyyy/MM/dd"))).alias("last_day"),
    )


@query("validation", """
    SELECT 'missing_column' AS rule, c AS "column", 'expected columns: date, metric_name, metric_value' AS message
    FROM (VALUES ('date'), ('metric_name'), ('metric_value')) AS v(c) WHERE (SELECT count(*) FROM orders) > 0""")
def validation(spark, sf):
    from gaugeworks.sources.intake import validate

    return validate(table(spark, sf, "orders"), "usage")


@query("metadata_suggestions", """
    SELECT 'My Orders' AS title,
           'General usage statistics dataset with ' || format('{:,}', count(*)) || ' records and 6 fields. Includes date/time fields (o_orderdate) covering '
           || CAST(min(CAST(o_orderdate AS DATE)) AS VARCHAR) || ' to ' || CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR)
           || '. Contains numeric measures such as o_orderkey, o_custkey, o_totalprice.' AS description,
           'Data Import Hub' AS source, 'usage,category,date-time,numeric-measure' AS keywords FROM orders""")
def metadata_suggestions(spark, sf):
    row = profile.metadata_suggestions(table(spark, sf, "orders"), "usage", "my_orders.csv")
    return row.withColumn("keywords", F.array_join("keywords", ","))


# Profiles.


def _dictionary_sql(source: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for i, (name, kind, role) in enumerate(columns):
        text = f"CAST({name} AS VARCHAR)"
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{name}' AS \"column\", '{kind}' AS type, '{role}' AS role, "
            f"count(*) - count({name}) AS missing_count, round((count(*) - count({name})) * 100.0 / count(*), 2) AS missing_pct, "
            f"count(DISTINCT {name}) AS unique_count, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {text} AS v FROM {source} "
            f"WHERE {name} IS NOT NULL ORDER BY v LIMIT 3)) AS examples FROM {source}"
        )
    return " UNION ALL ".join(parts)


@query("data_dictionary", _dictionary_sql("customer", [
    ("c_custkey", "number", "numeric measure"), ("c_name", "text", "descriptor"),
    ("c_nationkey", "number", "numeric measure"), ("c_acctbal", "number", "numeric measure"),
    ("c_mktsegment", "text", "category"),
]), "missing_pct")
def data_dictionary(spark, sf):
    return profile.data_dictionary(table(spark, sf, "customer")).withColumn("examples", F.array_join("examples", "|"))


@query("coded_missing", """
    SELECT 'p_size' AS "column", avg(CASE WHEN p_size = 7 THEN 1.0 ELSE 0.0 END) AS rate FROM part""", "rate")
def coded_missing(spark, sf):
    part = table(spark, sf, "part")
    coded = part.withColumn("p_size", F.when(F.col("p_size") == 7, F.lit(-666)).otherwise(F.col("p_size")))
    return profile.coded_missing_rates(coded)


@query("top_values", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL ORDER BY n DESC, value LIMIT 8")
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "documents"), "lang")


def _edge_sql() -> str:
    numeric = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    names = (*numeric, "l_returnflag", "l_linestatus", "l_shipdate")
    parts = []
    for i, c in enumerate(names):
        kind = "number" if c in numeric else "datetime" if c == "l_shipdate" else "text"
        if c in numeric:
            out = (
                f"(SELECT count(*) FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM lineitem) "
                f"WHERE b <> a AND ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)))"
            )
        else:
            out = "CAST(NULL AS BIGINT)"
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{kind}' AS type, "
            f"round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, true AS trend_ready, {out} AS outliers FROM lineitem"
        )
    return " UNION ALL ".join(parts)


@query("edge_cases", _edge_sql(), "missing_pct")
def edge_cases(spark, sf):
    return profile.numeric_edge_cases(table(spark, sf, "lineitem"))


# A registry derived from the documents: each source is a dataset.

REGISTRY_SQL = """
    SELECT CAST(substr(source, 4) AS BIGINT) AS dataset_id, source AS name, 'survey' AS dataset_type, count(*) AS row_count,
           upper(source) AS title, CASE WHEN avg(n_chars) > 2400 THEN max(lang) END AS description, source AS source,
           CASE WHEN max(n_chars) > 15000 THEN 'long texts' END AS usage_notes, min(lang) AS ethical_considerations,
           CASE WHEN max(n_chars) > 20000 THEN 'completed' WHEN min(n_chars) < 40 THEN 'failed' END AS indexing_status
    FROM documents GROUP BY source"""


def registry_frame(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("row_count"), F.avg("n_chars").alias("_avg"), F.max("n_chars").alias("_max"),
        F.min("n_chars").alias("_min"), F.max("lang").alias("_lang"), F.min("lang").alias("ethical_considerations"),
    ).select(
        F.substring("source", 4, 20).cast("long").alias("dataset_id"), F.col("source").alias("name"),
        F.lit("survey").alias("dataset_type"), "row_count", F.upper("source").alias("title"),
        F.when(F.col("_avg") > 2400, F.col("_lang")).alias("description"), "source",
        F.when(F.col("_max") > 15000, "long texts").alias("usage_notes"), "ethical_considerations",
        F.when(F.col("_max") > 20000, "completed").when(F.col("_min") < 40, "failed").alias("indexing_status"),
    )


@query("metadata_gaps", f"""
    SELECT dataset_id, name, dataset_type, CASE WHEN gaps = '' THEN 'complete' ELSE gaps END AS missing_fields FROM (
        SELECT *, concat_ws(', ', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN description IS NULL THEN 'description' END,
                            CASE WHEN source IS NULL THEN 'source' END, CASE WHEN usage_notes IS NULL THEN 'usage_notes' END,
                            CASE WHEN ethical_considerations IS NULL THEN 'ethical_considerations' END) AS gaps
        FROM ({REGISTRY_SQL}))""")
def metadata_gaps(spark, sf):
    return profile.metadata_gaps(registry_frame(spark, sf))


@query("registry_rollup", f"""
    SELECT count(*) AS datasets, count(*) FILTER (indexing_status = 'completed') AS ready,
           count(*) FILTER (indexing_status = 'failed') AS failed, count(*) FILTER (indexing_status IS NULL) AS pending,
           count(*) FILTER (description IS NULL) AS metadata_gaps,
           count(*) FILTER (indexing_status IS NULL OR indexing_status <> 'completed') AS unindexed FROM ({REGISTRY_SQL})""")
def registry_rollup(spark, sf):
    return profile.registry_rollup(registry_frame(spark, sf))


# Descriptive statistics.


@query("usage_stats", _stats_sql("events", "event_type AS metric_name", "value"), STAT_COLUMNS)
def usage_stats(spark, sf):
    return describe.usage_statistics(
        table(spark, sf, "events").select(F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"))
    )


@query("category_counts", "SELECT event_type AS category, count(*) AS n FROM events WHERE event_type <> '' GROUP BY ALL")
def category_counts(spark, sf):
    return describe.category_counts(table(spark, sf, "events").withColumnRenamed("event_type", "category"))


@query("survey_stats", _stats_sql(
    "(SELECT lang, CAST(length(text) AS DOUBLE) AS x FROM documents WHERE text <> '')", "lang, 'response_length' AS measure", "x"
), STAT_COLUMNS)
def survey_stats(spark, sf):
    return describe.survey_statistics(table(spark, sf, "documents"), "text", by=("lang",))


@query("column_stats", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count({c}) AS n, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, "
    f"stddev_samp({c}) AS std_dev, min({c}) AS min, max({c}) AS max FROM lineitem" for c in LINE_NUMBERS
), STAT_COLUMNS, mean=9)
def column_stats(spark, sf):
    return describe.column_statistics(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("group_stats", _stats_sql("orders", "o_orderpriority", "o_totalprice", False), STAT_COLUMNS, mean=4, std_dev=4)
def group_stats(spark, sf):
    return describe.group_statistics(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("chart_sum_by_key", "SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL", "total")
def chart_sum_by_key(spark, sf):
    return describe.chart_sums(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity")


@query("chart_count_by_key", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY ALL")
def chart_count_by_key(spark, sf):
    return describe.chart_sums(table(spark, sf, "part"), "p_brand", "p_type")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_counts(spark, sf):
    return describe.table_counts({t: table(spark, sf, t) for t in TABLES})


_MERGE_ROWS = """
    SELECT 1 AS dataset_id, o_orderstatus AS metric_name, o_totalprice AS v FROM orders
    UNION ALL SELECT 2, l_linestatus, l_extendedprice FROM lineitem
    UNION ALL SELECT 2, l_returnflag, l_extendedprice FROM lineitem"""


@query("merged_statistics", f"""
    SELECT metric_name, dataset_id, n, mean, median FROM (
        SELECT CAST(dataset_id AS INTEGER) AS dataset_id, metric_name, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median,
               row_number() OVER (PARTITION BY metric_name ORDER BY dataset_id) AS r
        FROM ({_MERGE_ROWS}) GROUP BY dataset_id, metric_name) WHERE r = 1""", "mean median", mean=4)
def merged_statistics(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    rows = union_all([
        orders.select(F.lit(1).alias("dataset_id"), F.col("o_orderstatus").alias("metric_name"), F.col("o_totalprice").alias("metric_value")),
        lines.select(F.lit(2).alias("dataset_id"), F.explode(F.array("l_linestatus", "l_returnflag")).alias("metric_name"), F.col("l_extendedprice").alias("metric_value")),
    ])
    stats = describe.usage_statistics(rows, by=("dataset_id",)).select("dataset_id", "metric_name", "n", "mean", "median")
    datasets = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("row_count")).select(
        "dataset_id", F.concat(F.lit("dataset "), F.col("dataset_id").cast("string")).alias("name"), F.lit("usage").alias("dataset_type"), "row_count"
    )
    _, merged = describe.merge_summaries(datasets, stats)
    return merged


@query("merged_header", f"""
    SELECT string_agg(name, ', ' ORDER BY dataset_id) AS dataset_name, 'multiple' AS dataset_type, CAST(sum(row_count) AS BIGINT) AS row_count
    FROM ({REGISTRY_SQL})""")
def merged_header(spark, sf):
    registry = registry_frame(spark, sf)
    header, _ = describe.merge_summaries(registry, registry.select("dataset_id", F.col("name").alias("metric_name")))
    return header


@query("benchmark_rank", """
    SELECT s_name AS institution, s_acctbal AS metric_value, CAST(1 AS BIGINT) AS copies, r AS rank, round((1 - (r - 1) / greatest(n - 1, 1)) * 100, 1) AS percentile
    FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS r, count(*) OVER () AS n FROM supplier)""",
    "metric_value percentile")
def benchmark_rank(spark, sf):
    return describe.benchmark_ranking(table(spark, sf, "supplier"), "s_name", "s_acctbal")


@query("benchmark_by_nation", """
    SELECT c_nationkey, c_name AS institution, c_acctbal AS metric_value, CAST(1 AS BIGINT) AS copies, r AS rank, round((1 - (r - 1) / greatest(n - 1, 1)) * 100, 1) AS percentile
    FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS r,
                 count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""", "metric_value percentile")
def benchmark_by_nation(spark, sf):
    return describe.benchmark_ranking(table(spark, sf, "customer"), "c_name", "c_acctbal", by=("c_nationkey",))


@query("benchmark_summary", """
    SELECT count(s_acctbal) AS n, avg(s_acctbal) AS mean, quantile_cont(s_acctbal, 0.5) AS median, min(s_acctbal) AS min, max(s_acctbal) AS max,
           (SELECT r FROM (SELECT s_name, row_number() OVER (ORDER BY s_acctbal DESC, s_name) AS r FROM supplier)
            WHERE lower(s_name) = 'supplier#000000003') AS target_rank FROM supplier""", "mean median min max")
def benchmark_summary(spark, sf):
    row = describe.benchmark_summary(table(spark, sf, "supplier"), "s_name", "s_acctbal", "SUPPLIER#000000003")
    return row.withColumn("target_rank", F.col("target.rank")).drop("target")


@query("top_performers", """
    SELECT s_name AS institution, s_acctbal AS metric_value FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 5""", "metric_value")
def top_performers(spark, sf):
    return describe.top_performers(table(spark, sf, "supplier"), "s_name", "s_acctbal")


# Time series.

SERIES = "SELECT event_type, CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY ALL"
PLACED = f"SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date) - 1 AS x FROM ({SERIES})"
FIT = f"""
    SELECT event_type, count(*) AS n, avg(value) AS mean, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept,
           regr_r2(value, x) AS r_squared, regr_syy(value, x) AS syy, min(date) AS start_date, max(date) AS end_date
    FROM ({PLACED}) GROUP BY event_type"""
DIRECTION = "CASE WHEN abs(slope) / abs(mean) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END"


def _events(spark, sf):
    return table(spark, sf, "events")


@query("trend_fit", f"""
    SELECT event_type, n, slope, intercept, r_squared, {DIRECTION} AS direction, start_date, end_date, 'ok' AS status FROM ({FIT})""",
    "slope intercept r_squared")
def trend_fit(spark, sf):
    return trend.trend_fit(_events(spark, sf), "ts", "value", ["event_type"])


@query("trend_orders", """
    SELECT n, slope, intercept, r_squared, CASE WHEN abs(slope) / abs(mean) < 0.001 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction,
           start_date, end_date, 'ok' AS status FROM (
        SELECT count(*) AS n, avg(v) AS mean, regr_slope(v, x) AS slope, regr_intercept(v, x) AS intercept, regr_r2(v, x) AS r_squared,
               min(d) AS start_date, max(d) AS end_date FROM (
            SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS x FROM (
                SELECT CAST(o_orderdate AS DATE) AS d, sum(o_totalprice) AS v FROM orders GROUP BY ALL)))""",
    "slope intercept r_squared", slope=3, intercept=2)
def trend_orders(spark, sf):
    return trend.trend_fit(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def _moving(size: int) -> str:
    over = f"OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(value) {over} = {size} THEN avg(value) {over} END AS moving_average_{size}"


@query("moving_avg", f"SELECT event_type, date, value, {_moving(7)}, {_moving(30)} FROM ({SERIES})", "value moving_average_7 moving_average_30")
def moving_avg(spark, sf):
    return trend.moving_averages(_events(spark, sf), "ts", "value", ["event_type"])


ACF = f"""
    SELECT a.event_type, any_value(a.n) AS n, CAST(k.lag AS INTEGER) AS lag, sum(a.d * b.d) / any_value(a.s) AS acf
    FROM (SELECT *, count(*) OVER w AS n, sum(d * d) OVER w AS s FROM (
              SELECT event_type, x, value - avg(value) OVER (PARTITION BY event_type) AS d FROM ({PLACED}))
          WINDOW w AS (PARTITION BY event_type)) a
    CROSS JOIN (SELECT unnest(range(0, 31)) AS lag) k
    JOIN (SELECT event_type, x, value - avg(value) OVER (PARTITION BY event_type) AS d FROM ({PLACED})) b
      ON a.event_type = b.event_type AND b.x = a.x + k.lag
    WHERE a.n >= 20 AND k.lag <= least(floor(a.n / 4), 30) GROUP BY a.event_type, k.lag"""


@query("acf", ACF, "acf")
def acf(spark, sf):
    return trend.autocorrelation(_events(spark, sf), "ts", "value", ["event_type"])


@query("seasonality", f"""
    SELECT event_type, any_value(n) AS n, coalesce(bool_or((lag IN (7, 14) OR (lag = 30 AND n >= 30)) AND abs(acf) > 2 / sqrt(n)), false) AS seasonal_pattern
    FROM ({ACF}) GROUP BY event_type""")
def seasonality(spark, sf):
    return trend.seasonality(_events(spark, sf), "ts", "value", ["event_type"])


@query("forecast", f"""
    SELECT event_type, CAST(k.step AS INTEGER) AS step, intercept + slope * (n - 1 + k.step) AS forecast,
           sqrt((syy - slope * slope * n * (n * n - 1) / 12.0) / (n - 2)) AS residual_error
    FROM ({FIT}) CROSS JOIN (SELECT unnest(range(1, 8)) AS step) k""", "forecast residual_error")
def forecast(spark, sf):
    return trend.forecast(_events(spark, sf), "ts", "value", ["event_type"]).drop("lower", "upper")


# The t quantile by bisection on the two-sided tail.
_T_QUANTILE = f"""
    WITH RECURSIVE cut AS (
        SELECT event_type, n - 2 AS df, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high, 0 AS i FROM ({FIT})
        UNION ALL
        SELECT event_type, df, CASE WHEN p > 0.05 THEN mid ELSE low END, CASE WHEN p > 0.05 THEN high ELSE mid END, i + 1
        FROM (SELECT *, {t_p_sql("mid", "df")} AS p FROM (SELECT *, (low + high) / 2 AS mid FROM cut WHERE i < 45)))
    SELECT event_type, (low + high) / 2 AS t FROM cut WHERE i = 45"""


@query("forecast_interval", f"""
    SELECT event_type, step, forecast, forecast - half AS lower, forecast + half AS upper, residual_error FROM (
        SELECT *, t * residual_error * sqrt(1 + 1.0 / n + (x0 - (n - 1) / 2.0) * (x0 - (n - 1) / 2.0) / (n * (n * n - 1) / 12.0)) AS half FROM (
            SELECT event_type, CAST(k.step AS INTEGER) AS step, n, n - 1 + k.step AS x0, intercept + slope * (n - 1 + k.step) AS forecast, t,
                   sqrt((syy - slope * slope * n * (n * n - 1) / 12.0) / (n - 2)) AS residual_error
            FROM ({FIT}) JOIN ({_T_QUANTILE}) USING (event_type) CROSS JOIN (SELECT unnest(range(1, 8)) AS step) k))""",
    "forecast lower upper residual_error", forecast=5, lower=5, upper=5, residual_error=5)
def forecast_interval(spark, sf):
    return trend.forecast(_events(spark, sf), "ts", "value", ["event_type"])


# Correlation.


def _pairs(columns) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]


def _corr_sql(source: str, columns) -> str:
    raw = " UNION ALL ".join(
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, count(*) AS n, corr({a}, {b}) AS r FROM {source}" for a, b in _pairs(columns)
    )
    t = "r * sqrt((n - 2) / (1 - r * r))"
    return (
        f"SELECT variable1, variable2, n, r AS correlation, p AS p_value, p < 0.05 AS significant, 'ok' AS status FROM "
        f"(SELECT *, {t_p_sql('t', 'n - 2')} AS p FROM (SELECT *, {t} AS t FROM ({raw})))"
    )


@query("corr_pearson", _corr_sql("lineitem", LINE_NUMBERS), "correlation p_value")
def corr_pearson(spark, sf):
    return correlation.pearson(table(spark, sf, "lineitem"), LINE_NUMBERS)


@query("corr_by_group", """
    SELECT l_returnflag, 'l_quantity' AS variable1, 'l_extendedprice' AS variable2, count(*) AS n, corr(l_quantity, l_extendedprice) AS correlation
    FROM lineitem GROUP BY l_returnflag""", "correlation")
def corr_by_group(spark, sf):
    pairs = correlation.pearson(table(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice"), ("l_returnflag",))
    return pairs.select("l_returnflag", "variable1", "variable2", "n", "correlation")


@query("corr_top10", f"""
    SELECT variable1, variable2, correlation, CAST(row_number() OVER (ORDER BY abs(correlation) DESC, variable1, variable2) AS INTEGER) AS rank
    FROM ({_corr_sql('lineitem', LINE_NUMBERS)}) QUALIFY rank <= 10""", "correlation")
def corr_top10(spark, sf):
    pairs = correlation.pearson(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return correlation.top_correlations(pairs).select("variable1", "variable2", "correlation", "rank")


@query("corr_significant", f"""
    SELECT variable1, variable2, correlation FROM ({_corr_sql('part', ('p_partkey', 'p_size', 'p_retailprice'))}) WHERE significant""", "correlation")
def corr_significant(spark, sf):
    pairs = correlation.pearson(table(spark, sf, "part"), ("p_partkey", "p_size", "p_retailprice"))
    return correlation.significant_correlations(pairs).select("variable1", "variable2", "correlation")


@query("corr_matrix", " UNION ALL ".join(
    [f"SELECT '{a}' AS \"row\", '{b}' AS \"column\", corr({a}, {b}) AS correlation FROM lineitem" for a in LINE_NUMBERS for b in LINE_NUMBERS if a != b]
    + [f"SELECT '{a}', '{a}', 1.0 FROM (SELECT count(*) FROM lineitem)" for a in LINE_NUMBERS]
), "correlation")
def corr_matrix(spark, sf):
    pairs = correlation.pearson(table(spark, sf, "lineitem"), LINE_NUMBERS)
    return correlation.matrix(pairs, LINE_NUMBERS).drop("p_value")


def _ranked_sql(source: str, columns) -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in columns
    )
    return f"(SELECT {ranks} FROM {source})"



@query("corr_spearman", _corr_sql(_ranked_sql("lineitem", LINE_NUMBERS[:3]), LINE_NUMBERS[:3]), "correlation p_value")
def corr_spearman(spark, sf):
    return correlation.spearman(table(spark, sf, "lineitem"), LINE_NUMBERS[:3])


def _tau_sql(source: str, x: str, y: str) -> str:
    """Kendall from counts by (x, y): below each point the counts of smaller y are summed over smaller and larger x."""
    ties = lambda c, what: f"(SELECT sum({what}) FROM (SELECT count(*)::DOUBLE AS t FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY {c}))"
    return f"""
        WITH cells AS (SELECT {x} AS x, {y} AS y, count(*)::DOUBLE AS c FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL),
        grid AS (SELECT x, y, coalesce(c, 0) AS c FROM (SELECT DISTINCT x FROM cells) CROSS JOIN (SELECT DISTINCT y FROM cells) LEFT JOIN cells USING (x, y)),
        below AS (SELECT x, y, c, sum(c) OVER (PARTITION BY x ORDER BY y) - c AS b FROM grid),
        sides AS (SELECT c, sum(b) OVER (PARTITION BY y ORDER BY x) - b AS less, sum(b) OVER (PARTITION BY y ORDER BY x DESC) - b AS more FROM below),
        facts AS (
            SELECT (SELECT sum(c) FROM cells) AS n, (SELECT sum(c * (less - more)) FROM sides) AS s, {ties(x, "t * (t - 1)")} AS tx, {ties(y, "t * (t - 1)")} AS ty,
                {ties(x, "t * (t - 1) * (2 * t + 5)")} AS vx, {ties(y, "t * (t - 1) * (2 * t + 5)")} AS vy, {ties(x, "t * (t - 1) * (t - 2)")} AS ux, {ties(y, "t * (t - 1) * (t - 2)")} AS uy),
        scores AS (
            SELECT *, 2 * s / sqrt((n * (n - 1) - tx) * (n * (n - 1) - ty)) AS tau,
                s / sqrt((n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + tx * ty / (2 * n * (n - 1)) + ux * uy / (9 * n * (n - 1) * (n - 2))) AS z FROM facts)
        SELECT '{x}' AS variable1, '{y}' AS variable2, n::BIGINT AS n, tau AS correlation, {z_p_sql("z")} AS p_value, {z_p_sql("z")} < 0.05 AS significant, 'ok' AS status FROM scores"""


@query("corr_kendall", _tau_sql("customer", "c_nationkey", "c_acctbal"), "correlation p_value")
def corr_kendall(spark, sf):
    return correlation.kendall(table(spark, sf, "customer"), ("c_nationkey", "c_acctbal"))


@query("corr_kendall_lineitem", _tau_sql("lineitem", "l_quantity", "l_extendedprice"), "correlation p_value")
def corr_kendall_lineitem(spark, sf):
    return correlation.kendall(table(spark, sf, "lineitem"), ("l_quantity", "l_extendedprice"))


# Group comparison.

_G = """
    SELECT {g} AS g, count({v}) AS n, avg({v}) AS m, var_samp({v}) AS s2 FROM {t} WHERE {g} IS NOT NULL AND {v} IS NOT NULL GROUP BY ALL"""
_LABEL = "CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END"


def _pair_sql(groups: str) -> str:
    return f"""
        SELECT *, (m1 - m2) / (sp * sqrt(1.0 / n1 + 1.0 / n2)) AS t, (m1 - m2) / sp AS d FROM (
            SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2,
                   sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2)) AS sp
            FROM ({groups}) a JOIN ({groups}) b ON a.g < b.g)"""


def _ttest_sql(t: str, g: str, v: str) -> str:
    groups = _G.format(t=t, g=g, v=v)
    return f"""
        SELECT 't-test' AS test_type, CAST(2 AS BIGINT) AS n_groups, n1 + n2 AS n_observations, t AS test_statistic, p AS p_value,
               p < 0.05 AS significant, d AS effect_size, {_LABEL} AS effect_size_interpretation, 'ok' AS status
        FROM (SELECT *, {t_p_sql('t', 'n1 + n2 - 2')} AS p FROM ({_pair_sql(groups)}))"""


RESULT = "test_statistic p_value effect_size"


@query("ttest", _ttest_sql("lineitem", "l_linestatus", "l_extendedprice"), RESULT)
def ttest(spark, sf):
    return compare.t_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")


def _anova_sql(t: str, g: str, v: str) -> str:
    groups = _G.format(t=t, g=g, v=v)
    return f"""
        SELECT 'anova' AS test_type, k AS n_groups, n AS n_observations, f AS test_statistic, p AS p_value, p < 0.05 AS significant,
               CAST(NULL AS DOUBLE) AS effect_size, CAST(NULL AS VARCHAR) AS effect_size_interpretation, 'ok' AS status
        FROM (SELECT *, {f_p_sql('f', 'k - 1', 'n - k')} AS p FROM (
            SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM (
                SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * pow(m - mm, 2)) AS ssb, sum((n - 1) * s2) AS ssw
                FROM ({groups}), (SELECT avg({v}) AS mm FROM {t} WHERE {g} IS NOT NULL))))"""


@query("anova", _anova_sql("orders", "o_orderpriority", "o_totalprice"), RESULT)
def anova(spark, sf):
    return compare.anova(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("test_selection", _anova_sql("events", "event_type", "value"), RESULT)
def test_selection(spark, sf):
    return compare.compare(table(spark, sf, "events"), "value", "event_type")


_PRICE = "(SELECT p_type AS g, CASE WHEN p_type = 'SMALL' THEN p_retailprice * 1.5 ELSE p_retailprice END AS v FROM part)"


def _shifted_part(spark, sf):
    part = table(spark, sf, "part")
    price = F.when(F.col("p_type") == "SMALL", F.col("p_retailprice") * 1.5).otherwise(F.col("p_retailprice"))
    return part.select(F.col("p_type").alias("g"), price.alias("v"))


@query("anova_pairs", f"""
    SELECT group1, group2, m1 - m2 AS mean_difference, t AS t_statistic, p AS p_value, p < alpha AS significant, alpha AS bonferroni_alpha, d AS effect_size
    FROM (SELECT *, {t_p_sql('t', 'n1 + n2 - 2')} AS p, 0.05 / (k * (k - 1) / 2) AS alpha
          FROM ({_pair_sql(_G.format(t=_PRICE, g='g', v='v'))}), (SELECT count(DISTINCT g) AS k FROM {_PRICE}))""",
    "mean_difference t_statistic p_value bonferroni_alpha effect_size")
def anova_pairs(spark, sf):
    return compare.anova_pairs(_shifted_part(spark, sf), "v", "g")


def _rank_sql(t: str, g: str, v: str) -> str:
    return (
        f"SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM "
        f"(SELECT {g} AS g, {v} AS v FROM {t} WHERE {g} IS NOT NULL AND {v} IS NOT NULL)"
    )


def _ties_sql(t: str, v: str) -> str:
    return f"(SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM {t} WHERE {v} IS NOT NULL GROUP BY {v}))"


def _mwu_sql(t: str, g: str, v: str) -> str:
    return f"""
        SELECT 'mann-whitney' AS test_type, CAST(2 AS BIGINT) AS n_groups, CAST(n1 + n2 AS BIGINT) AS n_observations, u1 AS test_statistic, p AS p_value,
               p < 0.05 AS significant, CAST(NULL AS DOUBLE) AS effect_size, CAST(NULL AS VARCHAR) AS effect_size_interpretation, 'ok' AS status
        FROM (SELECT *, {z_p_sql('z')} AS p FROM (
            SELECT *, greatest(0, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))) AS z
            FROM (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM (
                SELECT CAST(count(*) FILTER (g = lo) AS DOUBLE) AS n1, CAST(count(*) FILTER (g <> lo) AS DOUBLE) AS n2, sum(r) FILTER (g = lo) AS r1
                FROM ({_rank_sql(t, g, v)}), (SELECT min({g}) AS lo FROM {t})), {_ties_sql(t, v)})))"""


@query("mann_whitney", _mwu_sql("lineitem", "l_linestatus", "l_extendedprice"), RESULT)
def mann_whitney(spark, sf):
    return compare.mann_whitney(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")


def _kruskal_sql(t: str, g: str, v: str) -> str:
    return f"""
        SELECT 'kruskal-wallis' AS test_type, k AS n_groups, CAST(n AS BIGINT) AS n_observations, h AS test_statistic, p AS p_value, p < 0.05 AS significant,
               CAST(NULL AS DOUBLE) AS effect_size, CAST(NULL AS VARCHAR) AS effect_size_interpretation, 'ok' AS status
        FROM (SELECT *, {chi2_p_sql('h', 'k - 1')} AS p FROM (
            SELECT k, n, (12 / (n * (n + 1)) * rr - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM (
                SELECT count(*) AS k, CAST(sum(c) AS DOUBLE) AS n, sum(r * r / c) AS rr FROM (
                    SELECT g, count(*) AS c, sum(r) AS r FROM ({_rank_sql(t, g, v)}) GROUP BY g)), {_ties_sql(t, v)}))"""


@query("kruskal", _kruskal_sql("orders", "o_orderpriority", "o_totalprice"), RESULT)
def kruskal(spark, sf):
    return compare.kruskal_wallis(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


@query("kruskal_pairs", f"""
    WITH b AS MATERIALIZED (SELECT g, v, count(*) AS c FROM {_PRICE} GROUP BY ALL),
    labels AS (SELECT DISTINCT g FROM b),
    p AS (SELECT x.g AS group1, y.g AS group2 FROM labels x JOIN labels y ON x.g < y.g),
    rows AS (SELECT group1, group2, b.* FROM p JOIN b ON b.g = group1 OR b.g = group2),
    vals AS (SELECT group1, group2, v, CAST(sum(c) AS DOUBLE) AS t FROM rows GROUP BY ALL),
    rk AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY group1, group2 ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS r FROM vals),
    u AS (SELECT rows.group1, rows.group2, CAST(sum(c) FILTER (g = rows.group1) AS DOUBLE) AS n1, CAST(sum(c) FILTER (g = rows.group2) AS DOUBLE) AS n2,
                 sum(c * r) FILTER (g = rows.group1) AS r1 FROM rows JOIN rk USING (group1, group2, v) GROUP BY ALL),
    ties AS (SELECT group1, group2, sum(t * t * t - t) AS ties FROM vals GROUP BY ALL),
    z AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u1 FROM u JOIN ties USING (group1, group2)),
    q AS (SELECT *, greatest(0, (greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))) AS zz,
                 0.05 / ((SELECT count(*) FROM labels) * ((SELECT count(*) FROM labels) - 1) / 2) AS alpha FROM z)
    SELECT group1, group2, u1 AS u_statistic, {z_p_sql('zz')} AS p_value, {z_p_sql('zz')} < alpha AS significant, alpha AS bonferroni_alpha FROM q""",
    "u_statistic p_value bonferroni_alpha")
def kruskal_pairs(spark, sf):
    return compare.kruskal_pairs(_shifted_part(spark, sf), "v", "g")


# Distribution.


def _shape_sql(t: str, v: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    on = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {lead}count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std_dev,
               avg(pow(v - mm, 3)) / pow(avg(pow(v - mm, 2)), 1.5) AS skewness, kurtosis_pop(v) AS kurtosis,
               quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3,
               quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, 'ok' AS status
        FROM (SELECT {lead}{v} AS v, avg({v}) OVER ({on}) AS mm FROM {t}) {group}"""


SHAPE = "mean std_dev skewness kurtosis q1 q2 q3 iqr"


@query("shape", _shape_sql("lineitem", "l_extendedprice"), SHAPE)
def shape_lineitem(spark, sf):
    return shape.distribution(table(spark, sf, "lineitem"), "l_extendedprice")


@query("shape_by_segment", _shape_sql("customer", "c_acctbal", "c_mktsegment"), SHAPE)
def shape_by_segment(spark, sf):
    return shape.distribution(table(spark, sf, "customer"), "c_acctbal", ("c_mktsegment",))


_CUBED = "(SELECT c_custkey, pow(c_acctbal / 1000, 3) AS v FROM customer)"


def _cubed(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.pow(F.col("c_acctbal") / 1000, F.lit(3.0)).alias("v"))


@query("outliers_iqr", f"""
    SELECT c_custkey, v AS value, a - 1.5 * w AS lower, b + 1.5 * w AS upper,
           CASE WHEN w > 0 THEN CASE WHEN v < a - 1.5 * w THEN (a - 1.5 * w - v) / w ELSE (v - (b + 1.5 * w)) / w END ELSE 0 END AS severity
    FROM {_CUBED}, (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, b - a AS w FROM {_CUBED})
    WHERE v < a - 1.5 * w OR v > b + 1.5 * w""", "value lower upper severity")
def outliers_iqr(spark, sf):
    return shape.iqr_outliers(_cubed(spark, sf), "v", "c_custkey")


@query("outliers_z", """
    SELECT o_orderkey, v AS value, abs((v - m) / s) AS severity
    FROM (SELECT o_orderkey, pow(o_totalprice / 100000, 6) AS v FROM orders), (SELECT avg(pow(o_totalprice / 100000, 6)) AS m, stddev_samp(pow(o_totalprice / 100000, 6)) AS s FROM orders)
    WHERE abs((v - m) / s) > 3""", "value severity")
def outliers_z(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.pow(F.col("o_totalprice") / 100000, F.lit(6.0)).alias("v"))
    return shape.z_outliers(orders, "v", "o_orderkey")


def _phi_sql(z: str) -> str:
    tail = f"({z_p_sql(z)}) / 2"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


@query("normality_ks", f"""
    SELECT n, statistic, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * x * x))))) END AS p_value
    FROM (SELECT *, statistic * sqrt(n) AS x FROM (
        SELECT any_value(n) AS n, max(greatest(upto * 1.0 / n - phi, phi - (upto - c) * 1.0 / n)) AS statistic FROM (
            SELECT *, {_phi_sql("z")} AS phi FROM (
                SELECT c, sum(c) OVER (ORDER BY v) AS upto, (SELECT count(c_acctbal) FROM customer) AS n,
                       (v - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer) AS z
                FROM (SELECT c_acctbal AS v, count(*) AS c FROM customer WHERE c_acctbal IS NOT NULL GROUP BY 1)))))""", "statistic p_value")
def normality_ks(spark, sf):
    return shape.ks_normality(table(spark, sf, "customer"), "c_acctbal")


# A rational approximation of the normal quantile, to nine digits.
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
           (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))


def _polynomial(coefficients, x: str) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"(({out}) * ({x}) + ({c}))"
    return out


def _quantile_sql(p: str) -> str:
    ratio = lambda pair, x: f"({_polynomial(pair[0], x)}) / ({_polynomial(pair[1], x)})"
    half, low = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{half} * {ratio(_MIDDLE, f'{half} * {half}')}"
    return f"(CASE WHEN least({p}, 1 - {p}) < 0.02425 THEN sign(0.5 - {p}) * {ratio(_TAIL, low)} ELSE {middle} END)"


def _shapiro_sql(source: str, value: str, group: str) -> str:
    """Shapiro-Wilk by Royston's approximation, for groups of 12 to 5000 values."""
    last = _polynomial((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, "m1 / sqrt(mm)"), "1 / sqrt(n)")
    second = _polynomial((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, "m2 / sqrt(mm)"), "1 / sqrt(n)")
    centre, spread = _polynomial((0.0038915, -0.083751, -0.31082, -1.5861), "ln(n)"), f"exp({_polynomial((0.0030302, -0.082676, -0.4803), 'ln(n)')})"
    return f"""
        WITH placed AS (
            SELECT {group} AS g, {value}::DOUBLE AS x, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {group}) AS n
            FROM {source} WHERE {value} IS NOT NULL),
        scored AS (SELECT *, {_quantile_sql("((i - 0.375) / (n + 0.25))")} AS m FROM placed),
        sums AS (SELECT g, any_value(n) AS n, sum(m * m) AS mm, max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2, var_pop(x) * any_value(n) AS ss FROM scored GROUP BY g),
        ends AS (SELECT *, {last} AS a1, {second} AS a2 FROM sums),
        whole AS (SELECT *, (mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi FROM ends),
        tests AS (
            SELECT g, any_value(w.n) AS n, pow(sum(x * CASE WHEN i = w.n THEN a1 WHEN i = 1 THEN -a1 WHEN i = w.n - 1 THEN a2 WHEN i = 2 THEN -a2 ELSE m / sqrt(phi) END), 2) / any_value(ss) AS w
            FROM scored JOIN whole w USING (g) GROUP BY g),
        judged AS (SELECT *, (ln(1 - w) - {centre}) / {spread} AS z FROM tests)
        SELECT g AS {group}, n, w AS statistic, CASE WHEN z > 0 THEN {z_p_sql("z")} / 2 ELSE 1 - {z_p_sql("z")} / 2 END AS p_value FROM judged"""


@query("normality", f"""
    SELECT *, 'Shapiro-Wilk' AS test_name, p_value > 0.05 AS is_normal FROM ({_shapiro_sql("orders", "o_totalprice", "o_orderpriority")})""", "statistic p_value")
def normality(spark, sf):
    return shape.normality(table(spark, sf, "orders"), "o_totalprice", ("o_orderpriority",))


@query("recommended_correlation", """
    SELECT false AS first_normal, false AS second_normal, 'spearman' AS recommended_method WHERE (SELECT count(*) FROM lineitem) > 0""")
def recommended_correlation(spark, sf):
    return shape.recommend_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("recommended_comparison", f"""
    SELECT count(*) AS n_groups, bool_and(p_value > 0.05) AS all_normal, CASE WHEN bool_and(p_value > 0.05) THEN 'anova' ELSE 'kruskal-wallis' END AS recommended_test
    FROM ({_shapiro_sql("orders", "o_totalprice", "o_orderpriority")})""")
def recommended_comparison(spark, sf):
    return shape.recommend_comparison(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")


# Findings.


@query("data_points", f"""
    SELECT 'statistic' AS type, c AS subject, m AS value, 'Mean ' || c AS description FROM (
        SELECT 'l_quantity' AS c, avg(l_quantity) AS m FROM lineitem UNION ALL SELECT 'l_tax', avg(l_tax) FROM lineitem)
    UNION ALL
    SELECT 'correlation', variable1 || ', ' || variable2, correlation, 'Correlation between ' || variable1 || ' and ' || variable2
    FROM (SELECT *, row_number() OVER (ORDER BY abs(correlation) DESC, variable1, variable2) AS r FROM ({_corr_sql('lineitem', LINE_NUMBERS)})) WHERE r <= 3
    UNION ALL SELECT 'trend', event_type, slope, 'Trend slope: ' || {DIRECTION} FROM ({FIT})
    UNION ALL SELECT 'group_statistic', o_orderpriority, avg(o_totalprice), 'Mean for ' || o_orderpriority FROM orders GROUP BY o_orderpriority""",
    "value", value=8)
def data_points(spark, sf):
    lines = table(spark, sf, "lineitem")
    groups = describe.group_statistics(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority")
    return findings.data_points(
        describe.column_statistics(lines, ("l_quantity", "l_tax")),
        correlation.pearson(lines, LINE_NUMBERS),
        trend.trend_fit(_events(spark, sf), "ts", "value", ["event_type"]).withColumnRenamed("event_type", "metric"),
        groups.withColumnRenamed("o_orderpriority", "group"),
    )


@query("patterns", f"""
    SELECT 'correlation' AS subject, 'Strong correlations detected between ' || k || ' variable pairs' AS pattern
    FROM (SELECT count(*) AS k FROM ({_corr_sql('part', ('p_partkey', 'p_size', 'p_retailprice'))}) WHERE abs(correlation) > 0.7) WHERE k > 0
    UNION ALL SELECT event_type, upper(substr(d, 1, 1)) || substr(d, 2) || ' trend detected' FROM (SELECT event_type, {DIRECTION} AS d FROM ({FIT})) WHERE d <> 'stable'
    UNION ALL SELECT event_type, 'Seasonal pattern detected in time series'
        FROM (SELECT event_type, bool_or((lag IN (7, 14) OR (lag = 30 AND n >= 30)) AND abs(acf) > 2 / sqrt(n)) AS s FROM ({ACF}) GROUP BY event_type) WHERE s
    UNION ALL SELECT 'part price', 'Statistically significant differences between groups' FROM ({_anova_sql(_PRICE, 'g', 'v')}) WHERE significant
    UNION ALL SELECT 'balance', 'Outliers detected: ' || k || ' (' || format('{{:.1f}}', k * 100.0 / n) || '% of data)' FROM (
        SELECT count(*) FILTER (v < a - 1.5 * w OR v > b + 1.5 * w) AS k, count(*) AS n FROM {_CUBED},
            (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, b - a AS w FROM {_CUBED})) WHERE k > 0""")
def patterns(spark, sf):
    events, part = _events(spark, sf), table(spark, sf, "part")
    trends = trend.trend_fit(events, "ts", "value", ["event_type"]).join(
        trend.seasonality(events, "ts", "value", ["event_type"]).drop("n"), "event_type"
    )
    outliers = shape.outlier_counts(_cubed(spark, sf), ["v"])
    return findings.patterns(
        correlation.pearson(part, ("p_partkey", "p_size", "p_retailprice")),
        trends.withColumnRenamed("event_type", "metric"),
        compare.anova(_shifted_part(spark, sf), "v", "g").withColumn("subject", F.lit("part price")),
        outliers.select(F.lit("balance").alias("subject"), F.col("outliers").alias("n_outliers"), F.col("n").alias("n_observations")),
    )


@query("priorities", f"""
    SELECT 'trend' AS analysis_type, event_type AS subject,
           CASE WHEN {DIRECTION} = 'decreasing' AND r_squared > 0.5 THEN 'high' WHEN {DIRECTION} <> 'stable' THEN 'medium' ELSE 'low' END AS priority FROM ({FIT})
    UNION ALL SELECT 'correlation', 'part', CASE WHEN count(*) FILTER (significant AND abs(correlation) > 0.7) >= 3 THEN 'high'
        WHEN count(*) FILTER (significant) >= 2 THEN 'medium' ELSE 'low' END FROM ({_corr_sql('part', ('p_partkey', 'p_size', 'p_retailprice'))})
    UNION ALL SELECT 'comparative', 'line price', CASE WHEN significant AND abs(effect_size) > 0.8 THEN 'high' WHEN significant THEN 'medium' ELSE 'low' END
        FROM ({_ttest_sql('lineitem', 'l_linestatus', 'l_extendedprice')})
    UNION ALL SELECT 'distribution', 'balance', CASE WHEN k * 100.0 / n > 10 THEN 'high' WHEN k * 100.0 / n > 5 THEN 'medium' ELSE 'low' END FROM (
        SELECT count(*) FILTER (v < a - 1.5 * w OR v > b + 1.5 * w) AS k, count(*) AS n FROM {_CUBED},
            (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b, b - a AS w FROM {_CUBED}))""")
def priorities(spark, sf):
    part = table(spark, sf, "part")
    row = lambda kind, subject, level: (F.lit(kind).alias("analysis_type"), subject.alias("subject"), level.alias("priority"))
    trends = trend.trend_fit(_events(spark, sf), "ts", "value", ["event_type"])
    pairs = findings.correlation_priority(correlation.pearson(part, ("p_partkey", "p_size", "p_retailprice")))
    test = compare.t_test(table(spark, sf, "lineitem"), "l_extendedprice", "l_linestatus")
    outliers = shape.outlier_counts(_cubed(spark, sf), ["v"])
    return union_all([
        trends.select(*row("trend", F.col("event_type"), findings.trend_priority(F.col("direction"), F.col("r_squared")))),
        pairs.select(*row("correlation", F.lit("part"), F.col("priority"))),
        test.select(*row("comparative", F.lit("line price"), findings.comparison_priority(F.col("significant"), F.col("effect_size")))),
        outliers.select(*row("distribution", F.lit("balance"), findings.distribution_priority(F.col("outliers"), F.col("n")))),
    ])
