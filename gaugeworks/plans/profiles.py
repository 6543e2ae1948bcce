"""Queries over profiles. Their SQL computes the same facts column by column and applies the same rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from gaugeworks import constants as K
from gaugeworks.functions.joins import union_all
from gaugeworks.operators import profile
from gaugeworks.operators.cells import registry
from gaugeworks.operators.profile import DATE_PATTERN, TOP_VALUES
from gaugeworks.plans.numbers import REGISTRY_SQL, registry_frame
from gaugeworks.plans.registry import query, table

# Tables of the profiled registry: dataset type, and columns with their types (n: number, s: text, t: time).
PROFILED = {
    "documents": ("survey", "doc_id:n text:s lang:s source:s n_chars:n"),
    "orders": ("usage", "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s"),
    "events": ("events", "event_id:n ts:t user_id:n event_type:s value:n props:s"),
    "labels": ("survey", "doc_id:n quality:n toxic:n"),
    "customer": ("circulation", "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s"),
    "part": ("collection", "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n"),
    "conversations": ("survey", "conv_id:n turn:n role:s text:s"),
}
KINDS = {"n": "number", "s": "text", "t": "datetime"}


def _listed(values: Sequence[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _named(hints: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(name), '{h}')" for h in hints) + ")"


def facts_sql(tables: Sequence[str] = tuple(PROFILED)) -> str:
    """One row per dataset and column."""
    parts = []
    for at, source in enumerate(tables, 1):
        for position, column in enumerate(PROFILED[source][1].split()):
            name, kind = column.split(":")
            top = (
                f"(SELECT list(v ORDER BY n DESC, v) FROM (SELECT {name}::VARCHAR AS v, count(*) AS n FROM {source} WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT {TOP_VALUES}) "
                f"WHERE lower(v) NOT IN ({_listed(K.MISSING_TEXTS)}))"
            )
            parts.append(
                f"SELECT {at}::BIGINT AS dataset_id, '{source}' AS dataset, '{PROFILED[source][0]}' AS dataset_type, {position} AS position, '{name}' AS name, '{KINDS[kind]}' AS type, {str(kind == 's').lower()} AS is_string, "
                f"count(*) AS n_rows, count({name}) AS filled, count(DISTINCT {name}) AS unique_count, coalesce(quantile_cont(length({name}::VARCHAR), 0.5), 0) AS median_length, "
                f"count(*) FILTER (regexp_matches({name}::VARCHAR, '{DATE_PATTERN}')) AS dateish, "
                f"count(*) FILTER (regexp_matches({name}::VARCHAR, '{DATE_PATTERN}') AND try_cast({name}::VARCHAR AS TIMESTAMP) IS NOT NULL) AS dated, "
                f"count(try_cast({name}::VARCHAR AS DOUBLE)) AS numbers, coalesce(bool_and({name} IS NULL OR lower(trim({name}::VARCHAR)) IN ({_listed(K.MISSING_TEXTS)})), true) AS all_missing, "
                f"count(*) FILTER (regexp_replace(lower(trim({name}::VARCHAR)), '\\.0+$', '') IN ({_listed(K.CODED_MISSING)})) AS coded, {top} AS frequent FROM {source}"
            )
    return " UNION ALL ".join(parts)


def kinds_sql(tables: Sequence[str] = tuple(PROFILED)) -> str:
    return f"""
        SELECT *, NOT {_named(K.TEXT_EXCLUDED_HINTS)} AND ({_named(K.TEXT_HINTS)} OR (is_string AND filled > 0 AND median_length >= 25)) AS is_text,
            {_named(K.CATEGORY_HINTS)} OR (is_string AND filled > 0 AND unique_count <= greatest(20, filled * 0.25)) AS is_category,
            {_named(K.DATE_HINTS)} OR (filled > 0 AND dateish >= 0.5 * filled AND dated >= 0.7 * filled) AS is_date,
            type = 'number' OR ({_named(K.NUMERIC_HINTS)} AND numbers > 0) AS is_numeric, coded / greatest(n_rows, 1) AS rate
        FROM ({facts_sql(tables)})"""


def _registry(spark, sf, tables: Sequence[str] = tuple(PROFILED)):
    return registry([(table(spark, sf, name), at, name, PROFILED[name][0]) for at, name in enumerate(tables, 1)])


@query("column_kinds", f'SELECT name AS "column", is_text, is_category, is_date, is_numeric FROM ({kinds_sql(["documents"])})')
def column_kinds(spark, sf):
    return profile.column_kinds(table(spark, sf, "documents")).select("column", "is_text", "is_category", "is_date", "is_numeric")


@query("registry_column_kinds", f"""
    SELECT dataset_id, position::INTEGER AS position, name AS "column", type, n_rows, is_text, is_category, is_date, is_numeric, all_missing, rate AS coded_missing_rate FROM ({kinds_sql()})""", "coded_missing_rate")
def registry_column_kinds(spark, sf):
    return profile.column_kinds(_registry(spark, sf).cells()).drop("frequent")


@query("missing_columns", """
    WITH hidden AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' N/A ' WHEN doc_id % 3 = 1 THEN '-666' END AS all_coded, quality FROM labels)
    SELECT p::INTEGER AS position, c AS "column" FROM (
        SELECT 0 AS p, 'doc_id' AS c, bool_and(doc_id IS NULL) AS gone FROM hidden
        UNION ALL SELECT 1, 'all_coded', bool_and(all_coded IS NULL OR lower(trim(all_coded)) IN ('n/a', '-666')) FROM hidden
        UNION ALL SELECT 2, 'quality', bool_and(quality IS NULL) FROM hidden) WHERE gone""")
def missing_columns(spark, sf):
    hidden = F.when(F.col("doc_id") % 3 == 0, " N/A ").when(F.col("doc_id") % 3 == 1, "-666")
    return profile.missing_columns(table(spark, sf, "labels").select("doc_id", hidden.alias("all_coded"), "quality"))


def _names_of(test: str) -> str:
    return f"coalesce(string_agg(name, ',' ORDER BY position) FILTER ({test}), '')"


def _frequent_of(hints: Sequence[str]) -> str:
    return f"coalesce(array_to_string(arg_min(frequent, position) FILTER ({_named(hints)} AND len(frequent) > 0), ','), '')"


def profiles_sql(tables: Sequence[str] = tuple(PROFILED)) -> str:
    first = f"list(name ORDER BY position) FILTER (all_missing)[1:{K.WARNING_COLUMNS}]"
    coded = f"(list(name || ' (' || round_even(rate * 100, 0)::INTEGER || '%)' ORDER BY position) FILTER (rate > 0))[1:{K.WARNING_COLUMNS}]"
    said = K.WARNING_TEXTS
    warnings = (
        f"CASE WHEN any_value(dataset_type) = 'survey' AND NOT bool_or(is_text) THEN '{said['no_text']}' END",
        f"CASE WHEN any_value(dataset_type) IN ('usage', 'circulation') AND NOT bool_or(is_numeric) THEN '{said['no_metric']}' END",
        f"CASE WHEN bool_or(all_missing) THEN replace('{said['missing']}', '{{}}', array_to_string(({first}), ', ')) END",
        f"CASE WHEN bool_or(rate > 0) THEN replace('{said['coded']}', '{{}}', array_to_string({coded}, ', ')) END",
        f"CASE WHEN max(n_rows) < {K.MIN_RESPONSES} THEN '{said['small']}' END",
    )
    warnings = tuple(w.replace(f"({first})", f"(list(name ORDER BY position) FILTER (all_missing))[1:{K.WARNING_COLUMNS}]") for w in warnings)
    held = {"text_columns": "bool_or(is_text)", "numeric_columns": "bool_or(is_numeric)", "date_columns": "bool_or(is_date)", "languages": f"{_frequent_of(K.LANGUAGE_HINTS)} <> ''", "sentiment_labels": f"{_frequent_of(K.LABEL_HINTS)} <> ''"}
    strengths = ", ".join(f"CASE WHEN {held[c]} THEN '{text}' END" for c, text in K.STRENGTH_TEXTS)
    return f"""
        SELECT dataset_id, any_value(dataset) AS name, any_value(dataset_type) AS dataset_type, max(n_rows) AS row_count, {_names_of("true")} AS columns, {_names_of("is_text")} AS text_columns,
            {_names_of("is_date")} AS date_columns, {_names_of("is_numeric")} AS numeric_columns, {_names_of("is_category")} AS category_columns, {_names_of("all_missing")} AS missing_columns,
            {_frequent_of(K.LANGUAGE_HINTS)} AS languages, {_frequent_of(K.LABEL_HINTS)} AS sentiment_labels, concat_ws('|', {strengths}) AS strengths, concat_ws('|', {", ".join(warnings)}) AS warnings
        FROM ({kinds_sql(tables)}) GROUP BY dataset_id"""


def _flat(profiles):
    lists = ("columns", "text_columns", "date_columns", "numeric_columns", "category_columns", "missing_columns", "languages", "sentiment_labels")
    joined = {c: F.array_join(c, ",") for c in lists} | {c: F.array_join(c, "|") for c in ("strengths", "warnings")}
    return profiles.drop("coded_missing").withColumns(joined)


@query("dataset_profile", profiles_sql(["documents"]))
def dataset_profile(spark, sf):
    return _flat(profile.dataset_profile(table(spark, sf, "documents"), "survey", "documents", 1))


@query("registry_profiles", profiles_sql())
def registry_profiles(spark, sf):
    return _flat(profile.registry_profiles(_registry(spark, sf)))


@query("registry_dictionary", f"""
    SELECT dataset_id, position::INTEGER AS position, name AS "column", type, n_rows - filled AS missing_count, CASE WHEN n_rows > 0 THEN round((n_rows - filled) * 100.0 / n_rows, 2) ELSE 0 END AS missing_pct, unique_count,
        CASE {" ".join(f"WHEN {_named(hints)} THEN '{role}'" for role, hints in K.ROLE_HINTS)} WHEN type = 'number' THEN 'numeric measure' WHEN unique_count <= {K.ROLE_CATEGORY_MAX} THEN 'category' ELSE 'descriptor' END AS role
    FROM ({facts_sql()})""", "missing_pct")
def registry_dictionary(spark, sf):
    return profile.data_dictionary(_registry(spark, sf).cells()).drop("examples")


@query("combined_profiles", f"""
    SELECT count(*) AS dataset_count, sum(row_count)::BIGINT AS total_rows, string_agg(DISTINCT dataset_type, ',' ORDER BY dataset_type) AS types, bool_or(text_columns <> '') AS has_text,
        bool_or(numeric_columns <> '') AS has_numeric, bool_or(date_columns <> '') AS has_dates, coalesce(string_agg(warnings, '|' ORDER BY dataset_id) FILTER (warnings <> ''), '') AS warnings
    FROM ({profiles_sql()})""")
def combined_profiles(spark, sf):
    combined = profile.combine_profiles(profile.registry_profiles(_registry(spark, sf)))
    return combined.withColumns({"types": F.array_join("types", ","), "warnings": F.array_join("warnings", "|")})


def capability_sql(tables: Sequence[str]) -> str:
    """Facts of the matrix by dataset, then its rules with the reasons."""
    facts = f"""
        SELECT dataset_id, any_value(dataset) AS name, any_value(dataset_type) AS kind, max(n_rows) AS n, count(*) FILTER (type = 'number' AND filled >= 10) AS usable, count(*) FILTER (is_string) AS texts,
            arg_min(name, position) FILTER ({_named(K.DATE_HINTS)}) AS date, count(*) FILTER (is_string AND unique_count BETWEEN 2 AND 20) AS cats,
            arg_min(name, position) FILTER (is_string AND unique_count BETWEEN 2 AND 20) AS cat, arg_min(unique_count, position) FILTER (is_string AND unique_count BETWEEN 2 AND 20) AS groups
        FROM ({facts_sql(tables)}) GROUP BY dataset_id"""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    said = lambda name, *values: quoted(K.CAPABILITY_TEXTS[name]).replace("{}", "' || $ || '").replace("$", "{}").format(*values)
    text = (("text_type", f"kind NOT IN ({_listed(K.TEXT_TYPES)})", ("kind",)), ("text_none", "texts = 0", ()), ("text_few", f"n < {K.MIN_RESPONSES}", ("n",)), ("text_ready", "true", ("n", "texts")))
    metric = f"kind IN ({_listed(K.METRIC_TYPES)})"
    rules = {
        "qualitative_sentiment": text, "qualitative_themes": text,
        "correlation": (("correlation_type", f"NOT {metric}", ()), ("correlation_few", "usable < 2", ("usable",)), ("correlation_ready", "true", ("usable",))),
        "trend": (("trend_none", "date IS NULL", ()), ("trend_type", f"NOT {metric} OR usable = 0", ()), ("trend_ready", "true", ("date", "usable"))),
        "comparative": (("comparative_type", f"NOT {metric}", ()), ("comparative_few", "cats = 0 OR usable = 0", ("cats",)), ("comparative_ready", "true", ("cat", "groups"))),
        "distribution": (("distribution_type", f"NOT {metric}", ()), ("distribution_few", "usable = 0", ()), ("distribution_ready", "true", ("usable",))),
        "rag_query": (("query_ready", "true", ("n",)),),
    }
    parts = []
    for analysis, plan in rules.items():
        cases = " ".join(f"WHEN {test} THEN {said(name, *values)}" for name, test, values in plan)
        refused = " OR ".join(f"({test})" for _, test, _ in plan[:-1]) or "n < 1"
        parts.append(f"SELECT dataset_id, name, '{analysis}' AS analysis, NOT coalesce({refused}, false) AS available, CASE {cases} END AS reason FROM facts")
    return f"WITH facts AS ({facts}) " + " UNION ALL ".join(parts)


@query("capability_matrix", f"""SELECT name AS dataset, analysis, available, reason FROM ({capability_sql(("orders", "events", "documents"))})""")
def capability_matrix(spark, sf):
    parts = [
        profile.capability_matrix(table(spark, sf, name), PROFILED[name][0]).select(F.lit(name).alias("dataset"), "*")
        for name in ("orders", "events", "documents")
    ]
    return union_all(parts)


@query("registry_capabilities", capability_sql(tuple(PROFILED)))
def registry_capabilities(spark, sf):
    return profile.registry_capabilities(_registry(spark, sf))


CLASSIFIED_SQL = f"""
    SELECT dataset_id, dataset_type, dataset_type IN ({_listed(K.TEXT_TYPES)}) AS qualitative, dataset_type IN ({_listed(K.METRIC_TYPES)}) AS quantitative FROM (
        SELECT dataset_id, CASE dataset_id % 3 WHEN 0 THEN 'usage' WHEN 1 THEN 'survey' ELSE 'other' END AS dataset_type FROM ({REGISTRY_SQL}))"""


@query("classified_datasets", f"""
    SELECT *, CASE WHEN qualitative THEN 'qualitative' WHEN quantitative THEN 'quantitative' ELSE 'neither' END AS recommended,
        CASE WHEN qualitative THEN '{K.CLASSIFICATION_TEXTS["qualitative"]}' WHEN quantitative THEN replace('{K.CLASSIFICATION_TEXTS["quantitative"]}', '{{}}', upper(dataset_type[1]) || dataset_type[2:])
             ELSE '{K.CLASSIFICATION_TEXTS["neither"]}' END AS reason FROM ({CLASSIFIED_SQL})""")
def classified_datasets(spark, sf):
    kind = F.when(F.col("dataset_id") % 3 == 0, "usage").when(F.col("dataset_id") % 3 == 1, "survey").otherwise("other")
    found = profile.classify_datasets(registry_frame(spark, sf).select("dataset_id", kind.alias("dataset_type")))
    return found.select("dataset_id", "dataset_type", "qualitative", "quantitative", "recommended", "reason")
