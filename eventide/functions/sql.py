"""Registers the operators as temporary SQL functions.

Scalar and table functions are SQL bodies, which the analyzer puts into the query: no Python is involved and constants fold. Only stemming, the two
aggregates and a classifier's score are Python functions on Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..operators.aggregates import entropy_udaf, shared_terms_udaf, terms_in
from ..operators.eventtype import EventTypeModel
from ..operators.grid import PERIODS
from ..operators.tokenize import stemmed, stop_words

_INDEX = "CASE WHEN {v} IS NULL THEN CAST(NULL AS INT) WHEN isnan({v}) OR abs({v}) = double('infinity') THEN CAST(raise_error('coordinate must be finite') AS INT) ELSE CAST(floor(({v} - coalesce({s}, 0)) / cell_length) AS INT) END"
_FAIL = "CAST(raise_error({}) AS STRUCT<start_timestamp TIMESTAMP_NTZ, end_timestamp TIMESTAMP_NTZ>)"
_MICROS = ", ".join(str(m * 60_000_000) for m in PERIODS)
_SIMPLE = "filter(split(lower({t}.txt), '[^0-9a-z]+'), w -> w <> ''{more})"
_TERMS = f"""CASE {{t}}.config WHEN 'simple' THEN {_SIMPLE.format(t="{t}", more="")}
        WHEN 'english' THEN stem_terms({_SIMPLE.format(t="{t}", more=" AND NOT array_contains(array(@STOP@), w)")})
        ELSE CAST(raise_error('config is simple or english') AS ARRAY<STRING>) END"""
# Terms with their counts, as the runs of the sorted terms. Without an aggregate the function is a generator of its row; with one, a lateral call is a join on the text, which moves the text with each of its terms.
_COUNTED = """transform(array(sort_array({terms})), s -> CASE WHEN s IS NOT NULL THEN
        transform(array(filter(sequence(0, size(s)), i -> i = 0 OR i = size(s) OR get(s, i) <> get(s, i - 1))), at ->
            transform(slice(at, 1, size(at) - 1), (i, k) -> named_struct('term', get(s, i), 'count', CAST(get(at, k + 1) - i AS BIGINT))))[0] END)[0]"""
_BODIES = {
    "spatial_partition(x DOUBLE, y DOUBLE, cell_length DOUBLE, s_x DOUBLE DEFAULT 0, s_y DOUBLE DEFAULT 0) RETURNS STRUCT<x INT, y INT>": f"""
        CASE WHEN cell_length > 0 AND cell_length < double('infinity') THEN named_struct('x', {_INDEX.format(v="x", s="s_x")}, 'y', {_INDEX.format(v="y", s="s_y")})
        ELSE CAST(raise_error(concat('cell length must be finite and above 0, not ', coalesce(CAST(cell_length AS STRING), '<NULL>'))) AS STRUCT<x INT, y INT>) END""",
    "_micros(i INTERVAL DAY TO SECOND) RETURNS BIGINT": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', TIMESTAMP_NTZ '1970-01-01 00:00:00' + i)",
    "_period(at BIGINT, len BIGINT, moved BIGINT) RETURNS STRUCT<start_timestamp TIMESTAMP_NTZ, end_timestamp TIMESTAMP_NTZ>": """
        named_struct('start_timestamp', timestampadd(MICROSECOND, at - pmod(at, len) + moved, TIMESTAMP_NTZ '1970-01-01 00:00:00'),
                     'end_timestamp', timestampadd(MICROSECOND, at - pmod(at, len) + moved + len, TIMESTAMP_NTZ '1970-01-01 00:00:00'))""",
    "time_partition(ts TIMESTAMP_NTZ, interval_length INTERVAL DAY TO SECOND, shift INTERVAL DAY TO SECOND DEFAULT INTERVAL '0' SECOND) RETURNS STRUCT<start_timestamp TIMESTAMP_NTZ, end_timestamp TIMESTAMP_NTZ>": f"""
        CASE WHEN interval_length IS NULL THEN {_FAIL.format("'a period needs a length'")}
        WHEN _micros(interval_length) NOT BETWEEN 60000000 AND 86400000000 THEN {_FAIL.format("'a period lasts from one minute to one day'")}
        WHEN _micros(interval_length) < 3600000000 AND _micros(interval_length) NOT IN ({_MICROS}) THEN {_FAIL.format("'this number of minutes does not divide an hour'")}
        WHEN _micros(interval_length) NOT IN ({_MICROS}) THEN {_FAIL.format("'this number of hours does not divide a day'")}
        WHEN abs(_micros(shift)) >= _micros(interval_length) THEN {_FAIL.format("'the shift must be shorter than the period'")}
        ELSE _period(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) - coalesce(_micros(shift), 0), _micros(interval_length), coalesce(_micros(shift), 0)) END""",
    "spatial_partition_rows(x DOUBLE, y DOUBLE, cell_length DOUBLE) RETURNS TABLE(cell_x INT, cell_y INT)": """
        SELECT CAST(floor(spatial_partition_rows.x / nullif(spatial_partition_rows.cell_length, 0)) AS INT), CAST(floor(spatial_partition_rows.y / nullif(spatial_partition_rows.cell_length, 0)) AS INT)
        WHERE spatial_partition_rows.cell_length > 0 AND spatial_partition_rows.cell_length < double('infinity') AND abs(spatial_partition_rows.x) < double('infinity') AND abs(spatial_partition_rows.y) < double('infinity')""",
    "text_terms(txt STRING, config STRING DEFAULT 'simple') RETURNS ARRAY<STRING>": _TERMS.format(t="text_terms"),
    "terms_overlap(terms ARRAY<STRING>, keywords STRING, config STRING DEFAULT 'simple') RETURNS INT": "CASE WHEN terms IS NOT NULL AND keywords IS NOT NULL THEN size(array_intersect(terms, text_terms(keywords, config))) END",
    "terms_have_keyword(terms ARRAY<STRING>, keywords STRING, config STRING DEFAULT 'simple') RETURNS BOOLEAN": "CASE WHEN size(text_terms(keywords, config)) > 0 THEN arrays_overlap(array_compact(terms), text_terms(keywords, config)) ELSE false END",
    "keyword_overlap(txt STRING, keywords STRING, config STRING DEFAULT 'simple') RETURNS INT": "terms_overlap(text_terms(txt, config), keywords, config)",
    "has_keyword(txt STRING, keywords STRING, config STRING DEFAULT 'simple') RETURNS BOOLEAN": "terms_have_keyword(text_terms(txt, config), keywords, config)",
    "process_text(txt STRING, config STRING DEFAULT 'simple') RETURNS TABLE(term STRING, count BIGINT)": f"SELECT c.term, c.count FROM (SELECT explode({_COUNTED.format(terms=_TERMS.format(t='process_text'))}) AS c)",
}


def register(spark: SparkSession) -> None:
    """Scalars ``spatial_partition``, ``time_partition``, ``text_terms``, ``keyword_overlap`` and ``has_keyword`` (texts), ``terms_overlap`` and
    ``terms_have_keyword`` (term arrays), the tables ``process_text`` and ``spatial_partition_rows`` (no row for a bad length), and the aggregates
    ``term_entropy(x)`` and ``shared_terms(x, minimum)`` of term arrays or texts. Functions of texts take the config "simple" or "english" last;
    with a constant "simple" no Python is in the plan. An aggregate of texts takes "simple" terms.
    """
    runtime.prepare(spark)
    spark.udf.register("stem_terms", stemmed)
    words = ", ".join(f"'{w}'" for w in sorted(stop_words()))
    for head, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body.replace('@STOP@', words)}")
    spark.udf.register("term_entropy", entropy_udaf)
    spark.udf.register("shared_terms", shared_terms_udaf)


def register_model(spark: SparkSession, model: EventTypeModel, name: str = "event_type", most_rows: int = 1_000_000) -> None:
    """``event_type(x, type)`` of term arrays, or of texts by their "simple" terms: the verdict of a model of at most ``most_rows`` rows; an unknown type raises, NULL gives NULL."""
    rows = model.rows.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"the model has more than {most_rows} rows; use EventTypeModel.predict")
    weights: dict[str, dict[str, float]] = {}
    for r in rows:
        weights.setdefault(r["event_type"], {})[r["term"]] = r["weight"]
    held = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("boolean")
    def verdict(terms, types):
        def one(t, kind):
            if kind not in held.value:
                raise ValueError(f"unknown event type {kind!r}")
            w = held.value[kind]
            return None if t is None else bool(math.fsum(w.get(x, 0.0) for x in set(terms_in(t))) + w.get("", 0.0) > 0)

        return terms.combine(types, one)

    spark.udf.register(name, verdict)
