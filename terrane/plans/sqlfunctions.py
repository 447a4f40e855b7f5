"""This engine's functions for the read-only SQL surface."""

from __future__ import annotations

from pyspark.sql import SparkSession

from terrane.functions.text import BARE, MARKED, QUERY_STOPWORDS

_CJK = r"\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
_RUNS = rf"regexp_extract_all(regexp_replace(lower(coalesce(t, '')), '([{_CJK}]+)', ' $1 '), '([\\p{{L}}\\p{{N}}_\\-]+)', 0)"
_PAIRS = "CASE WHEN char_length(r) > 1 THEN transform(sequence(1, char_length(r) - 1), i -> substring(r, i, 2)) ELSE array(r) END"

#: Name and parameters, result, and body of each.
FUNCTIONS = (
    ("cosine_of(a ARRAY<FLOAT>, b ARRAY<FLOAT>)", "DOUBLE", f"CASE WHEN size(a) = size(b) AND size(a) > 0 AND {_DOT.format('a', 'a')} > 0 AND {_DOT.format('b', 'b')} > 0 THEN {_DOT.format('a', 'b')} / sqrt({_DOT.format('a', 'a')}) / sqrt({_DOT.format('b', 'b')}) ELSE 0 END"),
    ("analyze_terms(t STRING)", "ARRAY<STRING>", f"flatten(transform({_RUNS}, r -> CASE WHEN r RLIKE '^[{_CJK}]' THEN {_PAIRS} ELSE array(r) END))"),
    ("index_tokens(t STRING)", "ARRAY<STRING>", rf"regexp_extract_all(translate(lower(coalesce(t, '')), '{MARKED}', '{BARE}'), '([\\p{{L}}\\p{{N}}]+)', 0)"),
    (
        "fts_match(t STRING, q STRING)",
        "BOOLEAN",
        rf"exists(filter(split(lower(q), '\\s+'), w -> NOT array_contains(array({', '.join(repr(w) for w in QUERY_STOPWORDS)}), w) AND w RLIKE '[\\p{{L}}\\p{{N}}]'), "
        rf"w -> concat(' ', array_join(regexp_extract_all(translate(lower(coalesce(t, '')), '{MARKED}', '{BARE}'), '([\\p{{L}}\\p{{N}}]+)', 0), ' '), ' ') "
        rf"LIKE concat('% ', array_join(regexp_extract_all(translate(w, '{MARKED}', '{BARE}'), '([\\p{{L}}\\p{{N}}]+)', 0), ' '), ' %'))",
    ),
    ("within_path(p STRING, root STRING)", "BOOLEAN", "p = root OR startswith(p, concat(root, '/'))"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; returns their names. They are SQL, so Catalyst sees through them."""
    for signature, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {result} RETURN {body}")
    return [s.split("(")[0] for s, _, _ in FUNCTIONS]
