"""SQL that several queries share."""

#: Current state of the files, for ``WITH``.
FILES = """cur AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY indexed_at_ns DESC, size DESC, mtime_ns DESC) AS rn
    FROM files WHERE id IS NOT NULL) WHERE rn = 1)"""

#: Chunks, each id once.
CHUNKS = """ch AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY content DESC NULLS LAST) AS rn FROM chunks) WHERE rn = 1)"""

_CJK = "\\p{Han}\\p{Hiragana}\\p{Katakana}"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def runs(x: str) -> str:
    return f"regexp_extract_all(regexp_replace(lower(coalesce({x}, '')), '([{_CJK}]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}_\\-]+')"


def is_cjk(x: str) -> str:
    return f"regexp_matches({x}, '^[{_CJK}]')"


def bigrams(x: str) -> str:
    return f"CASE WHEN length({x}) > 1 THEN list_transform(range(1, length({x})), lambda i: substr({x}, i::INT, 2)) ELSE [{x}] END"


def terms(x: str) -> str:
    return f"flatten(list_transform({runs(x)}, lambda r: CASE WHEN {is_cjk('r')} THEN {bigrams('r')} ELSE [r] END))"


def tokens(x: str) -> str:
    from terrane.functions.text import BARE, MARKED

    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{MARKED}', '{BARE}'), '[\\p{{L}}\\p{{N}}]+')"


def phrases(x: str) -> str:
    from terrane.functions.text import QUERY_STOPWORDS

    stop = ", ".join(map(quoted, QUERY_STOPWORDS))
    kept = f"list_filter({runs(x)}, lambda r: {is_cjk('r')} OR r NOT IN ({stop}))"
    each = f"flatten(list_transform({kept}, lambda r: CASE WHEN {is_cjk('r')} THEN list_concat([r], {bigrams('r')}) ELSE [r] END))"
    return f"list_distinct(list_filter({each}, lambda p: regexp_matches(p, '[\\p{{L}}\\p{{N}}]')))"


def trimmed(x: str) -> str:
    return f"trim({x}, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(160))"


def truncated(x: str, limit: int) -> str:
    """The longest beginning of at most ``limit`` bytes."""
    return f"substr({x}, 1, CAST(list_max(list_filter(range(0, least(length({x}), {limit}) + 1), lambda n: octet_length(encode(substr({x}, 1, n::INT))) <= {limit})) AS INT))"


#: Every twentieth query that was served, as the stated set of queries.
ASKED = "q AS (SELECT query_id, max(query_text) AS query_text FROM search_hits WHERE query_id % 20 = 0 GROUP BY query_id)"
