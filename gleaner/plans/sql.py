"""SQL fragments shared by the oracles: the same views and expressions, spelled in SQL."""

from __future__ import annotations

from gleaner.functions import text as X
from gleaner.functions.hashing import share_cut


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(quoted(w) for w in words)


ROW_KEY = (
    "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    "CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))"
)

INTERACTIONS = f"""
interactions AS (
  SELECT o_custkey AS user_id, l_partkey AS parent_asin,
         CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
         o_orderpriority, {ROW_KEY} AS row_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

REVIEWS = """
reviews AS (
  SELECT d.doc_id AS review_id, CAST(quality * 4 + 1 AS DOUBLE) AS rating, source AS title, text,
         n_chars % 200 AS parent_asin, user_id, epoch_us(ts) // 1000 AS "timestamp",
         CAST(n_chars AS DOUBLE) AS helpful_vote
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN events e ON e.event_id = d.doc_id)"""

META = """
meta AS (
  SELECT p_partkey AS parent_asin, p_name AS title, p_type AS main_category, p_brand AS store,
         p_retailprice AS price, CAST(p_size AS DOUBLE) AS rating_number,
         CAST(p_size AS DOUBLE) / 10 AS average_rating, text AS description,
         p_type || ' ' || p_brand AS categories
  FROM part LEFT JOIN documents ON doc_id = p_partkey)"""

GAPPY = """
gappy AS (
  SELECT event_id, user_id, CASE WHEN event_id % 7 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 10 <> 0 THEN value END AS value
  FROM events)"""


def draw(seed: int, step: str, key: str) -> str:
    return f"md5(concat_ws('|', '{seed}', '{step}', {key}))"


def below(digest: str, share: float) -> str:
    return f"substr({digest}, 1, 8) < '{share_cut(share)}'"


def is_test(key: str = "row_key", share: float = 0.2) -> str:
    return below(draw(42, "split", key), share)


def scrub(column: str) -> str:
    out = column
    for pattern in X.PII_PATTERNS.values():
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(X.REDACTED)}, 'g')"
    return out


def squash(column: str) -> str:
    return f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"


def tokens(column: str) -> str:
    out = f"regexp_replace({column}, '([{X.QUOTE_MARKS}])', ' \\1 ', 'g')"
    for word, parts in X.SPLIT_WORDS.items():
        out = f"regexp_replace({out}, '\\b{word}\\b', '{parts}', 'g')"
    return f"regexp_split_to_array(trim({out}), '\\s+')"


def no_stop_words(array: str) -> str:
    return f"list_filter({array}, lambda w: w <> '' AND NOT list_contains([{listed(X.STOP_WORDS)}], w))"


def clean_plain(column: str) -> str:
    """Without lemmas."""
    bare = f"translate(lower(coalesce({column}, '')), {quoted(X.PUNCTUATION)}, '')"
    bare = squash(f"regexp_replace({bare}, '[0-9]+', '', 'g')")
    return f"coalesce(array_to_string({no_stop_words(tokens(bare))}, ' '), '')"


def clean_markup(column: str) -> str:
    """Without lemmas."""
    bare = f"lower(regexp_replace(coalesce({column}, ''), '<[^>]+>', ' ', 'g'))"
    bare = squash(f"regexp_replace({bare}, '[^a-z\\s]', ' ', 'g')")
    words = f"list_filter({tokens(bare)}, lambda w: regexp_full_match(w, '[a-z]+'))"
    return f"coalesce(array_to_string({no_stop_words(words)}, ' '), '')"


def lemma(word: str) -> str:
    cases = [f"WHEN {word} = {quoted(w)} THEN {quoted(s)}" for w, s in X.IRREGULAR_NOUNS.items()]
    for ending, replacement in X.PLURAL_RULES:
        n = len(ending)
        cases.append(
            f"WHEN suffix({word}, '{ending}') AND length({word}) > {n + 1} "
            f"THEN left({word}, length({word}) - {n}) || '{replacement}'"
        )
    kept = " OR ".join(f"suffix({word}, '{e}')" for e in X.KEPT_ENDINGS)
    cases.append(
        f"WHEN suffix({word}, 's') AND NOT ({kept}) AND length({word}) > 3 THEN left({word}, length({word}) - 1)"
    )
    return f"CASE {' '.join(cases)} ELSE {word} END"


def words(column: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '\\s+'), lambda w: w <> '')"


def typo(column: str, probability: float, seed: int, key: str) -> str:
    cut = format(min(int(probability * 2**32), 2**32 - 1), "08x")
    d = f"md5(concat_ws('|', '{seed}', {key}, CAST(i - 1 AS VARCHAR)))"

    def piece(start: int) -> str:
        return f"CAST('0x' || substr({d}, {start}, 7) AS BIGINT)"

    size = "length(w)"
    first = f"({piece(9)} % {size})"
    second = f"(({first} + 1 + {piece(17)} % greatest({size} - 1, 1)) % {size})"
    low, high = f"least({first}, {second})", f"greatest({first}, {second})"
    swapped = (
        f"substr(w, 1, {low}) || substr(w, {high} + 1, 1) || substr(w, {low} + 2, {high} - {low} - 1)"
        f" || substr(w, {low} + 1, 1) || substr(w, {high} + 2, {size})"
    )
    grown = f"w || chr(CAST(97 + {piece(25)} % 26 AS INTEGER))"
    change = f"CASE WHEN {size} > 1 THEN {swapped} ELSE {grown} END"
    one = f"CASE WHEN substr({d}, 1, 8) < '{cut}' THEN {change} ELSE w END"
    return (
        f"CASE WHEN {column} IS NOT NULL THEN "
        f"coalesce(array_to_string(list_transform({words(column)}, lambda w, i: {one}), ' '), '') END"
    )


def drawn(seed: int, step: str, key: str, share: float) -> str:
    """Membership in the exact sample, as a window expression."""
    return (
        f"(row_number() OVER (ORDER BY {draw(seed, step, key)}, {key}) "
        f"<= floor(count(*) OVER () * CAST({share} AS DOUBLE)))"
    )


def heads(seed: int, step: str, key: str) -> str:
    return f"substr({draw(seed, step + ':coin', key)}, 1, 1) < '8'"
