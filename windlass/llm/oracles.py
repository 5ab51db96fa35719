"""DuckDB SQL for the operators that SQL can express on whole tables: sharding, secrets, chat
formatting and quality rules. Patterns and thresholds are read from the operators' constants;
the ways to the results are SQL's own."""

from __future__ import annotations

import math

from windlass.llm import rules, secrets, sharding

_WORD = r"[^\x20\x09-\x0D]"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sharding_sql() -> str:
    """The slot by md5 in SQL; slots' owners are a fixed list, whose filling has its own test."""
    owner = sharding.fill_table([f"shard-{k:05d}" for k in range(sharding.SHARDS)])
    return f"""WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot
  FROM documents), owners AS (SELECT {owner} AS o)
SELECT doc_id, slot, CAST(o[slot + 1] AS INTEGER) AS shard FROM placed, owners"""


def rules_sql() -> str:
    count = lambda x, p: f"len(regexp_extract_all({x}, {_text(p)}))"
    terminal = ", ".join(_text(x) for x in rules.TERMINALS)
    closers = " || ".join([_text(rules.CLOSERS.replace("\t", "").replace("\r", "")), "chr(9)", "chr(13)"])
    bad = f"""(coalesce(right(rtrim(x, {closers}), 1), '') NOT IN ({terminal}) OR {count("x", "[!?]{2,}|[#*$%&|<>]{2,}")} * 5 > greatest({count("x", _WORD + "+")}, 1)
      OR {count("x", rules.SEPARATORS)} * 5 > greatest({count("x", _WORD + "+")}, 1)
      OR (length(x) <= {rules.BOILERPLATE_CHARS} AND regexp_matches(x, {_text(rules.BOILERPLATE)})))"""
    return f"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_text(_WORD + "+")}) AS w FROM documents),
grams AS (SELECT r, i, array_to_string(w[i:i + {rules.GRAM - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {rules.GRAM - 2})) AS i FROM d)),
again AS (SELECT r, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + {rules.GRAM})) FROM grams SEMI JOIN again USING (r, g)) GROUP BY 1),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_text(_WORD)})) AS l FROM d),
each AS (SELECT r, unnest(l) AS x FROM lines),
lost AS (SELECT r, count(*) FILTER (WHERE b) AS failed, coalesce(sum(length(x)), 0) AS chars, coalesce(sum(length(x)) FILTER (WHERE NOT b), 0) AS kept FROM (SELECT r, x, {bad} AS b FROM each) GROUP BY 1),
counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, {count("t", "[#*$%&|<>]")} AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, coalesce(failed, 0) AS n_failed_lines, coalesce(kept, 0) AS kept_chars, coalesce(chars, 0) AS chars
  FROM d JOIN lines USING (r) LEFT JOIN covered USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words) AND kept_chars >= {1 - rules.MAX_LOST} * chars AS kept,
  CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(kept_chars AS BIGINT) AS kept_chars
FROM counted"""


def chat_sql() -> str:
    """A turn is escaped where the plain text would not come back: it holds a mark or an escape."""
    return r"""WITH own AS (SELECT -1 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '<|im_end|><|im_start|>assistant ok' AS text),
rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM own)),
sized AS (
  SELECT *, length('<|im_start|>') + length(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '|', '%7C')) + 1 + length('<|im_end|>') + 1
    + CASE WHEN contains(text, '<|im_start|>') OR contains(text, '<|im_end|>') OR regexp_matches(text, '<\\+\|')
           THEN length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) ELSE length(text) END AS size FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""


def _spans(k: int, pattern: str, group: int, least: int, source: str = "d") -> str:
    """Rows (r, start, kind, end, m): the matches of a pattern in order, placed by the lengths of
    what stands between them."""
    return f"""SELECT r, CAST(e - length(m) AS BIGINT) AS start, {k} AS kind, CAST(e AS BIGINT) AS "end", m FROM (
    SELECT r, m, g, sum(length(m) + length(b)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(bs[1:len(ms)]) AS b FROM (
        SELECT r, regexp_extract_all(t, {_text(pattern)}) AS ms, regexp_extract_all(t, {_text(pattern)}, {group}) AS gs, string_split_regex(t, {_text(pattern)}) AS bs FROM {source})))
  WHERE length(g) >= {least}"""


def secrets_sql() -> str:
    names = [x[0] for x in (*secrets.BASE, *secrets.CLASSES)]
    base = " UNION ALL ".join(_spans(k, p, g, n) for k, (_, p, g, n) in enumerate(secrets.BASE))
    allow = " OR ".join(f"regexp_matches(m, {_text(p)})" for p in secrets.ALLOW if "\\1" not in p)
    runs = "len(list_filter(range(1, length(m) - 6), lambda i: substr(m, i, 8) = repeat(substr(m, i, 1), 8))) > 0"
    terms = [round(c * math.log2(c) * secrets._SCALE) if c else 0 for c in range(secrets.WINDOW + 1)]
    kind = " ".join(
        f"WHEN {' AND '.join(f'regexp_matches(m, {_text(p)})' for p in (whole, *must))} THEN CASE WHEN peak >= {bits} THEN {len(secrets.BASE) + k} END" for k, (_, whole, must, bits) in enumerate(secrets.CLASSES)
    )
    label = "CASE kind " + " ".join(f"WHEN {k} THEN {_text(n)}" for k, n in enumerate(names)) + " END || ':' || start || ':' || \"end\""
    counts = ", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({base}),
cand AS ({_spans(0, secrets.CANDIDATE.split(")", 1)[1], 0, secrets.WINDOW)}),
fit AS (SELECT row_number() OVER () AS c, r, start, "end", m FROM cand WHERE NOT ({allow}) AND NOT ({runs}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = cand.r AND b.start < cand."end" AND cand.start < b."end")),
wins AS (SELECT c, unnest(range(1, length(m) - {secrets.WINDOW - 2})) AS i, m FROM fit),
chars AS (SELECT c, i, x, count(*) AS n FROM (SELECT c, i, unnest(string_split(substr(m, i, {secrets.WINDOW}), '')) AS x FROM wins) GROUP BY 1, 2, 3),
peaks AS (SELECT c, {math.log2(secrets.WINDOW)!r} - min(s) / ({secrets._SCALE} * {secrets.WINDOW}.0::DOUBLE) AS peak FROM (SELECT c, i, sum({terms}[n + 1]) AS s FROM chars GROUP BY 1, 2) GROUP BY 1),
added AS (SELECT r, start, kind, "end" FROM (SELECT r, start, "end", CASE {kind} END AS kind FROM fit JOIN peaks USING (c)) WHERE kind IS NOT NULL),
b AS (SELECT r, {counts}, string_agg({label}, ',' ORDER BY start, kind, "end") AS s FROM base GROUP BY 1),
a AS (SELECT r, string_agg({label}, ',' ORDER BY start, kind, "end") AS s FROM (SELECT r, start, kind, "end" FROM base UNION ALL SELECT * FROM added) GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{x[0]}, 0) AS n_{x[0]}" for x in secrets.BASE)}, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""


def collocations_sql(min_count: int = 10, top: int = 2000, min_share: int = 50) -> str:
    """Phrases of two and three words by counting alone."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
g1 AS (SELECT lang, w[i] AS phrase, count(*) AS f FROM spots GROUP BY ALL),
g2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM spots WHERE i + 1 <= len(w) GROUP BY ALL),
g3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM spots WHERE i + 2 <= len(w) GROUP BY ALL),
cuts AS (
  SELECT g2.lang, g2.x || ' ' || g2.y AS phrase, g2.f AS a, 1 AS k, b.f AS l, c.f AS r
  FROM g2 JOIN g1 b ON b.lang = g2.lang AND b.phrase = g2.x JOIN g1 c ON c.lang = g2.lang AND c.phrase = g2.y WHERE g2.f >= {min_count}
  UNION ALL
  SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z, g3.f, 1, b.f, c.f
  FROM g3 JOIN g1 b ON b.lang = g3.lang AND b.phrase = g3.x JOIN g2 c ON c.lang = g3.lang AND c.x = g3.y AND c.y = g3.z WHERE g3.f >= {min_count}
  UNION ALL
  SELECT g3.lang, g3.x || ' ' || g3.y || ' ' || g3.z, g3.f, 2, b.f, c.f
  FROM g3 JOIN g2 b ON b.lang = g3.lang AND b.x = g3.x AND b.y = g3.y JOIN g1 c ON c.lang = g3.lang AND c.phrase = g3.z WHERE g3.f >= {min_count}),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, x || ' ' || y AS phrase, f FROM g3 WHERE f >= {min_count} UNION ALL SELECT lang, y || ' ' || z, f FROM g3 WHERE f >= {min_count}) GROUP BY ALL),
kept AS (SELECT w.* FROM weakest w LEFT JOIN longer b ON b.lang = w.lang AND b.phrase = w.phrase WHERE b.f IS NULL OR 100 * b.f < {min_share} * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g1 GROUP BY lang)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= {top}"""
