"""DuckDB SQL for the queries that SQL can express, written from the operators' definitions."""

from __future__ import annotations

from quarterlight.llm import credentials, decontamination, drift_clusters, line_rules, phrases

SQL: dict[str, str] = {}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


NO_SPACE = "regexp_replace({}, '[ \\t\\n\\x0b\\f\\r]+', '', 'g')"


def op7() -> str:
    ink = f"length({NO_SPACE.format('line')})"
    symbols = f"(length(line) - length(regexp_replace(line, {quoted(line_rules.SYMBOLS)}, '', 'g')))"
    mark = lambda c: f"(length(line) - length(replace(line, '{c}', '')))"
    blanks = f"(length(line) - {ink})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') AS words FROM d),
win AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + {line_rules.WINDOW}], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - {line_rules.WINDOW - 1})) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT doc_id, sum(n) AS n_repeat_words FROM (
    SELECT doc_id, least({line_rules.WINDOW}, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), {line_rules.WINDOW})) AS n FROM twice)
  GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
judged AS (
  SELECT doc_id, line, {ink} AS ink, {symbols} AS symbols,
    {ink} > 0 AND ({symbols} * 10 >= {ink}
      OR ({mark('!')} >= 3 AND contains(line, '!!') AND {mark('!')} * 20 >= {ink})
      OR ({blanks} >= {line_rules.UNMARKED_BLANKS} AND NOT regexp_matches(line, {quoted(line_rules.MARKS)}))
      OR ({blanks} <= {line_rules.NOTICE_BLANKS} AND regexp_matches(line, {quoted(line_rules.NOTICE_ANY_CASE)}))
      OR {mark('|')} >= 3) AS fails
  FROM lines),
per AS (
  SELECT doc_id, sum(ink) AS word_chars, sum(symbols) AS n_symbols,
    count(*) FILTER (WHERE ink > 0) - count(DISTINCT line) FILTER (WHERE ink > 0) AS n_dup_lines,
    coalesce(sum(ink) FILTER (WHERE fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id),
b AS (
  SELECT doc_id, len(words) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(words) < 20 OR coalesce(n_repeat_words, 0) * 100 > len(words) * 30 AS base_failed
  FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND lost_chars * 100 <= word_chars * 60 AS kept, lost_chars::BIGINT AS lost_chars
FROM b JOIN per USING (doc_id)"""


def op1() -> str:
    """Matches alternate with the pieces between them, so their places are running sums of lengths."""
    parts = []
    for order, (kind, pattern) in enumerate(credentials.PATTERNS.items()):
        parts.append(f"""
  SELECT doc_id, '{kind}' AS kind, {order} AS ord, unnest(regexp_extract_all(text, {quoted(pattern)})) AS hit,
    unnest(string_split_regex(text, {quoted(pattern)})[:-2]) AS gap,
    generate_subscripts(regexp_extract_all(text, {quoted(pattern)}), 1) AS k FROM d""")
    cases = " ".join(
        f"WHEN '{kind}' THEN length(regexp_extract(hit, {quoted(credentials.PATTERNS[kind])}, {group}))"
        for kind, group in credentials.VALUE_GROUP.items()
    )
    roles = " ".join(f"WHEN '{k}' THEN '{r}'" for k, r in credentials.ROLES.items())
    least = " ".join(f"WHEN '{k}' THEN {n}" for k, n in credentials.LEAST.items())
    strong = ", ".join(f"'{k}'" for k in credentials.STRONG)
    scope, digits = credentials.SCOPE, "regexp_replace(hit, '[^0-9]', '', 'g')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in credentials.STRONG)
    text = "kind || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT doc_id, kind, ord, hit, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER b, 0) AS start
  FROM raw WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k), b AS (PARTITION BY doc_id, kind ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
good AS (
  SELECT doc_id, kind, ord, start::BIGINT AS start, (start + length(hit))::BIGINT AS stop, CASE kind {roles} END AS role
  FROM placed WHERE CASE kind {cases} ELSE length(hit) END >= CASE kind {least} END
    AND (kind <> 'weak_secret' OR (length({digits}) >= {credentials.LEAST_DIGITS} AND length({digits}) < length(hit)))),
apart AS (
  SELECT * FROM good g WHERE kind IN ({strong}) OR NOT EXISTS (
    SELECT 1 FROM good s WHERE s.doc_id = g.doc_id AND s.kind IN ({strong}) AND s.start < g.stop AND g.start < s.stop)),
near AS (
  SELECT s.*, o.role AS other, {{'kind': o.kind, 'ord': o.ord, 'start': o.start, 'stop': o.stop}} AS partner, abs(o.start - s.start) AS far
  FROM apart s JOIN apart o ON o.doc_id = s.doc_id AND o.role <> 'secret' AND abs(o.start - s.start) <= {scope} WHERE s.role = 'secret'
  QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.kind, s.start, o.role ORDER BY abs(o.start - s.start), o.start) = 1),
creds AS (
  SELECT doc_id, kind, ord, start, stop, any_value(partner) FILTER (other = 'id') AS id, any_value(partner) FILTER (other = 'endpoint') AS endpoint, max(far) AS far
  FROM near GROUP BY ALL HAVING count(*) FILTER (other = 'id') > 0 OR kind IN ({strong})),
spans AS (
  SELECT doc_id, kind, ord, start, stop, kind IN ({strong}) AS base FROM apart WHERE kind IN ({strong})
  UNION SELECT doc_id, kind, ord, start, stop, kind IN ({strong}) FROM creds
  UNION SELECT doc_id, id.kind, id.ord, id.start, id.stop, id.kind IN ({strong}) FROM creds WHERE id IS NOT NULL
  UNION SELECT doc_id, endpoint.kind, endpoint.ord, endpoint.start, endpoint.stop, false FROM creds WHERE endpoint IS NOT NULL),
links AS (
  SELECT doc_id, count(*) AS n_credentials, string_agg(concat_ws('+', id.kind || ':' || id.start || ':' || id.stop, {text},
    endpoint.kind || ':' || endpoint.start || ':' || endpoint.stop) || '@' || far, ',' ORDER BY start, ord) AS credentials
  FROM creds GROUP BY doc_id),
per AS (
  SELECT doc_id, {counts}, string_agg({text}, ',' ORDER BY start, ord) FILTER (WHERE base) AS base,
    string_agg({text}, ',' ORDER BY start, ord) AS spans, count(*) FILTER (WHERE NOT base) AS n_linked
  FROM spans GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in credentials.STRONG)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked, coalesce(n_credentials, 0) AS n_credentials, coalesce(credentials, '') AS credentials
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN links USING (doc_id)"""


def op10() -> str:
    words = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {words.format("coalesce(text, '')")} AS words FROM benchmark),
wanted AS (
  SELECT DISTINCT item_id, len(gram) AS n, array_to_string(gram, ' ') AS gram FROM (
    SELECT item_id, words[i + 1:i + least({decontamination.WINDOW}, len(words))] AS gram
    FROM (SELECT *, unnest(range(0, greatest(1, len(words) - {decontamination.WINDOW - 1}))) AS i FROM b WHERE len(words) > 0))),
sizes AS (SELECT DISTINCT n FROM wanted),
win AS (
  SELECT doc_id, n, i, array_to_string(words[i + 1:i + n], ' ') AS gram
  FROM (SELECT doc_id, n, words, unnest(range(0, len(words) - n + 1)) AS i FROM d, sizes WHERE len(words) >= n)),
met AS (SELECT doc_id, i, win.n, item_id FROM win JOIN wanted USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op12() -> str:
    """All phrases of up to four words, counted plainly; longer ones are looked up word by word from each side."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    spell = lambda a, b: f"array_to_string(words[{a}:{b}], ' ')"
    return f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
every AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, words[i:i + size - 1] AS words FROM (
    SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM w, range(1, {phrases.LONGEST + 1}) AS s(size) WHERE len(words) >= size)),
f AS MATERIALIZED (SELECT lang, words, {spell("1", "len(words)")} AS phrase, count(*)::BIGINT AS f FROM grams GROUP BY lang, words HAVING count(*) >= {phrases.LEAST}),
inside AS (
  SELECT lang, {spell("a", "b")} AS phrase, max(f) AS around FROM (
    SELECT *, unnest(range(a + 1, least(len(words), a + len(words) - 2) + 1)) AS b FROM (SELECT *, unnest(range(1, len(words))) AS a FROM f WHERE len(words) > 2))
  WHERE b - a + 1 BETWEEN 2 AND len(words) - 1 GROUP BY ALL),
c AS (
  SELECT f.* FROM f LEFT JOIN inside USING (lang, phrase) WHERE len(words) > 1 AND NOT coalesce(100::HUGEINT * around >= {phrases.SUBSUMED}::HUGEINT * f, false)),
cuts AS (SELECT lang, phrase, f AS a, k, {spell("1", "k")} AS lp, {spell("k + 1", "len(words)")} AS rp FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ({phrases.SCORE}::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score FROM ranked JOIN every USING (lang) WHERE rank <= {phrases.TOP}"""


def op13(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Every round compares every vector with every centroid."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
a{turn} AS MATERIALIZED (
  SELECT rid, arg_min(j, (d, j)) AS cluster, min(d) AS distance FROM (
    SELECT rid, j, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS d FROM v JOIN c{turn} c USING (i) GROUP BY rid, j) GROUP BY rid)""")
        if turn < rounds:
            steps.append(f"""
c{turn + 1} AS MATERIALIZED (
  SELECT j, i, coalesce(m.x, c{turn}.x) AS x FROM c{turn} LEFT JOIN (
    SELECT cluster AS j, i, CASE WHEN sum(v.x) >= 0 THEN sum(v.x) // count(*) ELSE -((-sum(v.x) + count(*) - 1) // count(*)) END::BIGINT AS x
    FROM a{turn} JOIN v USING (rid) GROUP BY cluster, i) m USING (j, i))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({drift_clusters.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT rid, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM kept),
firsts AS (SELECT (row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), x) - 1)::INTEGER AS j, x FROM kept),
c0 AS MATERIALIZED (SELECT j, generate_subscripts(x, 1) AS i, unnest(x) AS x FROM firsts WHERE j < {k}),{",".join(steps)},
digests AS (SELECT j AS cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (rid) JOIN digests USING (cluster)"""


SQL["op12_phrase_stripes"] = op12()
SQL["op13_drift_clusters"] = op13()
SQL["op1_credential_links"] = op1()
SQL["op10_benchmark_overlap"] = op10()
SQL["op7_line_rules"] = op7()
