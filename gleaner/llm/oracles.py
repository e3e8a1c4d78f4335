"""DuckDB SQL of the registered queries that SQL can express; operators say in their docstrings what it computes."""

from __future__ import annotations

from . import licenses, urls

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def stupid_backoff() -> str:
    return rf"""
WITH words AS ({_WORDS}),
tok AS (SELECT doc_id, unnest(w) AS word, unnest([NULL] || w[:len(w) - 1]) AS a, unnest([NULL, NULL] || w[:len(w) - 2]) AS b FROM words WHERE len(w) > 1
  UNION ALL SELECT doc_id, w[1], NULL, NULL FROM words WHERE len(w) = 1),
one AS (SELECT word, count(*) AS n FROM tok GROUP BY word),
two AS (SELECT a, word, count(*) AS n FROM tok WHERE a IS NOT NULL GROUP BY a, word),
three AS (SELECT b, a, word, count(*) AS n FROM tok WHERE b IS NOT NULL GROUP BY b, a, word),
shorter AS (
  SELECT tok.*, CASE WHEN tok.a IS NULL THEN ln(w.n / t.n) WHEN two.n >= 2 THEN ln(two.n / c.n) ELSE ln(0.4) + ln(w.n / t.n) END AS s
  FROM tok JOIN one w ON w.word = tok.word LEFT JOIN one c ON c.word = tok.a
  LEFT JOIN two ON two.a = tok.a AND two.word = tok.word, (SELECT count(*) AS n FROM tok) t),
scored AS (
  SELECT x.doc_id, CASE WHEN x.b IS NULL THEN x.s WHEN three.n >= 2 THEN ln(three.n / c.n) ELSE ln(0.4) + x.s END AS s
  FROM shorter x LEFT JOIN three ON three.b = x.b AND three.a = x.a AND three.word = x.word LEFT JOIN two c ON c.a = x.b AND c.word = x.a),
sums AS (SELECT doc_id, count(*) AS n, sum(s) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_log_score
FROM documents d LEFT JOIN sums USING (doc_id)
"""


def near_duplicates(k: int, percent: int) -> str:
    return rf"""
WITH RECURSIVE words AS ({_WORDS}),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= {percent} * (p.n + q.n - common.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def url_trust(rules: list[str]) -> str:
    known = sorted(map(urls.Rule.of, rules), key=lambda r: -len(r.name))
    whens = " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in known)
    allowed = ", ".join(f"'{r.name}'" for r in known if r.allow)
    d = urls.DAMPING
    steps = [
        f"""r{i} AS (SELECT h.host, ({1 - d} + {d} * lost.t) * h.s + {d} * coalesce(f.t, 0) AS t, ({1 - d} + {d} * lost.d) * h.z + {d} * coalesce(k.d, 0) AS d FROM hosts h
  LEFT JOIN (SELECT e.dst AS host, sum(r.t / e.n_out) AS t FROM graph e JOIN r{i - 1} r ON r.host = e.src GROUP BY e.dst) f USING (host)
  LEFT JOIN (SELECT e.src AS host, sum(r.d / e.n_in) AS d FROM graph e JOIN r{i - 1} r ON r.host = e.dst GROUP BY e.src) k USING (host),
  (SELECT coalesce(sum(r.t) FILTER (x.n_out IS NULL), 0) AS t, coalesce(sum(r.d) FILTER (x.n_in IS NULL), 0) AS d FROM hosts x JOIN r{i - 1} r USING (host)) lost)"""
        for i in range(1, urls.ITERATIONS + 1)
    ]
    return rf"""
WITH parts AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), {_AZ}), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE {whens} END AS rule FROM parts),
seeds AS (SELECT host, count(*) FILTER (rule IN ({allowed})) AS a, count(*) FILTER (rule NOT IN ({allowed})) AS b FROM ruled WHERE rule IS NOT NULL GROUP BY host),
found AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)) AS target FROM ruled),
edges AS (SELECT DISTINCT src, dst FROM (SELECT src, translate(regexp_extract(target, '^(?i:https?:)?//([^/?#]*)', 1), {_AZ}) AS dst FROM found WHERE regexp_matches(target, '^(?i:https?:)?//')) WHERE src <> dst AND src <> '' AND dst <> ''),
graph AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS n_out, count(*) OVER (PARTITION BY dst) AS n_in FROM edges),
hosts AS (SELECT host, coalesce(s.a / nullif(x.a, 0), 0) AS s, coalesce(s.b / nullif(x.b, 0), 0) AS z, o.n_out, i.n_in
  FROM (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM seeds) LEFT JOIN seeds s USING (host)
  LEFT JOIN (SELECT DISTINCT src AS host, n_out FROM graph) o USING (host) LEFT JOIN (SELECT DISTINCT dst AS host, n_in FROM graph) i USING (host), (SELECT sum(a) AS a, sum(b) AS b FROM seeds) x),
r0 AS (SELECT host, s AS t, z AS d FROM hosts),
{", ".join(steps)}
SELECT page_id, p.host, path, rule, CASE WHEN rule IN ({allowed}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN r.d > {urls.RATIO} * r.t + 1e-12 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled p LEFT JOIN r{urls.ITERATIONS} r ON r.host = p.host
"""


def license_scan() -> str:
    templates = ", ".join(f"({_quoted(name)}, {i}, [{', '.join(map(_quoted, licenses.terms_of(text)))}])" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS id, doc_id, concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text FROM documents),
files AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, regexp_matches(regexp_extract(path, '[^/]*$'), '(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$') AS named,
  regexp_extract_all(translate(text, {_AZ}), '[a-z0-9]+(?:[.][0-9]+)*') AS terms FROM docs),
templates(name, i, terms) AS (VALUES {templates}),
pairs AS (SELECT name, i, unnest(terms) AS term FROM templates),
total AS (SELECT count(*) AS n FROM docs),
vocabulary AS (SELECT DISTINCT term FROM pairs),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(terms)) AS term FROM files) JOIN vocabulary USING (term) GROUP BY term),
idf AS (SELECT term, ln((1 + n) / (1 + coalesce(df, 0))) AS idf FROM vocabulary LEFT JOIN df USING (term), total),
weights AS (SELECT name, i, term, count(*) * any_value(idf) AS w FROM pairs JOIN idf USING (term) GROUP BY ALL),
unit AS (SELECT name, i, term, w / sqrt(sum(w * w) OVER (PARTITION BY i)) AS w FROM weights),
split AS (SELECT id, regexp_extract_all(translate(unnest(string_split_regex(regexp_replace(text, '([.!?;])[ \t\r]+', '\1' || chr(10), 'g'), '\n')), {_AZ}), '[a-z0-9]+(?:[.][0-9]+)*') AS terms FROM files),
numbered AS (SELECT id, row_number() OVER () AS passage, terms FROM split WHERE len(terms) > 0),
passages AS (SELECT id, passage, terms FROM numbered UNION ALL SELECT id, -1, terms FROM files),
counted AS (SELECT id, passage, term, count(*) AS tf FROM (SELECT id, passage, unnest(terms) AS term FROM passages) GROUP BY ALL),
weighed AS (SELECT id, passage, term, tf * coalesce(idf, ln(1 + n)) AS w FROM counted LEFT JOIN idf USING (term), total),
lengths AS (SELECT id, passage, sqrt(sum(w * w)) AS length FROM weighed GROUP BY ALL),
close AS (SELECT id, passage, name, round(sum(x.w * u.w) / any_value(length), 9) AS cosine FROM weighed x JOIN unit u USING (term) JOIN lengths USING (id, passage) GROUP BY id, passage, name, i HAVING cosine >= {licenses.THRESHOLD}),
best AS (SELECT id, arg_min(name, (-cosine, name)) AS own, max(cosine) AS cosine, bool_or(passage < 0) AS whole FROM close GROUP BY id),
rows AS (SELECT id, doc_id, path, directory, own, cosine, coalesce(whole OR named, false) AND own IS NOT NULL AS is_file FROM files LEFT JOIN best USING (id)),
held AS (SELECT directory, arg_min(own, (-cosine, own)) AS theirs FROM rows WHERE is_file GROUP BY directory),
nearest AS (SELECT id, arg_max(theirs, length(h.directory)) AS theirs FROM rows r JOIN held h ON h.directory = '' OR r.directory = h.directory OR starts_with(r.directory, h.directory || '/') WHERE own IS NULL GROUP BY id)
SELECT doc_id, path, own, cosine, is_file, coalesce(own, theirs) AS license FROM rows LEFT JOIN nearest USING (id)
"""
