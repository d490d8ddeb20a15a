"""DuckDB statements with the results of the queries that SQL can express on whole tables."""

from .url_reputation import SUFFIXES

LINE_DEDUP = r"""
WITH l AS (
  SELECT row, doc_id, pos, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos
        FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents))),
often AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN often o ON l.key = o.key
GROUP BY row
"""

_NORMAL = r"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ')"


def _pieces(text: str, level: int, where: str) -> str:
    """Whole, lines and paragraphs of a text, as normalised pieces."""
    cut = f"unnest(list_concat([{text}], string_split({text}, E'\\n'), string_split({text}, E'\\n\\n')))"
    return f"SELECT conv_id, turn, {level} AS level, {_NORMAL.format(x='piece')} AS key FROM (SELECT conv_id, turn, {cut} AS piece FROM m WHERE {where})"


CHAT_QUOTES = rf"""
WITH RECURSIVE said AS (SELECT conv_id, turn, min(text) AS said FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn),
m AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(c.text, '') AS text, ((7 * c.conv_id + c.turn) % 4 + 4) % 4 AS rule, nullif(a.said, '') AS one, nullif(b.said, '') AS two
  FROM conversations c LEFT JOIN said a ON a.conv_id = c.conv_id AND a.turn + 1 = c.turn LEFT JOIN said b ON b.conv_id = c.conv_id AND b.turn + 2 = c.turn),
own AS ({_pieces("text", 0, "true")}),
asked AS (
  SELECT DISTINCT conv_id, turn, level, key, length(key) - length(replace(key, ' ', '')) + 1 AS words
  FROM ({_pieces("one", 1, "rule IN (1, 3) AND one IS NOT NULL")} UNION ALL {_pieces("replace(one, ' ', chr(10))", 1, "rule = 2 AND one IS NOT NULL")} UNION ALL {_pieces("two", 2, "rule = 3 AND one IS NOT NULL AND two IS NOT NULL")})
  WHERE key <> ''),
origin AS (SELECT conv_id, key, min(turn) AS origin FROM own WHERE key <> '' GROUP BY conv_id, key),
hits AS (SELECT conv_id, turn, level, origin, sum(words) AS found FROM asked JOIN origin USING (conv_id, key) WHERE origin < turn GROUP BY ALL),
link AS (SELECT conv_id, turn, arg_max(origin, (10 - level) * 1e15 + found * 1e7 + origin) AS parent FROM hits GROUP BY conv_id, turn),
up AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM link
  UNION ALL SELECT up.conv_id, up.turn, l.parent, up.depth + 1 FROM up JOIN link l ON l.conv_id = up.conv_id AND l.turn = up.root),
top AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY conv_id, turn),
n AS (SELECT conv_id, turn, count(*) AS n FROM asked GROUP BY conv_id, turn)
SELECT m.conv_id, m.turn, role, parent AS parent_turn, coalesce(root, m.turn) AS thread_root, CAST(coalesce(depth, 0) AS BIGINT) AS depth, coalesce(n, 0) AS n_quotes,
       sha256(trim(text, E' \t\n\x0b\f\r')) AS body_sha256
FROM m LEFT JOIN link USING (conv_id, turn) LEFT JOIN top USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)
"""

URL_FILTER = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', ''), '\.\z', '') AS site FROM p),
judged AS (
  SELECT doc_id, max(bad) AS bad FROM (SELECT doc_id, CAST((quality = 0) OR (toxic = 1) AS INT) AS bad FROM labels)
  WHERE doc_id IS NOT NULL AND bad IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT site, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM q LEFT JOIN judged ON page_id = doc_id GROUP BY site),
h1 AS (
  SELECT *, CASE WHEN regexp_matches(site, '^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])\z') THEN site
                 WHEN array_to_string(string_split(site, '.')[-2:], '.') IN (@SUFFIXES) THEN array_to_string(string_split(site, '.')[-2:], '.')
                 ELSE list_extract(string_split(site, '.'), -1) END AS suffix FROM h0),
h AS (
  SELECT *, CASE WHEN site = suffix THEN site
                 ELSE list_extract(string_split(left(site, length(site) - length(suffix) - 1), '.'), -1) || '.' || suffix END AS domain FROM h1),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY suffix),
sums AS (
  SELECT level, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE * n) AS n2, sum(k::DOUBLE * k / n) AS k2, count(*) AS g
  FROM (SELECT 1 AS level, n, k FROM h UNION ALL SELECT 2, n, k FROM d UNION ALL SELECT 3, n, k FROM s) WHERE n > 0 GROUP BY level),
between_groups AS (
  SELECT *, CASE WHEN n > n2 / n THEN (k2 - n * (k / n) * (k / n) - (g - 1) * (k / n) * (1 - k / n)) / (n - n2 / n) ELSE 0 END AS v FROM sums),
w AS (
  SELECT level, CASE WHEN k <= 0 OR k >= n OR g < 2 OR v <= 0 THEN 10.0
                     ELSE least(greatest((k / n) * (1 - k / n) / v - 1, 1.0), 10.0) END AS w FROM between_groups),
prior AS (SELECT coalesce((SELECT k / n FROM sums WHERE level = 3), 0) AS rate, coalesce((SELECT w FROM w WHERE level = 1), 10.0) AS wh,
                 coalesce((SELECT w FROM w WHERE level = 2), 10.0) AS wd, coalesce((SELECT w FROM w WHERE level = 3), 10.0) AS ws),
rated AS (
  SELECT site, h.n, h.k, rate, (h.k + wh * ((d.k + wd * ((s.k + ws * rate) / (s.n + ws))) / (d.n + wd))) / (h.n + wh) AS q, h.n + wh AS size
  FROM h JOIN d USING (domain) JOIN s ON s.suffix = h.suffix, prior),
r AS (
  SELECT page_id, host, path, n, k, q - 0.6745 * sqrt(q * (1 - q) / (size + 1)) AS bound, rate,
         CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q JOIN rated USING (site))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 1.0 * rate THEN 'block' ELSE 'allow' END AS verdict,
       n AS n_labelled, k AS n_bad
FROM r
""".replace("@SUFFIXES", ", ".join(f"'{s}'" for s in SUFFIXES))


def _share(level: str, path: str, parent: str | None, weight: str, budget: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    last = path.split(", ")[-1]
    order = ", ".join(f"{c} ASC NULLS FIRST" for c in path.split(", "))
    join = f"JOIN g_{budget} g ON " + " AND ".join(f"n.{c} IS NOT DISTINCT FROM g.{c}" for c in parent.split(", ")) if parent else ""
    given = "g.give" if parent else "(SELECT CAST(floor(0.5 * sum(tokens)) AS HUGEINT) FROM leaf)"
    return f"""
n_{level} AS (SELECT n.*, {given} AS budget FROM (SELECT {path}, sum(tokens * 2)::HUGEINT AS cap, ({weight.format(c=last)})::HUGEINT AS w FROM leaf GROUP BY {path}) n {join}),
a_{level} AS (
  SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p,
         coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw, sum(w) OVER ({by}) AS tw
  FROM n_{level} WHERE w > 0 WINDOW o AS ({by} ORDER BY cap / w, {order})),
b_{level} AS (SELECT *, cap::DOUBLE * (tw - pw)::DOUBLE <= (budget - p)::DOUBLE * w::DOUBLE AS filled FROM a_{level}),
c_{level} AS (SELECT *, coalesce(sum(cap) FILTER (WHERE filled) OVER ({by}), 0) AS sc, coalesce(sum(w) FILTER (WHERE filled) OVER ({by}), 0) AS sw FROM b_{level}),
g_{level} AS (SELECT {path}, CASE WHEN filled THEN cap ELSE least(((budget - sc) * w) // (tw - sw), cap) END AS give FROM c_{level}),"""


MIXING = rf"""
WITH r AS (
  SELECT doc_id, lang, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE WHEN regexp_matches(source, '[0-3]$') THEN 'web' WHEN regexp_matches(source, '[4-6]$') THEN 'books' WHEN regexp_matches(source, '[7-9]$') THEN 'code' ELSE 'other' END AS domain
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM r GROUP BY domain, lang, source),
{_share("domain", "domain", None, "CASE {c} WHEN 'web' THEN 5 WHEN 'books' THEN 3 WHEN 'code' THEN 2 ELSE 1 END", "")}
{_share("lang", "domain, lang", "domain", "CASE {c} WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END", "domain")}
{_share("source", "domain, lang, source", "domain, lang", "CASE {c} WHEN 'src0' THEN 3 ELSE 1 END", "lang")}
placed AS (
  SELECT r.*, give // tokens AS whole, give % tokens AS rest, md5('7:' || (give // tokens + 1) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM r JOIN leaf l ON r.domain = l.domain AND r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source
  JOIN g_source g ON r.domain = g.domain AND r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
  WHERE tokens > 0),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) AS c FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN rest > 0 AND c <= rest THEN 1 ELSE 0 END AS INT) AS copies
FROM summed WHERE whole > 0 OR (rest > 0 AND c <= rest)
"""
