"""Registered query: hosts beyond ASCII in URLs.

The oracle states Punycode as RFC 3492's encoder does, digit by digit in a recursive
query, on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegraph.functions import urls as U
from sitegraph.plans.catalog import register
from sitegraph.sources.fixtures import table

# Hosts of the pages with some letters replaced by others from three scripts.
RAW_URL = "'http://' || translate(split_part(url, '/', 3) || '.' || page_id || 'o', 'aeio07', 'äéжö日ü') || '/p'"

_ORACLE = f"""
WITH RECURSIVE u AS (SELECT page_id, url, {RAW_URL} AS raw FROM pages),
lab AS (SELECT page_id, i, lower(string_split(split_part(raw, '/', 3), '.')[i]) AS label
        FROM (SELECT *, unnest(range(1, len(string_split(split_part(raw, '/', 3), '.')) + 1)) AS i FROM u)),
word AS (SELECT DISTINCT label FROM lab WHERE regexp_matches(label, '[^\\x00-\\x7F]')),
ch AS (SELECT label, k, ord(substr(label, k, 1)) AS c FROM (SELECT label, unnest(range(1, length(label) + 1)) AS k FROM word)),
ins AS (SELECT label, c, (SELECT count(*) FROM ch b WHERE b.label = a.label AND b.k < a.k AND b.c <= a.c) AS pos,
               row_number() OVER (PARTITION BY label ORDER BY c, k) AS j,
               lag(c) OVER (PARTITION BY label ORDER BY c, k) AS c0 FROM ch a WHERE c >= 128),
step AS (SELECT label, j, h, (c - coalesce(c0, 128)) * (h + 1) + pos - CASE WHEN j = 1 THEN 0 ELSE p0 + 1 END AS delta
         FROM (SELECT *, lag(pos) OVER (PARTITION BY label ORDER BY j) AS p0,
                      (SELECT count(*) FROM ch b WHERE b.label = ins.label AND b.c < 128) + j - 1 AS h FROM ins)),
damp AS (SELECT *, CASE WHEN j = 1 THEN delta // 700 ELSE delta // 2 END AS half FROM step),
damped AS (SELECT *, half + half // (h + 1) AS d FROM damp),
folds AS (SELECT *, CASE WHEN d <= 455 THEN 0 WHEN d // 35 <= 455 THEN 1 WHEN d // 1225 <= 455 THEN 2
                         WHEN d // 42875 <= 455 THEN 3 ELSE 4 END AS f FROM damped),
biases AS (SELECT label, j, delta, coalesce(lag(b) OVER (PARTITION BY label ORDER BY j), 72) AS bias FROM
           (SELECT *, 36 * f + (36 * (d // CAST(pow(35, f) AS BIGINT))) // (d // CAST(pow(35, f) AS BIGINT) + 38) AS b FROM folds)),
dig AS (SELECT label, j, 1 AS n, bias, CAST(delta AS BIGINT) AS q, CAST(NULL AS BIGINT) AS digit FROM biases
        UNION ALL
        SELECT label, j, n + 1, bias, CASE WHEN q < t THEN -1 ELSE (q - t) // (36 - t) END,
               CASE WHEN q < t THEN q ELSE t + (q - t) % (36 - t) END
        FROM (SELECT *, least(greatest(36 * n - bias, 1), 26) AS t FROM dig WHERE q >= 0)),
code AS (SELECT label, string_agg(substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST(digit + 1 AS INTEGER), 1), '' ORDER BY j, n) AS tail
         FROM dig WHERE digit IS NOT NULL GROUP BY label),
coded AS (SELECT label, 'xn--' || regexp_replace(label, '[^\\x00-\\x7F]', '', 'g')
                        || CASE WHEN regexp_matches(label, '[\\x00-\\x7F]') THEN '-' ELSE '' END || tail AS ace FROM code),
hosts AS (SELECT page_id, string_agg(coalesce(ace, lab.label), '.' ORDER BY i) AS h
          FROM lab LEFT JOIN coded ON lab.label = coded.label GROUP BY page_id)
SELECT u.page_id, raw, 'http://' || h || '/p' AS normalised, regexp_replace(h, '^www\\.', '') AS domain FROM u JOIN hosts ON u.page_id = hosts.page_id
"""


@register("url_idna", _ORACLE)
def q_url_idna(spark, sf):
    raw = table(spark, sf, "pages").select("page_id", F.expr(RAW_URL).alias("raw"))
    return raw.select("page_id", "raw", U.normalise("raw").alias("normalised"), U.domain("raw").alias("domain"))
