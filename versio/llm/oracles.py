"""DuckDB SQL of the queries that SQL can express."""

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM b))),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

#: Listed domains of the URL filter (fixed values): each with its subdomains. Listed
#: besides are the hosts and the hosts with path of all pages whose MD5 starts with
#: this digit, so that the list grows with the pages.
LISTED_MD5 = "a"
LISTED_DOMAINS = ["adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net",
                  "free-bets.example.net", "spam-farm.example.org"]
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

_FITS = "((host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}'))"
URL_FILTER = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT DISTINCT unnest([host, host || path]) AS key FROM p WHERE host <> ''),
l AS (SELECT list(key) AS keys FROM (SELECT key FROM k WHERE starts_with(md5(key), '{LISTED_MD5}')
      UNION SELECT unnest({LISTED_DOMAINS!r}))),
h AS (SELECT *, string_split(host, '.') AS labels FROM p),
q AS (SELECT *, CASE {" ".join(f"WHEN {_FITS.format(*pat.split('/', 1))} THEN '{pat}'" for pat, _ in
                               sorted(URL_RULES, key=lambda x: -len(x[0])))} END AS rule,
             host <> '' AND list_has_any(list_append(list_transform(range(1, len(labels) + 1), lambda i: array_to_string(labels[i:], '.')),
                                                     host || path), (SELECT keys FROM l)) AS listed FROM h)
SELECT page_id, host, path, rule, listed,
       CASE {" ".join(f"WHEN rule = '{pat}' THEN '{v}'" for pat, v in URL_RULES)}
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM q"""

_PLAIN = "replace({}, '<|', '< |')"
CHAT = f"""
WITH g AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS n FROM conversations GROUP BY ALL),
t AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1) // 64 AS block FROM g),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
s AS (SELECT t.conv_id, perspective, CAST(block AS BIGINT) AS block, turn, role, n,
             role IS NOT DISTINCT FROM perspective AS own, {_PLAIN.format("text")} || '<|end|>' || chr(10) AS body, text,
             CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
                  WHEN role IS NULL THEN '<|user|>' ELSE '<|user name=' || {_PLAIN.format("role")} || '|>' END || chr(10) AS head
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, block
             ORDER BY turn NULLS FIRST, role NULLS FIRST, text) AS stop FROM s)
SELECT conv_id, perspective, block, first(turn ORDER BY stop) AS from_turn, CAST(count(*) AS INTEGER) AS n_turns,
       CAST(sum(n) AS BIGINT) AS n_rows, string_agg(head || body, '' ORDER BY stop) AS text,
       coalesce(list(CAST(stop - length(body) AS INTEGER) ORDER BY stop) FILTER (WHERE own), []) AS mask_starts,
       coalesce(list(CAST(stop AS INTEGER) ORDER BY stop) FILTER (WHERE own), []) AS mask_ends
FROM o GROUP BY conv_id, perspective, block"""

WARC = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                  row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS FIRST) AS nth,
                  first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS FIRST) AS least
           FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN nth = 1 OR payload_bytes < 100 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nth > 1 AND payload_bytes >= 100 THEN least END AS refers_to
FROM p"""
