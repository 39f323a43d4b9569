"""DuckDB SQL that returns the rows of queries, where SQL says the same: whole tables, no shortcuts."""

#: Exact near-duplicates: all pairs by a join on hashed shingles, and what links reach.
NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN [w] ELSE list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]]) END) AS s FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
ids AS (SELECT doc_id, hash(s) AS h FROM shingles),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM ids a JOIN ids b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 80 * (x.n + y.n - met.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.other),
least AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) JOIN least ON node = doc_id
"""

#: Every substring of 200 bytes, by its digest; what those that occur again cover.
REPEATS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
p AS (SELECT doc_id, b, unnest(range(0, n - 199)) AS i FROM n WHERE n >= 200), h AS (SELECT doc_id, i, md5_number(b[i + 1 : i + 200]) AS h FROM p),
again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1), hit AS (SELECT doc_id, i FROM h JOIN again USING (h)),
s AS (SELECT *, CASE WHEN i <= lag(i) OVER w + 200 THEN 0 ELSE 1 END AS st FROM hit WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, sum(st) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM s),
r AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY doc_id, g),
k AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS q, z FROM r UNION ALL SELECT m.doc_id, n.n, m.z, NULL FROM n JOIN (SELECT doc_id, max(z) AS z FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id),
t AS (SELECT k.doc_id, string_agg(hex(CASE WHEN a > q THEN b[q + 1 : a] ELSE ''::BLOB END), '' ORDER BY q) AS kept, sum(z - a) AS gone, count(z) AS runs FROM k JOIN n ON n.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(runs, 0) AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256 FROM n LEFT JOIN t USING (doc_id)
"""

#: Targets by one pass over sources; draws in order, with running sums.
MIX = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, (CAST('0x' || substr(md5('17-' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS tokens, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(rank - 1) % 3 + 1] AS weight, tokens * 2.0::DOUBLE AS cap FROM sources),
levels AS (SELECT *, (sum(tokens) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, tokens, least(cap, coalesce(weight * max(CASE WHEN level * weight <= cap THEN level END) OVER (), cap)) AS target FROM levels),
rated AS (SELECT s.*, tokens AS source_size, target, CASE WHEN tokens > 0 THEN least(target / tokens, 2.0) ELSE 0 END AS rate FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
drawn AS (SELECT *, floor(rate + 1e-9) AS whole, CASE WHEN rate - floor(rate + 1e-9) > 1e-9 THEN u / (rate - floor(rate + 1e-9)) END AS draw FROM rated),
summed AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need, sum(CASE WHEN draw IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY draw NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM drawn)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * CASE WHEN rate > 0 THEN whole + CASE WHEN draw IS NOT NULL AND upto - size / 2.0 <= need THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS taken FROM summed
"""

#: Masks by documents, then every order of five letters, and each step's counts from the masks.
AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
told AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
firsts AS (SELECT sha256(text) AS digest, min(doc_id) AS least FROM d GROUP BY 1),
w AS (SELECT d.doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(d.doc_id > least, false) AS copy, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM d JOIN firsts ON digest = sha256(text) LEFT JOIN told ON told.doc_id = d.doc_id),
m AS (SELECT part, good, toxic, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * copy::INT AS mask FROM w),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
letters AS (SELECT unnest(range(5)) AS k),
orders AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
sets AS (SELECT array_to_string(list_transform(o, lambda x: 'ABCDE'[x + 1]), '') AS filter_order, step, o[step] AS f, list_sum(list_transform(o[1:step], lambda x: 1 << x))::BIGINT AS upto, coalesce(list_sum(list_transform(o[1:step - 1], lambda x: 1 << x)), 0)::BIGINT AS earlier FROM steps),
counted AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & earlier = 0 AND (mask >> f) & 1 = 1 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & earlier <> 0 AND (mask >> f) & 1 = 1 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = 1 << f THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & earlier = 0 AND (mask >> f) & 1 = 1 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & earlier = 0 AND (mask >> f) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost FROM cells, sets GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM counted
"""

#: CRC-32 of ids from its table; each rebuilt conversation's prefixes as lists of turns; subtree sums over all ancestors.
TRIE = r"""
WITH RECURSIVE bits AS (SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS k FROM range(256) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT c, c - c % 5 AS lead, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) % 9 AS h FROM ids, crc),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(turn ORDER BY k) AS own FROM turns GROUP BY c),
built AS (SELECT heads.c, list_concat(coalesce(lead.own, []::STRUCT(role VARCHAR, text VARCHAR)[])[1:h], lists.own[h + 1:]) AS turns FROM heads JOIN lists ON lists.c = heads.c LEFT JOIN lists lead ON lead.c = heads.lead),
prefixes AS (SELECT c, d, turns[1:d] AS node, len(turns) = d AS last FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)),
nodes AS (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM prefixes GROUP BY d, node),
edges AS (SELECT n.*, p.conv_id AS parent_conv_id, CASE WHEN n.d > 0 THEN (n.n_convs - 1) * strlen(n.node[n.d].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN nodes p ON p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]),
children AS (SELECT d - 1 AS d, parent_conv_id AS conv_id, count(*) AS n_children FROM edges WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT e.*, coalesce(n_children, 0) AS n_children FROM edges e LEFT JOIN children USING (d, conv_id)),
sums AS (SELECT a.d, a.node, sum((b.n_children = 0)::INT) AS n_leaves, sum(b.saved) AS saved FROM (SELECT *, unnest(range(d + 1)) AS up FROM full_) b JOIN nodes a ON a.d = b.up AND a.node = b.node[1:b.up] GROUP BY 1, 2)
SELECT conv_id, f.d::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, ends_sha256 FROM full_ f JOIN sums s ON s.d = f.d AND s.node = f.node
"""

#: The first page of each payload, and SHA-1 written five bits at a time.
WARC = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS hex, sha256(coalesce(html, '')) AS same FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY same) AS least FROM p),
b AS (SELECT *, list_transform(range(4), lambda k: ('0x' || hex[k * 10 + 1 : k * 10 + 10])::BIGINT) AS parts FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((parts[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1]), '') AS payload_digest, CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to FROM b
"""

ORACLE = {
    "op4_entropy_mix": MIX,
    "op5_minhash_bayes": NEAR_DUPLICATES,
    "op9_suffix_merge": REPEATS,
    "op11_swap_audit": AUDIT,
    "op12_heavy_path_trie": TRIE,
    "op13_warc_archives": WARC,
}
