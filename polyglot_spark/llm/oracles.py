"""DuckDB SQL of training-data queries that it can express."""

#: CRC-32 of the bytes of a text, as a list_reduce over them with a table worked out from the polynomial.
_TABLE = """SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)::BIGINT[]),
         lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab"""


def _crc32(text: str) -> str:
    raw = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {raw}), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _leaf(text: str) -> str:
    cell = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    return "sha256(" + " || ".join(map(cell, ("doc_id", "source", "lang", "n_chars", text))) + ")"


OP11 = f"""
WITH RECURSIVE crc AS ({_TABLE}),
d AS (SELECT *, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN translate(text, '{_CAPITALS}', '{_SMALL}') ELSE text END AS found FROM documents, crc),
l AS (SELECT doc_id, lang, {_leaf('text')} AS leaf, {_leaf('found')} AS now FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM l),
t AS (
  SELECT lang, 0 AS level, place, leaf AS node, n FROM p
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM t WHERE n > 1 GROUP BY lang, level, place // 8, n),
s AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
c AS (
  SELECT 0 AS level, rank AS place, subroot AS node, n FROM s
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (n + 7) // 8 FROM c WHERE n > 1 GROUP BY level, place // 8, n),
ts AS (SELECT lang, level, place, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
         || coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
       FROM t WHERE n > 1 WINDOW w AS (PARTITION BY lang, level, place // 8 ORDER BY place)),
cs AS (SELECT level, place, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|'
         || coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS step
       FROM c WHERE n > 1 WINDOW w AS (PARTITION BY level, place // 8 ORDER BY place)),
own AS (SELECT p.lang, p.place, list(ts.step ORDER BY ts.level) AS steps
        FROM p JOIN ts ON p.lang IS NOT DISTINCT FROM ts.lang AND ts.place = p.place // (8 ** ts.level)::BIGINT GROUP BY ALL),
top AS (SELECT s.lang, list(cs.step ORDER BY cs.level) AS steps FROM s JOIN cs ON cs.place = s.rank // (8 ** cs.level)::BIGINT GROUP BY ALL),
f AS (SELECT p.doc_id, p.leaf, p.now, s.subroot, (SELECT node FROM c WHERE n = 1) AS root, list_concat(coalesce(own.steps, []), coalesce(top.steps, [])) AS steps
      FROM p JOIN s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN own ON own.lang IS NOT DISTINCT FROM p.lang AND own.place = p.place
      LEFT JOIN top ON top.lang IS NOT DISTINCT FROM p.lang),
g AS (SELECT *, list_reduce(list_prepend(now, steps), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM g
"""


def _features(name: str, of: str) -> str:
    return rf"""{name}w AS (
  SELECT {'doc_id, ' if of == 'documents' else ''}row_number() OVER () AS row, coalesce(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM {of}),
{name} AS (
  SELECT row, array_to_string(w[i : i + n - 1], ' ') AS feature
  FROM (SELECT row, w, unnest(range(1, len(w) + 1)) AS i FROM {name}w), range(1, 4) AS r(n) WHERE i + n - 1 <= len(w))"""


OP13 = f"""
WITH crc AS ({_TABLE}),
{_features('a', 'documents')},
{_features('b', 'benchmark')},
h AS (SELECT feature, {_crc32('feature')} % 10000 AS bucket FROM (SELECT feature FROM a UNION SELECT feature FROM b), crc),
s AS (SELECT bucket, count(*) AS s FROM a JOIN h USING (feature) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN h USING (feature) GROUP BY bucket),
g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
             / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM a JOIN h USING (feature) JOIN g USING (bucket) GROUP BY row),
d AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM aw LEFT JOIN w USING (row)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN n_words >= 20 AND place <= n * 5 // 100 THEN place END AS rank FROM r
"""
