"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{x}'" for x in STOP_WORDS)

QUALITY_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) > 2
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r
), s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!]', '', 'g')) AS ex,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS st
  FROM w LEFT JOIN rep USING (r)
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, greatest(n_words, 1) AS per FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words >= 50 AND word_chars / per BETWEEN 2 AND 15 AND n_symbols / per <= 0.1 AND ex / per <= 0.3
        AND st / per >= 0.03 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_repeat_words / per <= 0.5) AS kept,
       round(n_symbols / per, 6) AS symbol_ratio, round(st / per, 6) AS stop_word_ratio,
       round(n_dup_lines / greatest(n_lines, 1), 6) AS dup_line_ratio
FROM f
"""

ORACLES = {"op7_quality_rules": QUALITY_RULES}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Candidates share one of the rarest shingles of both (a prefix filter loses none); links are exact; components by recursion.
MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)
), n AS (SELECT doc_id, count(*) AS n, sum(hash(g)::HUGEINT) AS sig FROM s GROUP BY doc_id
), cls AS (SELECT n, sig, min(doc_id) AS rep FROM n GROUP BY n, sig
), named AS (SELECT n.doc_id, n.n, rep FROM n JOIN cls USING (n, sig)
), r AS (SELECT s.doc_id, g, count(*) OVER (PARTITION BY g) AS df FROM s JOIN cls ON s.doc_id = rep
), p AS (SELECT r.doc_id, g, row_number() OVER (PARTITION BY r.doc_id ORDER BY df, g) AS k, n FROM r JOIN n USING (doc_id)
), pre AS (SELECT doc_id, g, n FROM p WHERE k <= n - ceil(0.85 * n) + 1
), cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
), link AS (
  SELECT a, b FROM cand c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 85 * (na + nb - count(*))
), e AS (SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (SELECT rep AS x, rep AS y FROM cls UNION SELECT x, b FROM reach JOIN e ON y = a
), comp AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(named.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN named USING (doc_id) LEFT JOIN comp ON x = rep
"""

#: Texts as hexadecimal digits, two for each byte.
REPEATS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (SELECT r, unnest(range(0, length(h) // 2 - 199)) AS i, unnest(list_transform(range(0, length(h) // 2 - 199), lambda i: md5_number(substr(h, 2 * i + 1, 400)))) AS x FROM d WHERE length(h) >= 400
), twice AS (SELECT r, i FROM g SEMI JOIN (SELECT x FROM g GROUP BY x HAVING count(*) > 1) t USING (x)
), runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(nw) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS nw FROM twice)) GROUP BY r, k
), kept AS (SELECT r, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS a, a AS b FROM runs UNION ALL SELECT d.r, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN runs USING (r) GROUP BY d.r
), text_ AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS rest FROM kept JOIN d USING (r) GROUP BY r
), gone AS (SELECT r, sum(b - a) AS n, count(*) AS k FROM runs GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM d JOIN text_ USING (r) LEFT JOIN gone USING (r)
"""

ORACLES |= {"op8_minhash_dedup": MINHASH, "op10_suffix_dedup": REPEATS}

#: The check sum's table by its polynomial, sums over the bytes of each distinct (document, run), and near words by what one deleted letter leaves.
SPELLING = r"""
WITH RECURSIVE bits AS (SELECT i, i::UBIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), runs AS (
  SELECT id, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL
), sums AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT::UBIGINT)), lambda c, b: xor(t[(xor(c, b) & 255)::INT + 1], c >> 8))) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS h FROM runs), crc
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM sums) GROUP BY word HAVING sum(n) >= 3 AND length(word) >= 5
), cut AS (SELECT DISTINCT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.rest, c.word FROM cut c SEMI JOIN words w ON w.word = c.rest UNION SELECT c.word, c.rest FROM cut c SEMI JOIN words w ON w.word = c.rest
), best AS (SELECT p.word, count(*) AS n_near, arg_min((p.other, o.n), (-o.n, p.other)) AS b FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word
), forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b[2] >= 2 * w.n THEN b[1] END AS form, CASE WHEN b[2] >= 2 * w.n THEN b[2] END AS form_n FROM words w LEFT JOIN best USING (word)
), way AS (SELECT word, word AS at_, 0 AS k FROM forms UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN forms f ON f.word = at_ WHERE f.form IS NOT NULL
)
SELECT word, form, (SELECT arg_max(at_, k) FROM way WHERE way.word = forms.word) AS root, n, n_near, form_n FROM forms
"""

ORACLES |= {"op13_spelling_variants": SPELLING}
