"""The same results in DuckDB SQL, where SQL can express them.

Raking with sampling, near-duplicate classes, BPE, toxicity and extraction have no statement; tests
hold them against brute force, a library or held-out labels.
"""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT r, list(DISTINCT i + k) AS places
  FROM win SEMI JOIN again USING (h) CROSS JOIN range(0, 35) AS t(k) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(len(places), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN places IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
),
grams AS (
  SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM grams SEMI JOIN twice USING (r, g) CROSS JOIN range(0, 5) AS t(k) GROUP BY r),
counts AS (
  SELECT r, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN covered USING (r)
),
f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    {{'symbols': n_symbols / greatest(word_chars, 1), 'upper': n_upper / greatest(word_chars, 1), 'lines': n_dup_lines / greatest(n_lines, 1),
      'grams': n_repeat_words / greatest(n_words, 1), 'words': (n_words - n_distinct) / greatest(n_words, 1)}} AS m
  FROM counts
),
levels AS (
  SELECT r, stratum, base_failed, doc_id, rule, least(greatest(CAST(ceil(x * 20) AS INTEGER) - 1, 0), 19) AS level
  FROM (SELECT r, stratum, base_failed, doc_id, unnest(['symbols', 'upper', 'lines', 'grams', 'words']) AS rule,
          unnest([m.symbols, m.upper, m.lines, m.grams, m.words]) AS x FROM f)
),
marks AS (SELECT doc_id, min(quality) >= 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT * FROM levels JOIN marks USING (doc_id) WHERE NOT base_failed),
cuts AS (
  SELECT stratum, rule, cut, count(*) FILTER (good) AS n, count(*) FILTER (good AND level >= cut) AS g, count(*) FILTER (NOT good AND level >= cut) AS b
  FROM held CROSS JOIN range(1, 20) AS t(cut) GROUP BY ALL
),
tested AS (
  SELECT *, g <= n * 0.004 AND list_sum(list_transform(range(0, g + 1),
      lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - CASE WHEN i = n THEN 0 ELSE lgamma(n - i + 1) END + i * ln(0.004) + (n - i) * ln(0.996))))
    <= 0.05 / 5 / (SELECT count(DISTINCT stratum) FROM held) AS ok
  FROM cuts
),
sure AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY cut DESC) AS certified FROM tested),
chosen AS (
  SELECT stratum, rule, cut FROM sure WHERE certified
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY b - g DESC, cut DESC) = 1
),
failed AS (SELECT DISTINCT r FROM levels JOIN chosen USING (stratum, rule) WHERE level >= cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed.r IS NULL AS kept
FROM f LEFT JOIN failed USING (r)"""

WARC = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p"""

TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, len(a.q) AS size, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, size ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, source, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
  FROM (SELECT r, doc_id, source, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
),
wide AS (SELECT line, min(doc_id) AS home FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 8),
gone AS (SELECT r, list(i) AS places FROM l JOIN wide USING (line) WHERE doc_id IS DISTINCT FROM home OR home IS NULL GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, coalesce(len(places), 0) AS n_removed,
  CASE WHEN places IS NULL THEN text
       ELSE array_to_string(list_filter(lines, lambda x, i: NOT list_contains(places, i)), chr(10)) END AS text
FROM d LEFT JOIN gone USING (r)"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
item AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
phrase AS (
  SELECT DISTINCT item_id, len(p) AS size, array_to_string(p, ' ') AS p
  FROM (SELECT item_id, w[i:i + 9] AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0))
),
win AS (
  SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT size FROM phrase) AS s WHERE len(w) >= size)
),
found AS (SELECT * FROM win SEMI JOIN phrase USING (size, p)),
hit AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(i, i + size)) AS place FROM found) GROUP BY r),
which AS (
  SELECT r, count(*) AS n, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found JOIN phrase USING (size, p) WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(which.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, hit.n IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN which USING (r)"""


def _vector_codes(rounds: int = 6) -> str:
    """Rounds of assignment and replacement, one after the other; integers are exact as doubles here."""
    near = """
  SELECT r, p, any_value(x) AS x, min({'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'e': e}) AS best
  FROM part JOIN book__ USING (p) GROUP BY r, p"""
    steps = []
    for k in range(rounds):
        steps.append(f"near_{k} AS MATERIALIZED ({near.replace('book__', f'book_{k}')})")
        steps.append(f"""mean_{k} AS (
  SELECT p, e, list(c ORDER BY i) AS c FROM (
    SELECT p, best.e AS e, i, floor(sum(x[i]) / count(*)) AS c FROM near_{k} CROSS JOIN (SELECT unnest(range(1, (SELECT any_value(len(x)) FROM part) + 1)) AS i) GROUP BY p, best.e, i
  ) GROUP BY p, e
)""")
        steps.append(f"book_{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean_{k}.c, book_{k}.c) AS c FROM book_{k} LEFT JOIN mean_{k} USING (p, e))")
    steps.append(f"near_{rounds} AS MATERIALIZED ({near.replace('book__', f'book_{rounds}')})")
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
part AS MATERIALIZED (SELECT r, p, q[p * len(q) // 8 + 1:(p + 1) * len(q) // 8] AS x FROM v CROSS JOIN range(8) AS t(p)),
book_0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM part WHERE r <= 16),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near_{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book_{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN coded USING (r) CROSS JOIN digest"""


# Bytes of an id, a colon and letters up to U+00FF; the table of the checksum comes from its polynomial.
SPELLING = rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc FROM (SELECT unnest(range(256)) AS n)
),
run AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL
),
spelt AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END)) AS bytes
  FROM run
),
hashed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda h, b: xor(h >> 8, crc[(xor(h, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM spelt CROSS JOIN t
),
word AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
cut AS MATERIALIZED (
  SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS rest, left(word, i - 1) || '*' || substr(word, i + 1) AS gap
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut AS a JOIN cut AS b USING (gap) WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut AS a JOIN word AS b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut AS a JOIN word AS b ON a.rest = b.word
),
best AS MATERIALIZED (SELECT word, n, near, near_n FROM near JOIN word USING (word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
form AS MATERIALIZED (SELECT word, near AS form, near_n AS form_n FROM best WHERE near_n >= 10 * n),
chain AS (
  SELECT word, form AS root FROM form
  UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root
),
root AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form)),
n_near AS (SELECT word, count(*) AS n_near FROM near GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM word LEFT JOIN form USING (word) LEFT JOIN root USING (word) LEFT JOIN n_near USING (word)"""


def statements() -> dict[str, str]:
    return {
        "op1_substring_dedup": SUBSTRING, "op3_quality_rules": QUALITY, "op5_warc": WARC, "op7_top_k": TOP_K, "op8_line_dedup": LINES,
        "op11_decontamination": DECONTAMINATION, "op12_vector_codes": _vector_codes(), "op13_spelling_variants": SPELLING,
    }
