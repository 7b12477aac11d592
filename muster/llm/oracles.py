"""The operators that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

from muster.llm.licenses import NOISE, RULES, SENTENCE_END, SENTENCES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def licenses() -> str:
    """op2: known sentences by join, rules by one replacement each."""
    known = ", ".join(f"({_text(s)}, {_text(n)})" for n, s in SENTENCES)
    steps, hits = [], {}
    for i, (name, needs) in enumerate(RULES):
        pattern = _text("".join(f"|{n}|" for n in needs))
        steps.append(
            f"l{i} AS (SELECT *, contains(line{i}, {pattern}) AS hit{i}, "
            f"replace(line{i}, {pattern}, '||') AS line{i + 1} FROM {'k' if not i else f'l{i - 1}'})"
        )
        hits.setdefault(name, []).append(f"hit{i}")
    named = ", ".join(f"CASE WHEN {' OR '.join(h)} THEN {_text(n)} END" for n, h in hits.items())
    end = len(RULES)
    return f"""
WITH known AS (SELECT * FROM (VALUES {known}) AS t(sentence, id)),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
u AS (SELECT r, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS part FROM (
  SELECT r, string_split_regex(coalesce(text, ''), '{SENTENCE_END}') AS a FROM d)),
k AS (SELECT r, string_agg(id, ',' ORDER BY i) AS sentences,
        concat('|', string_agg(id, '||' ORDER BY i), '|') AS line0
      FROM u JOIN known ON sentence = regexp_replace(
        regexp_replace(lower(part), '{NOISE}', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')
      GROUP BY r),
{", ".join(steps)},
m AS (SELECT r, sentences, list_filter([{named}], lambda x: x IS NOT NULL) AS found,
        array_to_string(list_filter(string_split_regex(line{end}, '\\|+'), lambda x: x <> ''), ',')
          AS rest
      FROM l{end - 1})
SELECT doc_id, coalesce(sentences, '') AS sentences,
  coalesce(array_to_string(found, ','), '') AS licenses, coalesce(rest, '') AS rest,
  CAST(coalesce(len(found), 0) AS BIGINT) AS n_licenses
FROM d LEFT JOIN m USING (r)"""


ROTATION = r"""
WITH r AS (SELECT conv_id, turn, role AS raw, coalesce(role, 'unknown') AS role,
        coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, turn, text, raw, role = 'system' AS system,
        CASE role WHEN 'system' THEN role WHEN '' THEN 'unknown'
             ELSE regexp_replace(role, '[\x20\x09-\x0D]+', '_', 'g') END AS name FROM r),
s AS (SELECT *, CASE WHEN NOT system AND number > 1 THEN concat(name, ' ', number) ELSE name END
        AS speaker
      FROM (SELECT *, dense_rank() OVER (PARTITION BY conv_id, system, name
              ORDER BY raw NULLS FIRST) AS number FROM t)),
w AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM s WHERE NOT system),
x AS (SELECT conv_id, perspective, turn, speaker, NOT system AND speaker = perspective AS learn,
        concat('<|im_start|>', CASE WHEN system THEN 'system'
               WHEN speaker = perspective THEN 'assistant'
               ELSE concat('user name=', speaker) END, chr(10)) AS head, text
      FROM s JOIN w ON conv_id IS NOT DISTINCT FROM conv),
y AS (SELECT *, concat(head, text, '<|im_end|>', chr(10)) AS segment FROM x),
z AS (SELECT *, CAST(row_number() OVER o - 1 AS BIGINT) AS position,
        CAST(sum(length(segment)) OVER o AS BIGINT) AS segment_end
      FROM y WINDOW o AS (PARTITION BY conv_id, perspective
        ORDER BY turn NULLS FIRST, speaker, segment ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, position, speaker, turn, segment,
  segment_end - length(segment) AS segment_start, segment_end, learn,
  CASE WHEN learn THEN segment_end - length(segment) + length(head) END AS learn_start,
  CASE WHEN learn THEN segment_end - 1 END AS learn_end FROM z"""

# The checksum's table by its rule, and the checksum as a fold over the bytes.
SHARDS = """
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
b AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(
              regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))),
            lambda a, x: xor(a >> 8, step[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
      FROM b, t),
p AS (SELECT *, sum(size) OVER o - size AS before, sum(size) OVER () AS total
      FROM c WINDOW o AS (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, CAST(least(7, 8 * (2 * before + size) // (2 * total)) AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard
       ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard FROM q"""

_LOWER = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
        unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3
      FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
one AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL
          HAVING f >= 10),
covers AS (SELECT lang, w1, w2, max(f) AS longer
           FROM (SELECT lang, w1, w2, f FROM three
                 UNION ALL SELECT lang, w2 AS w1, w3 AS w2, f FROM three) GROUP BY ALL),
cuts AS (
  SELECT lang, concat(w1, ' ', w2) AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM two t JOIN one x USING (lang, w1) JOIN one y ON y.lang = t.lang AND y.w1 = t.w2
    LEFT JOIN covers USING (lang, w1, w2)
  WHERE t.f >= 10 AND coalesce(100 * longer < 50 * t.f, true)
  UNION ALL
  SELECT lang, concat(w1, ' ', t.w2, ' ', t.w3), 1, t.f, x.f, y.f
  FROM three t JOIN one x USING (lang, w1)
    JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
  UNION ALL
  SELECT lang, concat(w1, ' ', w2, ' ', t.w3), 2, t.f, x.f, y.f
  FROM three t JOIN two x USING (lang, w1, w2) JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score
           FROM cuts),
lowest AS (SELECT * FROM scored
           QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

# A document reaches another over links; the smallest id reached is its component.
MINHASH = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id,
        regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT i, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(
        range(1, len(w)), lambda k: concat(w[k], ' ', w[k + 1])) END) AS shingle FROM d),
n AS (SELECT i, count(*) AS n FROM s GROUP BY i),
c AS (SELECT x.i AS a, y.i AS b, count(*) AS c FROM s x JOIN s y USING (shingle)
      WHERE x.i <> y.i GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.i = a JOIN n y ON y.i = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(i, j) AS (SELECT i, i FROM d UNION SELECT reach.i, b FROM reach JOIN links ON j = a),
least AS (SELECT reach.i AS i, min(doc_id) AS component_id
          FROM reach JOIN d ON d.i = j GROUP BY reach.i)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id,
  doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least USING (i) LEFT JOIN n USING (i)"""


def oracles() -> dict[str, str]:
    return {
        "op2_license_sentences": licenses(),
        "op6_perspective_rotation": ROTATION,
        "op8_byte_shards": SHARDS,
        "op11_collocations": COLLOCATIONS,
        "op12_circulant_minhash": MINHASH,
    }
