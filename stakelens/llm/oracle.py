"""DuckDB SQL for the queries of this subpackage that SQL expresses plainly."""

from __future__ import annotations

_WARC = """WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
found AS (
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    sha256(payload) AS payload_digest,
    CASE WHEN strlen(payload) >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS held
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN held < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN held < page_id THEN held END AS refers_to
FROM found"""

_CONTENT_SORT = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _words(text: str) -> str:
    """A row for each word of each document: doc_id, word, place (from 1)."""
    return f"""split AS (
  SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM split)"""


def _run(length: int) -> str:
    """The frame of the `length` words from the current one on."""
    return (
        f"(PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)"
    )


def _back(length: int) -> str:
    return (
        f"(PARTITION BY doc_id ORDER BY place ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)"
    )


def _repeats(length: int) -> str:
    """Words, and whether the window of `length` words that begins there is in its text twice."""
    return f"""at{length} AS (
  SELECT doc_id, place, count(*) OVER run = {length} AS whole,
    md5(string_agg(word, ' ') OVER run) AS seen FROM words WINDOW run AS {_run(length)}),
again{length} AS (
  SELECT doc_id, place,
    whole AND count(*) OVER (PARTITION BY doc_id, whole, seen) > 1 AS again{length} FROM at{length})"""


_QUALITY = f"""WITH {_words("coalesce(text, '')")},
{_repeats(3)},
{_repeats(20)},
{_repeats(101)},
marked AS (
  SELECT doc_id, word, bool_or(again3) OVER {_back(3)} AS short_repeat,
    bool_or(again20) OVER {_back(20)} AS long_repeat, again101
  FROM words JOIN again3 USING (doc_id, place) JOIN again20 USING (doc_id, place)
    JOIN again101 USING (doc_id, place)),
counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars,
    count(*) FILTER (short_repeat) AS n_repeat_words,
    count(*) FILTER (long_repeat) AS n_covered_words, bool_or(again101) AS too_long_repeat
  FROM marked GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
doubled AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
  WHERE length(trim(line, {_SPACES})) > 0 GROUP BY doc_id),
base AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words,
    CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_covered_words, 0) AS n_covered_words,
    coalesce(too_long_repeat, false) AS too_long_repeat
  FROM documents LEFT JOIN counted USING (doc_id) LEFT JOIN doubled USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND NOT too_long_repeat
  AND 100 * n_covered_words <= 30 * n_words AS kept FROM failed"""

_SUBSTRINGS = f"""WITH {_words("coalesce(text, '')")},
windows AS (
  SELECT doc_id, word, place, count(*) OVER run = 35 AS whole,
    md5(string_agg(word, ' ') OVER run) AS seen FROM words WINDOW run AS {_run(35)}),
judged AS (
  SELECT doc_id, word, place,
    whole AND count(*) OVER (PARTITION BY whole, seen) > 1 AS again FROM windows),
marked AS (SELECT doc_id, word, place, bool_or(again) OVER {_back(35)} AS gone FROM judged)
SELECT doc_id, count(place) AS n_words, count(*) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM documents LEFT JOIN marked USING (doc_id) GROUP BY doc_id"""

_NGRAMS = f"""WITH RECURSIVE {_words(f"translate(coalesce(text, ''), {_CAPITALS})")},
grams AS (
  SELECT DISTINCT doc_id, md5(gram) AS gram FROM (
    SELECT doc_id, place, count(*) OVER run AS n, string_agg(word, ' ') OVER run AS gram
    FROM words WINDOW run AS {_run(5)})
  WHERE n = 5 OR place = 1),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
met AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM grams a JOIN grams b USING (gram) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * common >= 80 * (x.n + y.n - common)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a)
SELECT doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""

_LINES = f"""WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (
  SELECT doc_id, line, place, translate(trim(line, {_SPACES}), {_CAPITALS}) AS key FROM lines),
owned AS (
  SELECT doc_id, line, place, length(key) < 10
    OR doc_id = min(doc_id) OVER (PARTITION BY key) AS stays FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM owned GROUP BY doc_id"""


_CAPITALS_OUT = f"translate(text, {_CAPITALS})"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _tree(name: str, group: str, start: str) -> str:
    """Levels of hash trees: `grp`, `level`, `pos`, `hash`, and how many nodes the level has."""
    return f"""{name}(grp, level, pos, hash, size) AS (
  {start}
  UNION ALL
  SELECT grp, level + 1, pos // 16, sha256(string_agg(hash, '' ORDER BY pos)), (size + 15) // 16
  FROM {name} WHERE size > 1 GROUP BY grp, level, pos // 16, size)"""


# A document goes up the levels of its source, then those of the sources; `low` and `high` are
# the siblings on its left and right there. CRC-32 is worked out bit by bit.
_MERKLE = f"""WITH RECURSIVE bits(doc_id, rest, crc) AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents
  WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT doc_id, substr(rest, 2), list_reduce(
    list_prepend(xor(crc, CAST(ascii(rest) AS BIGINT)), CAST(range(8) AS BIGINT[])),
    lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))
  FROM bits WHERE rest <> ''),
crcs AS (SELECT doc_id, xor(crc, 4294967295) AS crc FROM bits WHERE rest = ''),
leaves AS (
  SELECT doc_id, coalesce('1' || source, '') AS grp, {_leaf("text")} AS leaf,
    CASE WHEN crc % 5 = 0 THEN {_leaf(_CAPITALS_OUT)} ELSE {_leaf("text")} END AS seen,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS size
  FROM documents LEFT JOIN crcs USING (doc_id)),
{_tree("inner_nodes", "grp", "SELECT grp, 0, pos, leaf, size FROM leaves")},
subroots AS (
  SELECT grp, hash, level AS depth, row_number() OVER (ORDER BY grp) - 1 AS place,
    count(*) OVER () AS size FROM inner_nodes WHERE size = 1),
{_tree("top_nodes", "grp", "SELECT 'top', 0, place, hash, size FROM subroots")},
steps AS (
  SELECT doc_id, s.grp, s.depth, s.place, l.pos, unnest(range(s.depth + 9)) AS step
  FROM leaves l JOIN subroots s USING (grp)),
places AS (
  SELECT doc_id, step, step >= depth AS upper, CASE WHEN step >= depth THEN 'top' ELSE grp END AS grp,
    CASE WHEN step >= depth THEN step - depth ELSE step END AS level,
    CASE WHEN step >= depth THEN place // CAST(pow(16, step - depth) AS BIGINT)
      ELSE pos // CAST(pow(16, step) AS BIGINT) END AS pos
  FROM steps),
nodes AS (
  SELECT false AS upper, * FROM inner_nodes UNION ALL SELECT true, * FROM top_nodes),
sides AS (
  SELECT doc_id, step,
    coalesce(string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos < p.pos), '') AS low,
    coalesce(string_agg(n.hash, '' ORDER BY n.pos) FILTER (n.pos > p.pos), '') AS high
  FROM places p JOIN nodes n
    ON n.upper = p.upper AND n.grp = p.grp AND n.level = p.level AND n.pos // 16 = p.pos // 16
  WHERE n.size > 1 GROUP BY doc_id, step),
proofs AS (
  SELECT doc_id, sha256(string_agg(low || high, '' ORDER BY step)) AS proof_sha256,
    max(step) AS last FROM sides GROUP BY doc_id),
climb(doc_id, step, hash) AS (
  SELECT doc_id, CAST(0 AS BIGINT), seen FROM leaves
  UNION ALL
  SELECT c.doc_id, c.step + 1, sha256(low || hash || high)
  FROM climb c JOIN sides s ON s.doc_id = c.doc_id AND s.step = c.step),
ends AS (SELECT doc_id, arg_max(hash, step) AS folded_root FROM climb GROUP BY doc_id)
SELECT doc_id, leaf, r.hash AS subroot, t.hash AS root,
  coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.hash AS verified
FROM leaves JOIN subroots r USING (grp) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
  JOIN top_nodes t ON t.size = 1"""


def _round(n: int) -> str:
    """Codebooks n, from the parts and codebooks n - 1."""
    old = f"books{n - 1}"
    return f"""{_nearest(f"near{n}", old)},
means{n} AS (
  SELECT part, entry, place, sum(x) AS total, count(*) AS n FROM (
    SELECT p.part, entry, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS place
    FROM parts p JOIN near{n} USING (row, part)) GROUP BY ALL),
moved{n} AS (
  SELECT part, entry, list((total - ((total % n) + n) % n) // n ORDER BY place) AS v
  FROM means{n} GROUP BY ALL),
books{n} AS (
  SELECT part, entry, coalesce(m.v, b.v) AS v FROM {old} b LEFT JOIN moved{n} m USING (part, entry))"""


def _nearest(name: str, books: str) -> str:
    """The nearest entry of each part, the least of equals, and its distance."""
    return f"""{name} AS (
  SELECT row, part, min(far * 256 + entry) % 256 AS entry, min(far) AS far FROM (
    SELECT row, part, entry, list_sum(list_transform(list_zip(p.v, b.v),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far
    FROM parts p JOIN {books} b USING (part)) GROUP BY ALL)"""


_CODES = f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS ints
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row, part, ints[part * (len(ints) // 4) + 1 : (part + 1) * (len(ints) // 4)] AS v
  FROM kept, range(4) p(part)),
books0 AS MATERIALIZED (SELECT part, row AS entry, v FROM parts WHERE row < 256),
{", ".join(_round(n) for n in range(1, 5)).replace(" AS (", " AS MATERIALIZED (")},
{_nearest("last", "books4")},
codes AS (
  SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code,
    CAST(sum(far) AS BIGINT) AS error FROM last GROUP BY row),
named AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM books4)
SELECT vec_id, code, error,
  CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row), named"""


def sql() -> dict[str, str]:
    return {
        "op1_quality_rules": _QUALITY,
        "op2_substring_dedup": _SUBSTRINGS,
        "op3_warc": _WARC,
        "op4_content_sort": _CONTENT_SORT,
        "op7_ngram_join": _NGRAMS,
        "op8_line_dedup": _LINES,
        "op12_merkle_pivot": _MERKLE,
        "op13_value_codes": _CODES,
    }
