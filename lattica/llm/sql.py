"""DuckDB SQL for the results of those queries that SQL can express (on tables of moderate size)."""

from __future__ import annotations

from lattica.llm.chat import Template
from lattica.llm.quality_rules import COMMON_WORDS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _components(links: str) -> str:
    """CTE ``reached(node, component)`` from a query of (a, b)."""
    return f"""both_ways AS MATERIALIZED (SELECT a, b FROM ({links}) UNION SELECT b, a FROM ({links})),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON w.a = r.other),
reached AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


EMBEDDINGS = f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
pairs AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_components("SELECT a, b FROM pairs")}, counts AS (SELECT a AS vec_id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN reached ON node = vec_id"""


def conversations(marks: str, template: Template = Template()) -> str:
    quote = lambda x: x.replace("'", "''")
    escape = lambda x: "".join("\\" + c if c in r"\[]|/.<>()*+?{}^$" and c not in "</>" else c for c in x)
    controls = "|".join(escape(x) for x in template.controls())
    roles = [r for r in template.turns if r != "other"]
    sizes = " ".join(f"WHEN role = '{r}' THEN {len(template.turns[r][0]) + len(template.turns[r][1])}" for r in roles)
    other = sum(map(len, template.turns["other"][:2])) + len(template.name)
    size = lambda c: f"length({c}) + 3 * len(regexp_extract_all({c}, '{quote(controls)}')) + length({c}) - length(replace({c}, '\\', ''))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -1, 0, 'user', '{quote(marks)}' UNION ALL SELECT -1, 1, 'assistant', '{quote(marks)}')),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, string_agg(role, ',' ORDER BY turn, role, text) AS roles,
  sum(CASE {sizes} ELSE {other} + {size("role")} END + {size("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_matches(roles, '^(system,)?user,assistant(,user,assistant)*$') AS valid FROM g"""


_BASE32 = "list_transform(range(0, 8), lambda g: list_transform(range(0, 4), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || hex[5 * g + 1:5 * g + 5])::BIGINT >> (15 - 5 * k)) & 31) + 1]))"
PAGES = f"""WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM h)
SELECT page_id, payload_bytes, array_to_string(flatten({_BASE32}), '') AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to FROM f"""


COPIES = f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce({_LOWER}, '') AS t FROM documents)"""


NEGATIVES = """WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor, other AS positive, score AS p FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, positive AS positive_id, row_number() OVER (PARTITION BY p.anchor, positive ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, p AS positive_score, score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT same AND 50 * p <= 100 * score AND 100 * score <= 95 * p QUALIFY rank <= 3"""


def spelling(least_length: int = 6, least_count: int = 5, one_in: int = 199, ratio: int = 5) -> str:
    """Near words share a word that each makes by losing one letter at the same place, or one of them is made so from the other."""
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"  # the reflected polynomial of CRC-32
    runs = f"regexp_extract_all(coalesce({_LOWER}, ''), '[A-Za-z\u00C0-\u00FF]+')"
    return f"""WITH RECURSIVE steps(k, b, c) AS (SELECT 0, b, b::BIGINT FROM range(256) t(b) UNION ALL SELECT k + 1, b, {shift} FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
said AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({runs}) AS w FROM documents) WHERE length(w) >= {least_length} GROUP BY ALL),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda h, v: xor(h >> 8, t[(xor(h, v) & 255) + 1])), 4294967295) AS h
  FROM (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM said), crc),
told AS (SELECT CASE WHEN h % {one_in} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM hashed),
v AS MATERIALIZED (SELECT w, sum(n)::BIGINT AS n FROM told WHERE length(w) >= {least_length} GROUP BY w HAVING sum(n) >= {least_count}),
less AS MATERIALIZED (SELECT w, n, i, w[:i] || w[i + 2:] AS l FROM (SELECT w, n, unnest(range(0, length(w))) AS i FROM v)),
near AS MATERIALIZED (SELECT DISTINCT a.w AS a, a.n AS na, b.w AS b, b.n AS nb FROM less a JOIN less b ON a.l = b.l AND a.i = b.i AND a.w <> b.w
  UNION SELECT v.w, v.n, less.w, less.n FROM v JOIN less ON less.l = v.w UNION SELECT less.w, less.n, v.w, v.n FROM v JOIN less ON less.l = v.w),
f AS MATERIALIZED (SELECT a, count(*) AS n_near, (list({{'n': -nb, 'w': b}} ORDER BY -nb, b) FILTER (nb >= {ratio} * na))[1] AS best FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT w AS word, best.w AS form, n, coalesce(n_near, 0) AS n_near, -best.n AS form_n FROM v LEFT JOIN f ON f.a = v.w),
walk(word, reached) AS (SELECT word, word FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.reached WHERE form IS NOT NULL),
roots AS (SELECT walk.word, reached FROM walk JOIN forms ON forms.word = walk.reached WHERE form IS NULL)
SELECT word, form, reached AS root, n, n_near, form_n FROM forms JOIN roots USING (word)"""


def repeats(width: int = 35) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, n - {width - 2})) AS i FROM d WHERE n >= {width})),
r AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM s JOIN r USING (g)), range({width}) t(k)),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, n + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS k, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_words, (n - coalesce(k, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def jaccard(width: int = 3, num: int = 90, den: int = 100) -> str:
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", f"coalesce({_LOWER}, '')")} AS w FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {width - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(n - {width - 2}, 2))) AS i FROM d WHERE n > 0)),
sizes AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * c >= {num} * (x.k + y.k - c)),
{_components("SELECT a, b FROM pairs")}
SELECT d.doc_id, coalesce(k, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(component, d.doc_id)) AS component_id FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN reached ON node = d.doc_id"""


def _chars(marks: str) -> str:
    return f"length(regexp_replace(text, '[^{marks}]', '', 'g'))"


def rules(max_class_distance: float = 0.18, max_word_distance: float = 0.19, slack: float = 1.0, min_chars: int = 200, min_words: int = 50) -> str:
    classes = [
        _chars("a-z"), _chars("A-Z"), _chars("0-9"), _chars(r"\.,;:!\?\x27\x22\(\)\-"),
        _chars(r"#$%&*+/<=>@\[\\\]^_`{|}~\x00-\x08\x0E-\x1F\x7F"), r"length(regexp_replace(text, '[\x00-\x7F]', '', 'g'))",
    ]
    vocabulary = ", ".join(f"('{lang}', '{w}')" for lang, words in COMMON_WORDS.items() for w in words.split())
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0 END"
    term = f"({part.format(x='p', y='q')} + {part.format(x='q', y='p')}) / 2"
    return rf"""WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN again USING (doc_id, g), range(3) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
b AS MATERIALIZED (SELECT doc_id, lang, w, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_chars("#*$%&|<>")} AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, [{", ".join(classes)}] AS c FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
j AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
ch AS (SELECT doc_id, lang, base_failed, unnest(c)::DOUBLE AS x, unnest(range(6)) AS k FROM j),
rc AS (SELECT lang, k, sum(x) AS r FROM ch WHERE NOT base_failed GROUP BY ALL),
cp AS (SELECT doc_id, x / nullif(sum(x) OVER (PARTITION BY doc_id), 0) AS p, r / nullif(sum(r) OVER (PARTITION BY doc_id), 0) AS q FROM ch JOIN rc ON rc.lang IS NOT DISTINCT FROM ch.lang AND rc.k = ch.k),
cd AS (SELECT doc_id, sqrt(greatest(0, sum({term}))) AS dist FROM cp GROUP BY doc_id),
vocabulary(lang, word) AS (VALUES {vocabulary}),
found AS (SELECT doc_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, count(*) AS x FROM (SELECT doc_id, unnest(w) AS word FROM j) GROUP BY ALL),
wk AS (SELECT doc_id, j.lang, base_failed, n_words, v.word, coalesce(x, 0)::DOUBLE AS x FROM j JOIN vocabulary v ON v.lang = j.lang LEFT JOIN found f USING (doc_id, word)),
wh AS MATERIALIZED (SELECT doc_id, lang, base_failed, word, x FROM wk UNION ALL SELECT doc_id, lang, base_failed, '', any_value(n_words) - sum(x) FROM wk GROUP BY ALL),
rw AS (SELECT lang, word, sum(x) AS r FROM wh WHERE NOT base_failed GROUP BY ALL),
wp AS (SELECT doc_id, x / nullif(sum(x) OVER (PARTITION BY doc_id), 0) AS p, r / nullif(sum(r) OVER (PARTITION BY doc_id), 0) AS q FROM wh JOIN rw USING (lang, word)),
wd AS (SELECT doc_id, sqrt(greatest(0, sum({term}))) AS dist FROM wp GROUP BY doc_id),
o AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, CASE WHEN word_chars >= {min_chars} THEN coalesce(cd.dist, 0) ELSE 0 END AS class_distance,
  CASE WHEN n_words >= {min_words} THEN coalesce(wd.dist, 0) ELSE 0 END AS word_distance, base_failed, {slack}::DOUBLE / sqrt(greatest(n_words, 1)) AS noise
  FROM j LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, base_failed,
  NOT base_failed AND class_distance <= {max_class_distance} + noise AND word_distance <= {max_word_distance} + noise AS kept FROM o"""
