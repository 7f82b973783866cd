"""DuckDB SQL for the queries of this subpackage that SQL can express whole."""

from __future__ import annotations

from .common import BASE, BYTE_VALUES
from .license_rules import CONFIDENCE, compile_rules
from .op4_substrings import WINDOW
from .op5_quality import BUCKETS, MARGIN, MIN_WORDS, PRIOR, REJECTED_SHARE, REPEAT_PERCENT, SCALE
from .op5_quality import WINDOW as REPEATED
from .op8_media import PAD, RATE
from .op9_jaccard import PERCENT, SHINGLE

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT r, doc_id, i, hash(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h, md5(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS m FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
least AS (SELECT h, m, min(doc_id) AS least FROM win GROUP BY h, m),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN least USING (h, m), range({WINDOW}) t(k) WHERE least < doc_id),
kept AS (SELECT x.r, string_agg(x.word, ' ' ORDER BY x.i) AS t, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) x ANTI JOIN gone ON gone.r = x.r AND gone.i = x.i GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM w),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS x FROM sets UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(x) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_LE32 = "printf('%02X%02X%02X%02X', {0} & 255, ({0} >> 8) & 255, ({0} >> 16) & 255, ({0} >> 24) & 255)"

MEDIA = f"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, x || repeat('00', ({PAD} - (length(x) // 2) % {PAD}) % {PAD} + CASE WHEN x = '' THEN {PAD} ELSE 0 END) AS x FROM h),
b AS (SELECT doc_id, n_bytes, x, (length(x) // 2)::BIGINT AS n, list_transform(regexp_extract_all(x, '..'), lambda y: (instr('0123456789ABCDEF', y[1]) - 1) * 16 + instr('0123456789ABCDEF', y[2]) - 1) AS b FROM p),
m AS (SELECT *, '52494646' || {_LE32.format("(36 + n)")} || '57415645666D74201000000001000100' || {_LE32.format(RATE)} || {_LE32.format(RATE)} || '0100080064617461' || {_LE32.format("n")} || x AS media FROM b)
SELECT doc_id, n_bytes, n AS payload_bytes, sha256(unhex(x)) AS payload_sha256,
  xor(list_reduce(list_concat([4294967295], list_transform(b[-{PAD}:], lambda y: y::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295)::BIGINT AS tail_crc32,
  (length(media) // 2)::BIGINT AS media_bytes, sha256(unhex(media)) AS media_sha256,
  n || ':' || printf('%.6f', list_sum(list_transform(b, lambda y: y - 128))::DOUBLE / n) || ':' || printf('%.6f', sqrt(list_sum(list_transform(b, lambda y: (y - 128) * (y - 128)))::DOUBLE / n)) || ':' ||
    list_max(list_transform(b, lambda y: abs(y - 128))) || ':' || len(list_filter(range(2, n + 1), lambda i: (b[i] >= 128) <> (b[i - 1] >= 128))) AS feature
FROM m, crc
"""


def _rule_row(rule) -> str:
    """A rule for text whose words stand between the characters 2 and 3, as RE2 has no look-around."""
    pattern = rule.pattern.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")
    pattern = r"\x02" + pattern.replace(" ?", r"(?:\x03 \x02)?").replace(" ", "\0").replace("\\x03\0\\x02", r"\x03 \x02").replace("\0", r"\x03 \x02") + r"\x03"
    return "('{}', '{}', {}, {}, '{}', '{}')".format(rule.label, rule.kind, rule.priority, CONFIDENCE[rule.kind], rule.keyword.decode(), pattern.replace("'", "''"))


_COUNT = "(length({0}) - length(replace({0}, chr(2), '')))"

LICENSES = f"""
WITH rules(label, kind, priority, confidence, keyword, pattern) AS (VALUES {", ".join(map(_rule_row, compile_rules()))}),
w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT r, array_to_string(w, ' ') AS plain, array_to_string(list_transform(w, lambda x: chr(2) || x || chr(3)), ' ') AS f FROM w),
hits AS (SELECT r, label, kind, priority, confidence, regexp_extract_all(f, pattern) AS m, regexp_split_to_array(f, pattern) AS p FROM f JOIN rules ON contains(plain, keyword) WHERE regexp_matches(f, pattern)),
numbered AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hits),
places AS (
  SELECT r, label, kind, priority, confidence, s, s + {_COUNT.format("m[k]")} AS e
  FROM (SELECT *, (list_sum(list_transform(p[1:k], lambda x: {_COUNT.format("x")})) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: {_COUNT.format("x")})), 0))::BIGINT AS s FROM numbered)),
base AS (SELECT r, count(*) AS n, min(s) AS low, max(s) AS high, list(DISTINCT label) AS labels, product(1 - confidence) AS miss FROM places WHERE kind = 'base' GROUP BY r),
ordered AS (SELECT r, list({{'s': s, 'e': e, 'label': label, 'miss': 1 - confidence}} ORDER BY kind <> 'tag', s - e, priority, s) AS l FROM places WHERE kind <> 'base' GROUP BY r),
kept AS (
  SELECT r, list_reduce(list_concat([l[1:0]], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.s < x[1].e AND x[1].s < y.e)) > 0 THEN a ELSE list_concat(a, x) END) AS l FROM ordered)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, low AS first_word, high AS last_word, coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(list_transform(kept.l, lambda x: x.label), [])))), ','), '') AS labels,
  CASE WHEN base.n IS NULL AND kept.l IS NULL THEN 0.0 ELSE round(1 - coalesce(base.miss, 1) * coalesce(list_aggregate(list_transform(kept.l, lambda x: x.miss), 'product'), 1), 9) END::DOUBLE AS score,
  coalesce(len(kept.l), 0)::BIGINT AS n_found
FROM w LEFT JOIN base USING (r) LEFT JOIN kept USING (r)
"""

_TWO_64 = "18446744073709551616::UHUGEINT"


def _times(x: str, y: int | str) -> str:
    """Product modulo 2^64."""
    return f"(({x}::UHUGEINT * {y}::UHUGEINT) % {_TWO_64})::UBIGINT"


def _mixed(columns: str, source: str, x: str, name: str) -> str:
    """The rows of source with name = mix(x), a step a subquery."""
    a = f"SELECT *, xor({x}, {x} >> 31) AS m1 FROM {source}"
    b = f"SELECT *, {_times('m1', 0x7FB5D329728EA185)} AS m2 FROM ({a})"
    c = f"SELECT *, xor(m2, m2 >> 27) AS m3 FROM ({b})"
    d = f"SELECT *, {_times('m3', 0x81DADEF4BC2DD44D)} AS m4 FROM ({c})"
    return f"SELECT {columns}, xor(m4, m4 >> 33) AS {name} FROM ({d})"


_VALUES = "[" + ", ".join(f"{int(v)}::UBIGINT" for v in BYTE_VALUES) + "]"

QUALITY = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
letters AS (SELECT word, unnest(range(length(hex(encode(word))) // 2)) AS j, regexp_extract_all(hex(encode(word)), '..') AS b FROM (SELECT DISTINCT word FROM p)),
powers AS (WITH RECURSIVE q AS (SELECT 0 AS j, 1::UBIGINT AS v UNION ALL SELECT j + 1, {_times("v", BASE)} FROM q WHERE j < (SELECT max(j) FROM letters)) SELECT j, v FROM q),
summed AS (
  SELECT word, (sum({_times(f"{_VALUES}[(instr('0123456789ABCDEF', b[j + 1][1]) - 1) * 16 + instr('0123456789ABCDEF', b[j + 1][2])]", "v")}::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS x
  FROM letters JOIN powers USING (j) GROUP BY word),
hashed AS ({_mixed("word", "summed", "x", "h")}),
singles AS ({_mixed("word, h", "hashed", "h", "u")}),
pairs AS (SELECT p.r, p.doc_id, a.h AS h1, b.h AS h2 FROM p JOIN p n ON n.r = p.r AND n.i = p.i + 1 JOIN hashed a ON a.word = p.word JOIN hashed b ON b.word = n.word),
joined AS (SELECT h1, h2, (({_times("h1", BASE)}::UHUGEINT + h2::UHUGEINT) % {_TWO_64})::UBIGINT AS x FROM (SELECT DISTINCT h1, h2 FROM pairs)),
doubles AS ({_mixed("h1, h2", "joined", "x", "u")}),
grams AS (
  SELECT r, doc_id, (u >> 48)::BIGINT AS bucket FROM p JOIN singles USING (word)
  UNION ALL SELECT r, doc_id, (u >> 48)::BIGINT FROM pairs JOIN doubles USING (h1, h2)),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
counts AS (SELECT bucket, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM known WHERE quality = 1)) AS target FROM grams GROUP BY bucket),
totals AS (SELECT sum(raw) AS n, sum(target) AS m FROM counts),
ratios AS (
  SELECT bucket, CASE WHEN m = 0 THEN 0 ELSE round({SCALE} * (ln((target + 0.5::DOUBLE) / (m + {0.5 * BUCKETS}::DOUBLE)) - ln((raw + 0.5::DOUBLE) / (n + {0.5 * BUCKETS}::DOUBLE))))::BIGINT END AS ratio FROM counts, totals),
scored AS (SELECT r, sum(ratio)::DOUBLE / ({SCALE} * ({PRIOR} + count(*))) AS score FROM grams JOIN ratios USING (bucket) GROUP BY r),
windows AS (SELECT r, i, array_to_string(w[i:i + {REPEATED - 1}], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - {REPEATED - 2})) AS i FROM d)),
repeated AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, unnest(list(i)) AS i FROM windows GROUP BY r, x HAVING count(*) > 1), range({REPEATED}) t(k) GROUP BY r),
base AS (
  SELECT doc_id, r, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(score, 0) AS score FROM d LEFT JOIN repeated USING (r) LEFT JOIN scored USING (r)),
trusted AS (SELECT min(score) AS score FROM base JOIN known USING (doc_id) WHERE quality = 1 AND n_words >= {MIN_WORDS} GROUP BY doc_id),
least AS (SELECT CASE WHEN count(*) = 0 THEN '-infinity'::DOUBLE ELSE round(list_sort(list(score))[(floor({REJECTED_SHARE} * count(*)) + 1)::INT] - {MARGIN}, 6) END AS least FROM trusted)
SELECT * EXCLUDE (r, least), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND score >= least AS kept FROM base, least
"""
