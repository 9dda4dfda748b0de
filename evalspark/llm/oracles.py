"""SQL that repeats those queries of this folder which SQL can express."""

from __future__ import annotations

# bytes of ASCII text folded into a CRC, bit by bit
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

# states: 1 nothing yet, 2 after s, 3 after u, 4 after a; the role each may go on with, and the state after it
_GOES_ON = (("user", 3), ("user", 3), ("assistant", 4), ("user", 3))
_KEPT = ("CASE i WHEN 's' THEN 2 WHEN 'u' THEN 3 END", "CASE i WHEN 'u' THEN 3 END", "CASE i WHEN 'a' THEN 4 END", "CASE i WHEN 'u' THEN 3 END")


def _plan(cost: str, audit: str, lines: str) -> str:
    return f"{{'c': {cost}, 'a': {audit}, 'l': {lines}}}"


def _inserted(v: str) -> str:
    """A list of plans, one per state, where a row may be inserted first."""
    return "[" + ", ".join(
        f"list_sort([{v}[{s}], " + _plan(f"{v}[{t}].c + 5", f"'I' || {v}[{t}].a", f"list_prepend('{role}:', {v}[{t}].l)") + "])[1]"
        for s, (role, t) in enumerate(_GOES_ON, 1)) + "]"


def _edited(v: str) -> str:
    """The plans before a row, from those after it."""
    out = []
    for s, ((role, t), kept) in enumerate(zip(_GOES_ON, _KEPT), 1):
        more = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
        keep = _plan(f"{v}[{kept}].c + {more}", f"'K' || {v}[{kept}].a", f"list_prepend(role || ':' || text, {v}[{kept}].l)")
        rerole = _plan(f"{v}[{t}].c + 1 + {more}", f"'R' || {v}[{t}].a", f"list_prepend('{role}:' || text, {v}[{t}].l)")
        delete = _plan(f"{v}[{s}].c + 2", f"'D' || {v}[{s}].a", f"{v}[{s}].l")
        out.append(f"list_sort(list_filter([{delete}, CASE WHEN fault NOT IN (1, 2) THEN {rerole} END, "
                   f"CASE WHEN fault NOT IN (1, 2) AND {kept} IS NOT NULL THEN {keep} END], lambda p: p IS NOT NULL))[1]")
    return "[" + ", ".join(out) + "]"


_NONE = "CAST([] AS VARCHAR[])"
_FAR = "CAST(1000000000000 AS BIGINT)"
_END = "[" + ", ".join(_plan("CAST(0 AS BIGINT)" if s in (1, 4) else _FAR, "''", _NONE) for s in (1, 2, 3, 4)) + "]"
_DIGEST = "md5(concat(length(role), ':', role, ':', text))"

CONVERSATIONS = f"""WITH RECURSIVE
said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS damage FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
  CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN damage = 3 THEN [1, 2] ELSE [1] END) AS copy FROM said WHERE damage <> 0),
placed AS (SELECT *, left(role, 1) AS i, ROW_NUMBER() OVER w AS pos, COUNT(*) OVER (PARTITION BY conv_id) AS n,
  lag(left(role, 1)) OVER w AS previous FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), {_DIGEST})),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
  WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM placed),
walk AS (SELECT conv_id, n AS pos, {_inserted('v')} AS v FROM (SELECT conv_id, n, {_inserted('v')} AS v FROM
    (SELECT DISTINCT conv_id, n, {_END} AS v FROM faulty))
  UNION ALL SELECT conv_id, pos, {_inserted('v')} AS v FROM (SELECT conv_id, pos, {_inserted('v')} AS v FROM
    (SELECT f.conv_id, f.pos - 1 AS pos, {_edited('walk.v')} AS v FROM walk JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.pos = walk.pos))),
counts AS (SELECT conv_id, coalesce(MAX(turn) - MIN(turn) + 1 - COUNT(DISTINCT turn), 0) AS gaps, COUNT(*) FILTER (fault = 1) AS blank,
  COUNT(*) FILTER (fault = 2) AS duplicate, COUNT(*) FILTER (fault = 3) AS truncated,
  COUNT(*) FILTER (pos > 1 AND concat(previous, i) NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0) AS cost, coalesce(v[1].a, '') AS audit,
  sha256(coalesce(array_to_string(v[1].l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN walk ON walk.conv_id IS NOT DISTINCT FROM o.conv_id AND walk.pos = 0"""


_FIT = "host = '{0}' OR ends_with(host, '.{0}')"
_BY_RULE = f"""CASE WHEN ({_FIT.format("example.net")}) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ({_FIT.format("example.com")}) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ({_FIT.format("org")}) AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN ({_FIT.format("net")}) AND starts_with(path, '/') THEN 'net/' END"""
_ORDER, _ALPHABET = 4, 256


def _level(size: int) -> str:
    """Probabilities of the last characters of strings of one length, from those of the next shorter ones."""
    def blended(m: str) -> str:
        shorter = f"l.p_{m}" if size > 1 else str(1 / _ALPHABET)
        return f"CASE WHEN c.all_{m} > 0 THEN (c.n_{m} + c.kinds_{m} * {shorter}) / (c.all_{m} + c.kinds_{m}) ELSE {shorter} END AS p_{m}"

    join = f"JOIN level{size - 1} l ON l.s = right(c.s, {size - 1})" if size > 1 else ""
    return (f"level{size} AS (SELECT c.s, c.uses, " + ", ".join(map(blended, ("aa", "ra", "af", "rf")))
            + f" FROM counts c {join} WHERE c.size = {size})")


URLS = f"""WITH split AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3 :] END AS rest FROM pages),
named AS (SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM split),
ruled AS (SELECT page_id, host, path, coalesce(host || regexp_extract(rest, '(?s)^[^/?#]*(.*)\\z', 1), url, '') AS text, {_BY_RULE} AS rule FROM named),
labelled AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS label FROM ruled),
texts AS (SELECT DISTINCT text, label, label IS NOT NULL AND right(md5(text), 1) IN ('0', '1', '2') AS held FROM labelled),
grams AS (SELECT text, label, held, substring(p, i, {_ORDER + 1}) AS gram FROM (SELECT text, label, held, p, unnest(range(1, length(p) - {_ORDER - 1})) AS i
  FROM (SELECT *, concat(repeat(chr(2), {_ORDER}), text, chr(3)) AS p FROM texts))),
parts AS (SELECT size, right(gram, size) AS s, COUNT(*) FILTER (label = 1) AS n_aa, COUNT(*) FILTER (label = 0) AS n_ra,
  COUNT(*) FILTER (label = 1 AND NOT held) AS n_af, COUNT(*) FILTER (label = 0 AND NOT held) AS n_rf,
  COUNT(*) FILTER (label IS NULL OR held) AS uses FROM grams, (SELECT unnest(range(1, {_ORDER + 2})) AS size) GROUP BY ALL),
counts AS (SELECT *, {", ".join(f"SUM(n_{m}) OVER w AS all_{m}, COUNT(*) FILTER (n_{m} > 0) OVER w AS kinds_{m}" for m in ("aa", "ra", "af", "rf"))}
  FROM parts WINDOW w AS (PARTITION BY size, left(s, size - 1))),
{", ".join(_level(k) for k in range(1, _ORDER + 2))},
gaps AS (SELECT s AS gram, CAST(round((ln(p_aa) - ln(p_ra)) * 1000000) AS BIGINT) AS d_all,
  CAST(round((ln(p_af) - ln(p_rf)) * 1000000) AS BIGINT) AS d_fit FROM level{_ORDER + 1} WHERE uses > 0),
scored AS (SELECT text, label, held, SUM(CASE WHEN held THEN d_fit ELSE d_all END) / COUNT(*) / 1000000 AS score
  FROM grams JOIN gaps USING (gram) WHERE label IS NULL OR held GROUP BY ALL),
sides AS (SELECT AVG(score) FILTER (label = 1) AS high, stddev_pop(score) FILTER (label = 1) AS high_by, AVG(score) FILTER (label = 0) AS low,
  stddev_pop(score) FILTER (label = 0) AS low_by FROM scored WHERE held),
least AS (SELECT CASE WHEN high IS NULL OR low IS NULL OR high <= low THEN 0 WHEN high_by + low_by > 0
  THEN (high * low_by + low * high_by) / (high_by + low_by) ELSE (high + low) / 2 END AS least FROM sides)
SELECT page_id, host, path, rule, CASE label WHEN 1 THEN 'allow' WHEN 0 THEN 'block' ELSE CASE WHEN score >= least THEN 'allow' ELSE 'block' END END AS verdict
FROM labelled CROSS JOIN least LEFT JOIN (SELECT text, score FROM scored WHERE label IS NULL) USING (text)"""
