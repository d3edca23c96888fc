"""DuckDB SQL of the rows of those queries that SQL can express.

op2, op3 and op7 are fitted models and op10 tokenizes, which
SQL doesn't do; FLAC streams and license signatures aren't SQL's either, so of op8
and op9 it has the columns that don't depend on those.
"""

from __future__ import annotations

from tarn.llm import decontaminate, simhash, substring_dedup, warc

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_N = substring_dedup.WINDOW

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i:i + {_N - 1}], ' ') AS k
  FROM (SELECT r, w, unnest(range(1, len(w) - {_N - 2})) AS i FROM w WHERE len(w) >= {_N})),
gone AS (SELECT DISTINCT r, unnest(range(i, i + {_N})) AS p FROM windows
  WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w) ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""

_BACK, _WIDTH = decontaminate.OVERLAP - 1, 2 * decontaminate.OVERLAP - 1


def _tokens(table: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM {table}"


def _seeds(of: str, key: str, place: str) -> str:
    """Each mask at each place of each list: the tokens under its ones."""
    parts = []
    for m, mask in enumerate(decontaminate.MASKS):
        picked = ", ".join(f"t[{place} + {o + 1}]" for o, c in enumerate(mask) if c == "1")
        parts.append(f"SELECT {key}, t, {place}, {m} AS mask, concat_ws(chr(31), {picked}) AS seed FROM (SELECT *, unnest(range(0, len(t) - {len(mask) - 1})) AS {place} FROM {of} WHERE len(t) >= {len(mask)})")
    return " UNION ALL ".join(parts)


DECONTAMINATION = f"""
WITH items AS (SELECT * FROM ({_tokens("benchmark", "item_id")}) WHERE len(t) >= {decontaminate.SHORTEST}),
docs AS (SELECT * FROM ({_tokens("documents", "doc_id")}) WHERE len(t) >= {decontaminate.SHORTEST}),
b AS ({_seeds("items", "item_id", "j")}),
d AS ({_seeds("docs", "doc_id", "i")}),
hits AS (SELECT doc_id, item_id, i, ceil(least({decontaminate.OVERLAP}, len(b.t)) * {decontaminate.SHARE}) AS need,
    [CASE WHEN i + k >= 0 AND j + k >= 0 AND d.t[i + k + 1] = b.t[j + k + 1] THEN 1 ELSE 0 END FOR k IN range(-{_BACK}, {_WIDTH - _BACK})] AS e
  FROM d JOIN b ON d.mask = b.mask AND d.seed = b.seed),
best AS (SELECT doc_id, item_id, i, need, list_max([list_sum(e[s + 1:s + {decontaminate.OVERLAP}]) FOR s IN range(0, {_WIDTH - decontaminate.OVERLAP + 1})]) AS matched FROM hits)
SELECT doc_id, item_id, count(*) AS n_seeds, max(matched)::BIGINT AS matched, min(i)::BIGINT AS first_token
FROM best WHERE matched >= need GROUP BY doc_id, item_id"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, {}, 5))::BIGINT >> {}) & 31)::INTEGER, 1)"
_DIGEST = " || ".join(_DIGIT.format(5 * g + 1, 15 - 5 * c) for g in range(8) for c in range(4))
_BLOCK = f"({len(warc.HTTP)} + n + 8 * (n // {warc.CHUNK}) + CASE WHEN n % {warc.CHUNK} > 0 THEN length(to_hex(n % {warc.CHUNK})) + 4 ELSE 0 END + 5)"

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS sha FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, {_DIGEST} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to,
  CASE WHEN page_id = top THEN ceil({_BLOCK} / {warc.SEGMENT}.0) ELSE 0 END::INTEGER AS n_segments, true AS complete
FROM m"""

MEDIA_PAYLOADS = """
SELECT doc_id, n AS n_bytes, full_n AS payload_bytes, sha256(encode(text) || encode(repeat(chr(0), (full_n - n)::INTEGER))) AS payload_sha256
FROM (SELECT doc_id, text, n, greatest(64, (n + 63) // 64 * 64) AS full_n
  FROM (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT AS n FROM documents))"""


def _places(phrase: str) -> str:
    words = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    return f"[i FOR i IN range(1, len(w) + 1) IF {words}]"


def license_base(base: dict[str, str]) -> str:
    """Of the phrases, with their labels: where they stand."""
    found = ", ".join(f"{_places(p)} AS p{k}" for k, p in enumerate(base))
    every = " || ".join(f"p{k}" for k in range(len(base)))
    labels = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in sorted(enumerate(base.values()), key=lambda x: x[1]))
    return rf"""
SELECT doc_id, len(w)::BIGINT AS n_words, len(every)::BIGINT AS n_base, list_min(every)::BIGINT - 1 AS first_word, list_max(every)::BIGINT - 1 AS last_word, concat_ws(',', {labels}) AS base_labels
FROM (SELECT *, {every} AS every FROM (SELECT doc_id, w, {found} FROM
  (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)))"""


# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
_FULL = "18446744073709551616::UHUGEINT"


def _add(*of: str) -> str:
    return "((" + " + ".join(f"({x})::UHUGEINT" for x in of) + f") % {_FULL})::UBIGINT"


def _mul(a: str, prime: int) -> str:
    return f"((({a})::UHUGEINT * {prime}::UHUGEINT) % {_FULL})::UBIGINT"


def _rotl(a: str, r: int) -> str:
    return f"((({a})::UHUGEINT * {1 << r}) % {_FULL} + ({a}) // {1 << (64 - r)}::UBIGINT)::UBIGINT"


def _round(acc: str, lane: str) -> str:
    return _mul(_rotl(_add(acc, _mul(lane, _P2)), 31), _P1)


def _little(start: str, n: int) -> str:
    """The little-endian number of n bytes that begin at a byte of hex."""
    return "('0x' || " + " || ".join(f"substr(hex, 2 * ({start}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + ")::UBIGINT"


def _folded(first: str, rest: str, step: str) -> str:
    """rest's values folded into first by ``step`` over a and x."""
    return f"list_reduce(list_prepend({first}, {rest}), lambda a, x: {step})"


def xxh64(source: str, seed: int) -> str:
    """SELECT of (s, h): XXH64 of each text s of the source."""
    lanes = [f"[{_little(f'32 * k + {8 * i}', 8)} FOR k IN range(0, n // 32)]" for i in range(4)]
    begin = [(seed + _P1 + _P2) % 2**64, (seed + _P2) % 2**64, seed, (seed - _P1) % 2**64]
    accs = ", ".join(f"{_folded(f'{b}::UBIGINT', lane, _round('a', 'x'))} AS v{i}" for i, (b, lane) in enumerate(zip(begin, lanes, strict=True)))
    long = _add(*(_rotl(f"v{i}", r) for i, r in enumerate((1, 7, 12, 18))))
    merge = lambda h, v: _add(_mul(f"xor({h}, {_round('0::UBIGINT', v)})", _P1), str(_P4))
    steps = f"SELECT s, hex, n, n // 32 * 32 AS pos, {accs} FROM (SELECT s, hex(encode(s)) AS hex, strlen(s) AS n FROM ({source}))"
    steps = f"SELECT *, {long} AS h0 FROM ({steps})"
    for i in range(4):
        steps = f"SELECT * EXCLUDE (h0), {merge('h0', f'v{i}')} AS h0 FROM ({steps})"
    steps = f"SELECT s, hex, n, pos, {_add(f'CASE WHEN n >= 32 THEN h0 ELSE {(seed + _P5) % 2**64}::UBIGINT END', 'n')} AS h0 FROM ({steps})"
    words = f"[{_little('pos + 8 * k', 8)} FOR k IN range(0, (n - pos) // 8)]"
    word_step = _add(_mul(_rotl(f"xor(a, {_round('0::UBIGINT', 'x')})", 27), _P1), str(_P4))
    steps = f"SELECT s, hex, n, n // 8 * 8 AS pos, {_folded('h0', words, word_step)} AS h0 FROM ({steps})"
    half = _add(_mul(_rotl(f"xor(h0, {_mul(_little('pos', 4), _P1)})", 23), _P2), str(_P3))
    steps = f"SELECT s, hex, n, n // 4 * 4 AS pos, CASE WHEN n - pos >= 4 THEN {half} ELSE h0 END AS h0 FROM ({steps})"
    tail = f"[{_little('pos + k', 1)} FOR k IN range(0, n - pos)]"
    steps = f"SELECT s, {_folded('h0', tail, _mul(_rotl(f'xor(a, {_mul("x", _P5)})', 11), _P1))} AS h0 FROM ({steps})"
    for shift, prime in ((33, _P2), (29, _P3), (32, None)):
        mixed = f"xor(h0, h0 // {1 << shift}::UBIGINT)"
        steps = f"SELECT s, {_mul(mixed, prime) if prime else mixed} AS h0 FROM ({steps})"
    return f"SELECT s, h0 AS h FROM ({steps})"


_BITS = ", ".join(f"sum((h // {1 << b}::UBIGINT) % 2) * 2 > count(*) AS b{b}" for b in range(64))
_FINGERPRINT = " + ".join(f"CASE WHEN b{b} THEN {1 << b}::UHUGEINT ELSE 0 END" for b in range(64))

SIMHASH = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT r, array_to_string(w[i:i + {simhash.SHINGLE - 1}], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - {simhash.SHINGLE - 1}) + 1)) AS i FROM w WHERE len(w) > 0)),
hashed AS MATERIALIZED ({xxh64("SELECT DISTINCT s FROM shingles", simhash.SEED)}),
bits AS (SELECT r, {_BITS} FROM shingles JOIN hashed USING (s) GROUP BY r),
prints AS MATERIALIZED (SELECT w.r, doc_id, coalesce(f, 0::UBIGINT) AS f FROM w LEFT JOIN (SELECT r, ({_FINGERPRINT})::UBIGINT AS f FROM bits) USING (r)),
nodes AS MATERIALIZED (SELECT f, min(doc_id) AS least FROM prints GROUP BY f),
links AS MATERIALIZED (SELECT a.f AS a, b.f AS b FROM nodes a JOIN nodes b ON bit_count(xor(a.f, b.f)::HUGEINT) <= {simhash.DISTANCE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, lower(lpad(to_hex(f), 16, '0')) AS fingerprint, component_id
FROM prints JOIN (SELECT reach.a AS f, min(least) AS component_id FROM reach JOIN nodes ON reach.b = nodes.f GROUP BY reach.a) USING (f)"""
