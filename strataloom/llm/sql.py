"""The same results in plain SQL, by brute force, for tables small enough for it."""

from __future__ import annotations

_USABLE = """usable AS (
  SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda x, y: x + y)) AS norm
  FROM (
    SELECT vec_id, list_transform(w, lambda x: x / pow(2, floor(log2(list_max(list_transform(w, lambda y: abs(y))))))) AS v
    FROM (SELECT vec_id, embedding::DOUBLE[] AS w FROM embeddings) t
    WHERE w IS NOT NULL AND len(w) > 0 AND len(list_filter(w, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(w, lambda x: x <> 0)) > 0
  ) t
)"""
_DOT = "list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]), lambda x, y: x + y)"


def near_vectors(threshold: float) -> str:
    return f"""WITH RECURSIVE {_USABLE},
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE {_DOT} / (a.norm * b.norm) >= {threshold}
),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least_id, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.least_id, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON n.x = e.vec_id
LEFT JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) c ON c.x = e.vec_id"""


def nearest(modulus: int, k: int) -> str:
    return f"""WITH {_USABLE},
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_DOT} / (a.norm * b.norm) AS score
  FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % {modulus} = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) t WHERE rank <= {k}"""


def ngram_join(words: int, threshold: float) -> str:
    return f"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE text IS NOT NULL
),
grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END)) AS g
  FROM texts WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE c::DOUBLE / (s.n + t.n - c)::DOUBLE >= {threshold}
),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least_id, d.doc_id)) AS class_id, coalesce(n.n_links, 0)::BIGINT AS n_links
FROM documents d
LEFT JOIN (SELECT x, count(*) AS n_links FROM links GROUP BY x) n ON n.x = d.doc_id
LEFT JOIN (SELECT x, min(y) AS least_id FROM reach GROUP BY x) c ON c.x = d.doc_id"""


def url_filter(rules, damping: float, steps: int, threshold: float, digits: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.name))

    def case(field: str) -> str:
        whens = " ".join(
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{getattr(r, field)}'" for r in ordered
        )
        return f"CASE {whens} END"

    def host(url: str) -> str:
        return f"translate(coalesce(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), ''), '{upper}', '{upper.lower()}')"

    parts = [
        f"""base AS (
  SELECT page_id, html, host, path, {case("name")} AS rule, {case("verdict")} AS ruled FROM (
    SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages) t
)""",
        """links AS (
  SELECT host, unnest(regexp_extract_all(html, '(?i)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM base WHERE host <> ''
)""",
        f"""edges AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, CASE
      WHEN starts_with(link, '//') THEN {host("('x:' || link)")}
      WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN {host("link")}
      WHEN regexp_matches(link, '^(mailto|javascript|data|tel):') THEN '' ELSE host END AS dst
    FROM links) t WHERE dst <> '' GROUP BY 1, 2
)""",
    ]
    for verdict, a, b in (("allow", "src", "dst"), ("block", "dst", "src")):
        parts.append(
            f"""{verdict}_share AS (
  SELECT {a} AS src, {b} AS dst, n / sum(n) OVER (PARTITION BY {a}) AS p FROM edges
)"""
        )
        parts.append(
            f"""{verdict}_seed AS (
  SELECT host, count(*) / sum(count(*)) OVER () AS seed FROM base WHERE ruled = '{verdict}' AND host <> '' GROUP BY host
)"""
        )
        parts.append(f"{verdict}_0 AS (SELECT host, seed::DOUBLE AS rank FROM {verdict}_seed)")
        for k in range(steps):
            parts.append(
                f"""{verdict}_{k + 1} AS (
  SELECT host, sum(rank) AS rank FROM (
    SELECT host, seed * {1 - damping} AS rank FROM {verdict}_seed
    UNION ALL SELECT dst, rank * p * {damping} FROM {verdict}_share JOIN {verdict}_{k} ON src = host) t GROUP BY host
)"""
            )
    parts.append(
        f"""standing AS (
  SELECT coalesce(t.host, d.host) AS host,
    round(CASE WHEN coalesce(t.rank, 0) + coalesce(d.rank, 0) > 0 THEN coalesce(t.rank, 0) / (coalesce(t.rank, 0) + coalesce(d.rank, 0)) ELSE 0.5 END, {digits}) AS trust
  FROM allow_{steps} t FULL JOIN block_{steps} d ON t.host = d.host
)"""
    )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT page_id, b.host, path, rule, coalesce(ruled, CASE WHEN coalesce(trust, 0.5) >= {threshold} THEN 'allow' ELSE 'block' END) AS verdict
FROM base b LEFT JOIN standing s ON s.host = b.host"""
    )


def collocations(max_words: int, least: int, share: int, most: int) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase, {k} AS words FROM said WHERE len(w) >= {k}"
        for k in range(1, max_words + 1)
    )
    return f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
),
said AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, phrase, words, count(*) AS n FROM ({grams}) t GROUP BY ALL),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND n >= {least}),
cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.w, c.a, x.n AS l, y.n AS r, k, 1000000::HUGEINT * c.a * c.a // (x.n::HUGEINT * y.n) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM lowest s WHERE NOT EXISTS (
    SELECT 1 FROM candidates b WHERE b.lang = s.lang AND b.words > len(s.w) AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')
      AND 100 * b.a >= {share} * s.a)
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= {most}"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of ASCII text, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""


def manifest(modulus: int) -> str:
    def leaf(n_chars: str) -> str:
        said = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(said)})"

    return f"""WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {leaf("n_chars")} AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % {modulus} = 0 THEN {leaf("(n_chars + 1)")} ELSE {leaf("n_chars")} END AS claim FROM documents
),
leaves AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM hashed
),
tree(lang, level, pos, n, h) AS (
  SELECT lang, 0, pos, n, leaf FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n
),
subroots AS (SELECT lang, h, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
upper(level, pos, n, h) AS (
  SELECT 0, place, n, h FROM subroots
  UNION ALL SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n
),
top AS (SELECT h AS root, level AS height FROM upper WHERE n = 1),
steps AS (
  SELECT l.id, l.k, l.j % 2 = 1 AS is_right, t.h AS sibling FROM (
    SELECT id, l.lang, unnest(range(0, height)) AS k, pos // (2 ** unnest(range(0, height)))::BIGINT AS j FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  ) l LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM l.lang AND t.level = l.k AND t.pos = xor(l.j, 1)
  UNION ALL
  SELECT l.id, l.below + l.k, l.j % 2 = 1, t.h FROM (
    SELECT id, s.height AS below, unnest(range(0, o.height)) AS k, place // (2 ** unnest(range(0, o.height)))::BIGINT AS j
    FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top o
  ) l LEFT JOIN upper t ON t.level = l.k AND t.pos = xor(l.j, 1)
),
folded(id, k, h) AS (
  SELECT id, 0::BIGINT, claim FROM leaves
  UNION ALL SELECT f.id, f.k + 1, sha256(CASE WHEN is_right THEN coalesce(sibling, '') || h ELSE h || coalesce(sibling, '') END)
  FROM folded f JOIN steps s ON s.id = f.id AND s.k = f.k
),
proofs AS (SELECT id, string_agg(sibling, '' ORDER BY k) AS siblings, count(*) AS height FROM steps GROUP BY id)
SELECT l.doc_id, l.leaf, s.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN top LEFT JOIN proofs p ON p.id = l.id
JOIN folded f ON f.id = l.id AND f.k = coalesce(p.height, 0)"""
