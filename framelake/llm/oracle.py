"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from framelake.llm.hosts import TWO_LABEL

ORACLE: dict[str, str] = {}

# [^\x20\x09-\x0D]+ words of a text
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The whole join: common shingles of every pair that has one, then components by repeated least labels.
ORACLE["op3_jaccard"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, a AS low FROM both_ways UNION SELECT b, low FROM reach JOIN both_ways ON node = a WHERE low < b),
c AS (SELECT node, min(low) AS low FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.low, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

ORACLE["op5_substrings"] = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS low FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM g JOIN f USING (g) WHERE doc_id > low) GROUP BY doc_id),
k AS (SELECT w.doc_id, w, coalesce(js, []) AS js FROM w LEFT JOIN gone USING (doc_id)),
x AS (SELECT doc_id, i, w[i] AS v FROM (SELECT doc_id, w, js, unnest(range(1, len(w) + 1)) AS i FROM k) EXCEPT ALL SELECT doc_id, j, w[j] FROM (SELECT doc_id, w, unnest(js) AS j FROM k)),
t AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM x GROUP BY doc_id)
SELECT k.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(js) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM k LEFT JOIN t USING (doc_id)
"""

# Base32 of the SHA-1, five bits at a time.
_HEX = "sha1(coalesce(html, ''))"
_BITS = f"array_to_string(list_transform(range(1, 41), lambda i: bin(CAST(strpos('0123456789abcdef', substr({_HEX}, i, 1)) - 1 AS BIGINT) + 16)[2:5]), '')"
_B32 = f"array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda b: CAST(substr(bits, 5 * i + b + 1, 1) AS BIGINT) * CAST(pow(2, 4 - b) AS BIGINT))) AS BIGINT) + 1, 1)), '')"
ORACLE["op4_warc"] = f"""
WITH b AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, coalesce(html, '') AS html, {_BITS} AS bits FROM pages),
p AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM b)
SELECT page_id, payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to FROM p
"""

# Links by brute force; the hashing finds each at this size but for a chance of a few in a hundred right at the threshold.
ORACLE["op1_neardup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS node, a AS low FROM links UNION SELECT b, low FROM reach JOIN links ON node = a WHERE low < b),
c AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.low, e.vec_id) AS component_id, coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c ON c.node = e.vec_id
"""

_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


#: Hosts that some rule is written for, whatever the path.
_COVERED = " OR ".join(f"host = '{h}' OR host LIKE '%.{h}'" for h in sorted({r[1] for r in _RULES}))


def _longest(value: str) -> str:
    """The value of the longest rule that fits, null if none does."""
    fit = "WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v}'"
    order = sorted(_RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(fit.format(h=h, p=p, v=a if value == "action" else h + p) for a, h, p in order) + " END"


def _strength(level: str, parent: str) -> str:
    """Moment estimate of a beta prior's strength from the spread of a level's shares inside their parents."""
    return f"""SELECT CASE WHEN r <= l + 1e-12 THEN most WHEN s <= l THEN most ELSE least(most, greatest(0.5e0, (r - s) / (s - l))) END AS m FROM (
      SELECT coalesce(sum(kk - k * p), 0) AS s, coalesce(sum(p * (1 - p) * (g - 1)), 0) AS l, coalesce(sum(p * (1 - p) * (n - nn / n)), 0) AS r, greatest(2e0, coalesce(sum(g), 0)) AS most FROM (
        SELECT *, k / n AS p FROM (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, count(*) AS g, sum(n * n)::DOUBLE AS nn, sum(k * k / n::DOUBLE) AS kk FROM {level} WHERE n > 0 GROUP BY {parent})))"""


_TWO_LABEL = ", ".join(f"'{x}'" for x in TWO_LABEL)
# The chance to be above one half by a sum over angles (share = sin(angle)^2), where the operator uses a continued fraction.
_ANGLES = "SELECT ln(sin(t)) AS ls, ln(cos(t)) AS lc, t > pi() / 4 AS high FROM (SELECT (i + 0.5e0) / 4000 * pi() / 2 AS t FROM range(4000) x(i))"
ORACLE["op7_hosts"] = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r AS (SELECT *, {_longest("rule")} AS rule, {_longest("action")} AS action, {_COVERED} AS covered FROM hp),
named AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM r),
labels AS (SELECT *, string_split(name, '.') AS parts, array_to_string(string_split(name, '.')[-2:], '.') IN ({_TWO_LABEL}) AS two FROM named),
split AS (SELECT *, regexp_matches(name, '^[0-9]+([.][0-9]+){{3}}$') OR NOT contains(name, '.') OR (two AND len(parts) = 2) AS own FROM labels),
hosts AS (SELECT host, count(*) FILTER (WHERE action IS NOT NULL OR covered) AS n, count(*) FILTER (WHERE action = 'block') AS k, any_value(CASE WHEN own THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END) AS domain, any_value(CASE WHEN own THEN '' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END) AS suffix FROM split GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 1 AS every FROM domains GROUP BY ALL),
ms AS ({_strength("suffixes", "every")}), md AS ({_strength("domains", "suffix")}), mh AS ({_strength("hosts", "domain, suffix")}),
overall AS (SELECT (coalesce(sum(k), 0) + 0.5e0) / (coalesce(sum(n), 0) + 1) AS p FROM suffixes),
d AS (SELECT d.domain, d.suffix, d.n AS nd, d.k AS kd, (s.k - d.k + ms.m * p) / (s.n - d.n + ms.m) AS ps, least(md.m, (s.n - d.n)::DOUBLE) AS md FROM domains d JOIN suffixes s USING (suffix), ms, md, overall),
h AS (SELECT host, n, k, nd, nd - n + md AS others, CASE WHEN nd - n + md > 0 THEN (kd - k + md * ps) / (nd - n + md) ELSE ps END AS p FROM hosts JOIN d USING (domain, suffix)),
ab AS (SELECT host, nd, k + least(m, others) * p + 0.5e0 AS a, n - k + least(m, others) * (1 - p) + 0.5e0 AS b FROM h, mh),
grid AS ({_ANGLES}),
peak AS (SELECT a, b, max((2 * a - 1) * ls + (2 * b - 1) * lc) AS top FROM (SELECT DISTINCT a, b FROM ab), grid GROUP BY ALL),
chance AS (SELECT a, b, sum(exp((2 * a - 1) * ls + (2 * b - 1) * lc - top)) FILTER (WHERE high) / sum(exp((2 * a - 1) * ls + (2 * b - 1) * lc - top)) AS above FROM peak, grid GROUP BY ALL),
own AS (SELECT host, CASE WHEN above > 0.95e0 AND nd > 0 THEN 'block' ELSE 'allow' END AS own FROM ab JOIN chance USING (a, b))
SELECT page_id, host, path, rule, coalesce(action, own) AS verdict FROM r JOIN own USING (host)
"""

_TERM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op11_lexical"] = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERM.format(_LOWER)} AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM t),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM t) GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERM.format(_LOWER)}) AS term FROM (SELECT item_id, min(text) AS text FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id)) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM i JOIN df USING (term) JOIN p USING (term), s GROUP BY ALL),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""

_DRAW = "CAST('0x' || substr(sha256('1:' || doc_id), {}, 8) AS BIGINT)"
ORACLE["op12_middle"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, {", ".join(f"{_DRAW.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

ORACLE["op13_inner"] = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM t q JOIN t c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""
