"""SQL of the queries that SQL can express, for a database with RE2 patterns, lists and recursive queries.

Written from the operators' contracts, not from their plans: windows and shingles are compared by their words, all links are
followed, and spans are cut out of maximal runs as RE2 has no lookaround.
"""

from __future__ import annotations

from kilnworks.llm import near_dups, secrets, substrings

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _in_a_row(word: str, n: int) -> str:
    """n words from this one on, joined by a space; null beyond a document's end."""
    return " || ' ' || ".join([word, *(f"lead({word}, {i}) OVER own" for i in range(1, n))])


def op6_substrings() -> str:
    k = substrings.WINDOW
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
win AS (SELECT doc_id, i, {_in_a_row("word", k)} AS s FROM t WINDOW own AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win WHERE s IS NOT NULL) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {k})) AS i FROM again),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM t ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def op5_near_dups() -> str:
    k, alike = near_dups.SHINGLE, f"CAST({near_dups.ALIKE} AS DOUBLE)"
    return f"""WITH RECURSIVE x AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node FROM documents GROUP BY 1),
d AS (SELECT node, {WORDS} AS w FROM x),
t AS (SELECT node, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
sh AS (SELECT DISTINCT node, s FROM (SELECT node, {_in_a_row("word", k)} AS s FROM t WINDOW own AS (PARTITION BY node ORDER BY i)) WHERE s IS NOT NULL
  UNION ALL SELECT node, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {k - 1}),
n AS (SELECT node, count(*) AS n FROM sh GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.node < b.node GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON na.node = a JOIN n nb ON nb.node = b WHERE c >= {alike} * (na.n + nb.n - c)),
step AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT node, node AS root FROM x UNION SELECT v, root FROM reach JOIN step ON u = node),
cls AS (SELECT node, min(root) AS class_id FROM reach GROUP BY node),
sized AS (SELECT class_id, count(*) AS n_texts FROM cls GROUP BY class_id)
SELECT doc_id, class_id, n_texts FROM documents JOIN x ON x.text = coalesce(documents.text, '') JOIN cls USING (node) JOIN sized USING (class_id)"""


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _either(words: str) -> str:
    return "(?:" + "|".join(_any_case(w) for w in words.split("|")) + ")"


def _spans(name: str, pattern: str, group: int = 0) -> str:
    """name(doc_id, s, e, v): the matches of pattern with the group's text, from the lengths of what lies between them."""
    p = pattern.replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', {group})"
    return f"""{name}_l AS (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS h, {value} AS v FROM d WHERE regexp_matches(t, '{p}')),
{name}_r AS (SELECT doc_id, unnest(g) AS g, unnest(h) AS h, unnest(v) AS v, generate_subscripts(g, 1) AS i FROM {name}_l),
{name} AS (SELECT doc_id, e - length(h) AS s, e, v FROM (SELECT *, sum(length(g) + coalesce(length(h), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}_r) WHERE h IS NOT NULL)"""


def op9_secrets() -> str:
    """The patterns are the operator's fixed values in RE2's terms: letters of either case spelt out, runs without lookaround."""
    assign = "(" + _either("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ident = r"\b" + _either("user|username|login|account|client_?id|key_?id") + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
    endpoint = r"\b" + _either("https?|ssh|ftp|postgres|mysql|redis|mongodb|amqp") + r"""://[^\x20\x09-\x0D"'<>|]{4,}"""
    near = f"s.doc_id = p.doc_id AND s.s BETWEEN p.s - {secrets.SCOPE} AND p.e + {secrets.SCOPE} AND (s.e <= p.s OR s.s >= p.e)"
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    listed = f"string_agg(list_extract([{names}], k + 1) || ':' || s || ':' || e, ',' ORDER BY s, k, e)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_spans("a", assign, 2)},
{_spans("c", "AKIA[A-Z0-9]+")},
{_spans("x", "[0-9a-f]+")},
{_spans("i", ident)},
{_spans("n", endpoint)},
{_spans("o", "[A-Za-z0-9+/_=-]+")},
{_spans("q", "[0-9A-Za-z]+")},
base AS (SELECT doc_id, 0 AS k, s, e FROM a WHERE length(v) >= {secrets.ASSIGN_LEAST} UNION ALL SELECT doc_id, 1, s, e FROM c WHERE e - s >= 20 UNION ALL SELECT doc_id, 2, s, e FROM x WHERE e - s >= 24),
op AS (SELECT doc_id, s, regexp_extract(v, '^[A-Za-z0-9+/_-]{{32,}}={{0,2}}') AS m FROM o WHERE e - s >= 32 AND regexp_matches(v, '^[A-Za-z+/_-]*[0-9]')),
weak AS (SELECT doc_id, 5 AS k, s, e FROM a WHERE length(v) < {secrets.ASSIGN_LEAST} UNION SELECT doc_id, 5, s, s + length(m) FROM op WHERE m <> '' UNION SELECT doc_id, 5, s, e FROM q WHERE regexp_matches(v, '^[0-9a-f]{{16,23}}$') AND regexp_matches(v, '[0-9]')),
known AS (SELECT doc_id, 3 AS k, s, e FROM i UNION ALL SELECT doc_id, 4, s, e FROM n),
part AS (FROM known UNION ALL FROM base WHERE k = 1),
secret AS (FROM base UNION ALL FROM weak),
more AS (SELECT DISTINCT s.doc_id, s.k, s.s, s.e FROM weak s JOIN part p ON {near} UNION SELECT DISTINCT p.doc_id, p.k, p.s, p.e FROM known p JOIN secret s ON {near}),
every AS (FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND m.s < b.e AND m.e > b.s)),
r AS (SELECT doc_id, count_if(k = 0) AS n_assign, count_if(k = 1) AS n_access, count_if(k = 2) AS n_hex, coalesce({listed} FILTER (k < 3), '') AS base, {listed} AS spans FROM every GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {f.__name__: f() for f in (op5_near_dups, op6_substrings, op9_secrets)}
