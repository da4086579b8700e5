"""Queries of this subpackage and the SQL of those that DuckDB can express."""

from __future__ import annotations

from . import media, mixing, multiset_hash, near_dedup, packing, quality, repeats, secret_ledger, sstable, toxicity


def queries() -> dict:
    return {
        "op1_media": media.op1_media,
        "op2_secrets": secret_ledger.op2_secrets,
        "op3_minhash": near_dedup.op3_minhash,
        "op4_mix": mixing.op4_mix,
        "op5_quality": quality.op5_quality,
        "op6_suffix_dedup": repeats.op6_suffix_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_fingerprint": multiset_hash.op8_fingerprint,
        "op9_pack": packing.op9_pack,
        "op10_sstable_tokens": sstable.op10_sstable_tokens,
        "secrets_in_rounds": secret_ledger.secrets_in_rounds,
    }


def _classes(keys: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in keys)


#: Kinds with their patterns (letters of the keys in either case, spelt out), the group that counts
#: and its least length.
_KINDS = [
    (0, "assign", "(" + "|".join(map(_classes, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    (1, "access", "AKIA[A-Z0-9]+", 0, 20),
    (2, "hex", "[0-9a-f]+", 0, 24),
    (3, "pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\r\n\t -]*?-----END [A-Z ]*PRIVATE KEY-----|(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/=]{24,})*)", 0, 1),
]

#: The place of match i: all pieces up to it and all matches before it.
OP2 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{", ".join(f"m{k} AS (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS g, string_split_regex(t, '{p}') AS s FROM d)" for k, _, p, g, _ in _KINDS)},
h AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS kind_no, '{kind}' AS kind, start, start + length(m[i]) AS stop FROM (SELECT doc_id, m, g, i, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m{k})) WHERE length(g[i]) >= {least}" for k, kind, _, _, least in _KINDS)}),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind_no = 0) AS n_assign, count(*) FILTER (WHERE kind_no = 1) AS n_access, count(*) FILTER (WHERE kind_no = 2) AS n_hex,
string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind_no) FILTER (WHERE kind_no < 3) AS base,
string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind_no) AS spans FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

#: All pairs that share a shingle, then the closure of the links: for tables that fit a machine.
OP3 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id"""


#: Every 200-byte string, those that start twice, and what they leave.
OP6 = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, i, x[i + 1:i + 200] AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(octet_length(x) - 199, 0))) AS i FROM d)),
g AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
f AS (SELECT doc_id, i FROM w WHERE s IN (SELECT s FROM g)),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM f),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM n),
r AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM k GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
t AS (SELECT q.doc_id, string_agg(hex(x[since + 1:a]), '' ORDER BY a) AS kept, max(b) AS last, sum(b - a) AS removed, count(*) AS spans FROM q JOIN d ON d.doc_id = q.doc_id GROUP BY q.doc_id)
SELECT d.doc_id, octet_length(x) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || hex(x[coalesce(last, 0) + 1:octet_length(x)]))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer, a model, random draws or a coder: tests/llm has them by brute force."""
    return {"op2_secrets": OP2, "secrets_in_rounds": OP2, "op3_minhash": OP3, "op6_suffix_dedup": OP6}
