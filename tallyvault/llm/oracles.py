"""DuckDB SQL of the operators that SQL can express, with the same parameters."""

from __future__ import annotations

from tallyvault.llm import fingerprint, knn, lines, merkle, mixing, near

MIXING = f"""WITH RECURSIVE items AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(doc_id::VARCHAR, '') AS k, len(string_split_regex(trim(coalesce(text, '')), '[ \\n\\t\\r]+'))::BIGINT AS n FROM documents),
src AS (SELECT source, sum(n)::BIGINT AS tokens, sum(n) / (SELECT sum(n) FROM items) AS p FROM items GROUP BY source),
ent(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL SELECT i + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM (SELECT i, lo, hi,
    (SELECT ln(sum(p ** ((lo + hi) / 2))) - (lo + hi) / 2 * sum(p ** ((lo + hi) / 2) * ln(p)) / sum(p ** ((lo + hi) / 2)) FROM src) >= {mixing.ENTROPY} * (SELECT ln(count(*)) FROM src) AS ok FROM ent WHERE i < {mixing.STEPS})),
rep(i, lo, hi) AS (SELECT 0, 0::DOUBLE, 1::DOUBLE UNION ALL SELECT i + 1, CASE WHEN many THEN (lo + hi) / 2 ELSE lo END, CASE WHEN many THEN hi ELSE (lo + hi) / 2 END FROM (SELECT i, lo, hi,
    (SELECT max(p ** ((lo + hi) / 2 - 1)) / sum(p ** ((lo + hi) / 2)) FROM src) > {mixing.MOST_REPEATS} AS many FROM rep WHERE i < {mixing.STEPS})),
first AS (SELECT CASE WHEN (SELECT count(*) < 2 OR -sum(p * ln(p)) >= {mixing.ENTROPY} * ln(count(*)) FROM src) THEN 1 ELSE (SELECT lo FROM ent WHERE i = {mixing.STEPS}) END AS t),
temp AS (SELECT CASE WHEN (SELECT count(*) FROM src) < 2 OR (SELECT max(p ** (t - 1)) / sum(p ** t) FROM src) <= {mixing.MOST_REPEATS} THEN t WHEN (SELECT max(p ** 0) / sum(p) FROM src) > {mixing.MOST_REPEATS} THEN 1 ELSE greatest(t, (SELECT hi FROM rep WHERE i = {mixing.STEPS})) END AS t FROM first),
weights AS (SELECT source, tokens, p ** t / sum(p ** t) OVER () AS weight, floor(p ** t / sum(p ** t) OVER () * sum(tokens) OVER () + 1e-6)::BIGINT AS goal FROM src, temp),
along AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY md5('{mixing.SEED}/' || k), k, n ROWS UNBOUNDED PRECEDING) AS ends FROM items JOIN weights USING (source)),
copies AS (SELECT *, unnest(range(1, 1 + (goal // tokens) + CASE WHEN ends <= goal % tokens THEN 1 ELSE 0 END)) AS copy FROM along),
blocks AS (SELECT *, floor(((copy - 1) * tokens + ends - n) / goal * (SELECT greatest(1, ceil(sum(goal) / {mixing.BLOCK_TOKENS})) FROM weights))::BIGINT AS block FROM copies)
SELECT doc_id, source, copy::INTEGER AS copy, block, (row_number() OVER (PARTITION BY block ORDER BY md5('{mixing.SEED}/' || k || '/' || copy::VARCHAR), k, copy, source, n) - 1)::INTEGER AS position, n AS tokens, round(weight, 6) AS weight FROM blocks"""

NEAREST = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.x, b.x) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs QUALIFY rank <= {knn.K}"""

#: On the texts of the test tables words are the same in both engines.
NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {near.WORDS - 1}], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - {near.WORDS - 2}, 2))) r(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS key FROM sets GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE c >= {near.THRESHOLD} * (a.n + b.n - c) - 1e-6),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
SELECT d.doc_id, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS links, greatest(1, (SELECT count(*) FROM sizes a JOIN sizes b USING (key) WHERE a.doc_id = d.doc_id)) AS copies FROM documents d"""

_SHARES = list(fingerprint.SHARES)
FINGERPRINTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rn FROM documents),
nx AS (SELECT d.*, coalesce(lead(text) OVER o, first(text) OVER o) AS following, coalesce(lead(rn) OVER o, 1) AS next_rn FROM d WINDOW o AS (ORDER BY rn)),
ed AS (SELECT *, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) AS edited FROM nx),
sides AS (SELECT rn, 0 AS side, text AS body FROM ed UNION ALL SELECT rn, 1, edited FROM ed),
lists AS (SELECT rn, side, list_sort(list_distinct(list_filter(string_split_regex(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))) AS ts FROM sides),
words AS (SELECT rn, side, unnest(ts) AS term FROM lists),
band AS (SELECT term, sha256(term) || substr(sha256(term), 1, 2) AS h FROM words WHERE side = 0 GROUP BY term HAVING count(*) BETWEEN greatest(2, {fingerprint.LOW} * (SELECT count(*) FROM d)) AND greatest(2, {fingerprint.HIGH} * (SELECT count(*) FROM d))),
subsets AS (SELECT term, k FROM band, range(0, {fingerprint.SUBSETS}) r(k) WHERE ('0x' || substr(h, (2 * k + 1)::BIGINT, 4))::INTEGER < list_extract({_SHARES}, (k % {len(_SHARES)} + 1)::BIGINT)),
hashed AS (SELECT rn, side, k, substr(md5(string_agg(lpad(k::VARCHAR, 2, '0') || ' ' || term, ' ' ORDER BY term)), 1, 12) AS h FROM words JOIN subsets USING (term) GROUP BY ALL),
printed AS (SELECT l.rn, l.side, coalesce((SELECT string_agg(coalesce(h.h, ''), '-' ORDER BY r.k) FROM range(0, {fingerprint.SUBSETS}) r(k) LEFT JOIN (SELECT * FROM hashed) h ON h.k = r.k AND h.rn = l.rn AND h.side = l.side HAVING count(h.h) > 0), substr(md5(array_to_string(ts, ' ')), 1, 12)) AS f FROM lists l),
three AS (SELECT ed.doc_id, ed.n, ed.edited, a.f AS f, b.f AS e, c.f AS x FROM ed JOIN printed a ON a.rn = ed.rn AND a.side = 0 JOIN printed b ON b.rn = ed.rn AND b.side = 1 JOIN printed c ON c.rn = ed.next_rn AND c.side = 0)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, f AS fingerprint, e AS edited_fingerprint, @EDITED AS near_edited, @NEXT AS near_next FROM three"""


def _likeness(a: str, b: str) -> str:
    pairs = f"list_zip(string_split({a}, '-'), string_split({b}, '-'))"

    def share(some: str, least: int) -> str:
        equal, either = f"len(list_filter({some}, lambda p: p[1] = p[2] AND p[1] <> ''))", f"len(list_filter({some}, lambda p: p[1] <> '' OR p[2] <> ''))"
        return f"CASE WHEN {either} >= {least} THEN {equal} / greatest({either}, 1)::DOUBLE END"

    tiers = ", ".join(share(f"({pairs})[{t + 1}:{fingerprint.SUBSETS}:{len(_SHARES)}]", fingerprint.LEAST) for t in range(len(_SHARES)))
    return f"CASE WHEN {a} = {b} THEN 1::DOUBLE WHEN len(string_split({a}, '-')) <> len(string_split({b}, '-')) THEN 0::DOUBLE ELSE coalesce(greatest({tiers}), {share(pairs, 0)}) END"


FINGERPRINTS = FINGERPRINTS.replace("@EDITED", _likeness("f", "e")).replace("@NEXT", _likeness("f", "x"))

_BLANKS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))
LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ln, translate(trim(ln, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT r, doc_id, unnest(ls) AS ln, generate_subscripts(ls, 1) AS i FROM d)),
common AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= {lines.LEAST}),
told AS (SELECT l.*, c.k IS NOT NULL AS gone FROM l LEFT JOIN common c ON c.k = l.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(ln, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY r"""


def _levels(name: str, first: str) -> str:
    """Levels of digests (g, k, ds), from the leaves of each group up to one node."""
    return f"""{name}(g, k, ds) AS ({first} UNION ALL SELECT g, k + 1, list_transform(range(0, (len(ds) + 1) // 2), lambda i: sha256(ds[2 * i + 1] || coalesce(ds[2 * i + 2], ''))) FROM {name} WHERE len(ds) > 1)"""


def _leaf(n_chars: str) -> str:
    fields = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in (n_chars if c == "n_chars" else c for c in merkle.COLUMNS)]
    return f"sha256({' || '.join(fields)})"


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
MERKLE = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN doc_id IS NOT NULL AND {_CRC} % {merkle.TAMPERED} = 0 THEN 1 ELSE 0 END)")} AS told FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
{_levels("up", "SELECT g, 0, list(leaf ORDER BY i) FROM p GROUP BY g")},
subs AS (SELECT g, arg_max(ds[1], k) AS subroot, max(k) AS depth, row_number() OVER (ORDER BY g) - 1 AS i FROM up GROUP BY g),
{_levels("top", "SELECT '', 0, list(subroot ORDER BY i) FROM subs")},
whole AS (SELECT arg_max(ds[1], k) AS root FROM top),
steps AS (SELECT p.g, p.i, up.k, p.i >> up.k AS spot, ds FROM p JOIN up ON up.g = p.g WHERE len(ds) > 1
UNION ALL SELECT p.g, p.i, subs.depth + top.k, subs.i >> top.k, ds FROM p JOIN subs ON subs.g = p.g, top WHERE len(ds) > 1),
sides AS (SELECT g, i, k, CASE WHEN spot % 2 = 1 THEN 'L' WHEN spot + 1 < len(ds) THEN 'R' ELSE '-' END AS side, coalesce(ds[xor(spot, 1) + 1], '') AS sib FROM steps),
proofs AS (SELECT g, i, string_agg(sib, '' ORDER BY k) AS sibs, list(side || sib ORDER BY k) AS path FROM sides GROUP BY g, i),
folded AS (SELECT p.doc_id, p.leaf, subs.subroot, whole.root, sha256(coalesce(sibs, '')) AS proof_sha256,
list_reduce(list_prepend(p.told, coalesce(path, [])), lambda a, b: sha256(CASE WHEN b[1] = 'L' THEN b[2:] || a WHEN b[1] = 'R' THEN a || b[2:] ELSE a END)) AS folded_root
FROM p JOIN subs ON subs.g = p.g LEFT JOIN proofs q ON q.g = p.g AND q.i = p.i, whole)
SELECT *, folded_root = root AS verified FROM folded"""

ORACLES = {"op1_source_mixing": MIXING, "op6_nearest_neighbours": NEAREST, "op9_ngram_jaccard_join": NEAR, "op10_document_fingerprints": FINGERPRINTS, "op11_line_dedup": LINES, "op13_merkle_manifest": MERKLE}
