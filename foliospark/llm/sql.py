"""DuckDB SQL with the same results as the queries that SQL can express."""

from __future__ import annotations


def _draw(key: str, level: str, child: int, weight: int) -> str:
    return f"(-ln((('0x' || substr(md5({key} || '/{level}/{child}'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / {weight}.0)"


def _least(key: str, level: str, weights: dict[int, int]) -> str:
    return f"list_min([{', '.join(f'{{d: {_draw(key, level, c, w)}, c: {c}}}' for c, w in weights.items())}]).c"


def _shard(key: str, extra: bool) -> str:
    regions = {0: 8, 1: 8} | ({2: 1} if extra else {})
    racks = {r: f"CASE {_least(key, 'rack', {2 * r: 4, 2 * r + 1: 4})} " + " ".join(f"WHEN {k} THEN {_least(key, 'shard', {4 * k + i: 1 for i in range(4)})}" for k in (2 * r, 2 * r + 1)) + " END" for r in (0, 1)}
    return f"CAST(CASE {_least(key, 'region', regions)} WHEN 0 THEN {racks[0]} WHEN 1 THEN {racks[1]} ELSE 16 END AS INTEGER)"


_KEY = "coalesce(doc_id::VARCHAR, 'null')"

#: CRC-32 of a text in SQL is a fold over its bytes; the table is made by the rule of the polynomial.
_CRC_TABLE = "(SELECT list(c ORDER BY n) FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS n)))"


def _crc(binary_hex: str) -> str:
    pieces = f"list_transform(range(1, length({binary_hex})::BIGINT, 2), lambda i: ('0x' || substr({binary_hex}, i::INT, 2))::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {pieces}), lambda c, b: xor(t.crc[(xor(c, b) & 255) + 1], c >> 8)))"


OP4 = f"""
WITH t AS (SELECT {_CRC_TABLE} AS crc),
d AS (SELECT doc_id, coalesce(text, '') AS text, {_KEY} AS key FROM documents),
c AS (SELECT doc_id, key, strlen(text)::BIGINT + 1 AS size, {_crc("hex(encode(text))")} AS text_crc32 FROM d, t),
r AS (SELECT doc_id, size, text_crc32, {_crc("hex(encode(key || ':' || text_crc32))")} % 1024 AS part,
             {_shard("key", False)} AS shard, {_shard("key", True)} AS grown_shard FROM c, t)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM r"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM s),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
c AS (SELECT doc_id, list(i) AS starts FROM h JOIN m USING (h) WHERE first < doc_id GROUP BY doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 50)))) AS gone FROM c)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE coalesce(list_filter(w, lambda x, i: NOT list_contains(gone, i)), []) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT + 1 AS n_tokens,
    coalesce('s:' || source, 'null') AS key, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
t AS (SELECT key, sum(n_tokens)::BIGINT AS total FROM d GROUP BY key),
x AS (SELECT list(total::DOUBLE ORDER BY key) AS totals, max(total)::DOUBLE AS top FROM t),
b(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT step + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
        SELECT step, lo, hi, mid, list_max(r) / list_min(r) <= 2.0 AS ok FROM (
            SELECT step, lo, hi, (lo + hi) / 2 AS mid, list_transform(totals, lambda v: pow(v / top, (lo + hi) / 2) / v) AS r FROM b, x WHERE step < 50))),
a AS (SELECT hi AS a FROM b WHERE step = 50),
n AS (SELECT sum(pow(total / top, a)) AS norm, max(total / pow(total / top, a)) AS over FROM t, x, a),
p AS (SELECT key, total, pow(total / top, a) / norm AS weight, round(pow(total / top, a) / norm * (over * norm))::BIGINT AS quota FROM t, x, a, n),
e AS (SELECT d.*, sum(n_tokens) OVER (PARTITION BY key ORDER BY o, n_tokens ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM d),
k AS (SELECT e.*, weight, quota // total + (fin <= quota % total)::BIGINT AS times FROM e JOIN p USING (key))
SELECT doc_id, source, n_tokens, round(weight, 9) AS weight, unnest(range(times))::INTEGER AS pass_no, fin - n_tokens AS start FROM k"""


def _loss(m: str, mine: str) -> str:
    left = lambda total, own: f"({total} - CASE WHEN {mine} THEN {own} ELSE 0 END)"
    part = lambda a, b: f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END"
    return f"-ln(0.6 * {part(left(f'c2.{m}', 'o2.n'), left(f'cu.{m}', 'ou.n'))} + 0.3 * {part(left(f'cw.{m}', 'ow.n'), left(f'k.{m}', 'd.n'))} + 0.1 / (k.b + 1))"


OP8 = rf"""
WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
d AS (SELECT d.doc_id, w, len(w)::BIGINT AS n, g.doc_id IS NOT NULL AS y FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) d LEFT JOIN g ON d.doc_id = g.doc_id),
o AS (SELECT doc_id, y, unnest(w) AS w, unnest(list_prepend('', w)[1:len(w)]) AS u FROM d WHERE n > 0),
o2 AS (SELECT doc_id, y, u, w, count(*) AS n FROM o GROUP BY ALL),
o1 AS (SELECT doc_id, y, w, count(*) AS n FROM (SELECT doc_id, y, w FROM o UNION ALL SELECT doc_id, y, '' FROM d WHERE n > 0) GROUP BY ALL),
c2 AS (SELECT u, w, sum(n) AS b, coalesce(sum(n) FILTER (WHERE y), 0) AS t FROM o2 GROUP BY u, w),
c1 AS (SELECT w, sum(n) AS b, coalesce(sum(n) FILTER (WHERE y), 0) AS t FROM o1 GROUP BY w),
k AS (SELECT coalesce(sum(n), 0) AS b, coalesce(sum(n) FILTER (WHERE y), 0) AS t FROM d),
s AS (SELECT o2.doc_id, sum(o2.n * {_loss("b", "true")}) AS b, sum(o2.n * {_loss("t", "o2.y")}) AS t
      FROM o2 JOIN d USING (doc_id) JOIN c2 ON c2.u = o2.u AND c2.w = o2.w JOIN c1 cw ON cw.w = o2.w JOIN c1 cu ON cu.w = o2.u
      JOIN o1 ow ON ow.doc_id = o2.doc_id AND ow.w = o2.w JOIN o1 ou ON ou.doc_id = o2.doc_id AND ou.w = o2.u, k GROUP BY o2.doc_id)
SELECT doc_id, n AS n_tokens, round(coalesce(t, 0) / greatest(n, 1), 6) AS target_loss, round(coalesce(b, 0) / greatest(n, 1), 6) AS background_loss,
       round((coalesce(t, 0) - coalesce(b, 0)) / greatest(n, 1), 6) AS score FROM d LEFT JOIN s USING (doc_id)"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_TERMS} AS w FROM documents),
o AS (SELECT *, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
k AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM o),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM o) WHERE term IN (SELECT term FROM q) GROUP BY row, term),
f AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, k GROUP BY term),
s AS (SELECT q.item_id, o.doc_id, sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (50 + (50 * o.n * k.docs) // k.terms))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN o USING (row), k GROUP BY q.item_id, o.row, o.doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 50"""

def _linked(percent: int, more: str = "") -> str:
    """Components of documents whose shingle sets are similar: all pairs that share a shingle are counted."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS MATERIALIZED (SELECT a, b FROM b JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= {percent} * (na.n + nb.n - common)),
c(doc_id, other) AS (SELECT a, b FROM l UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.other = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, m.first) AS component_id{more}
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS first FROM c GROUP BY doc_id) m USING (doc_id)"""


OP6, OP12 = _linked(75, ", coalesce(m.first >= w.doc_id, true) AS kept"), _linked(80)


def _clusters(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """Rounds of assignment and exact floor means, written out one after the other."""
    gap = "list_sum(list_transform(range(1, {n}), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT".format(n=size + 1)
    near = lambda r: f"SELECT any_value(p.vec_id) AS vec_id, p.row, any_value(p.v) AS v, min({{'d': {gap}, 'c': c.c}}) AS x FROM p, c{r} c GROUP BY p.row"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near(r)})")
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM "
            f"(SELECT x.c AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, {size + 1}) AS t(i) GROUP BY x.c, i) GROUP BY c) m ON m.c = c.c)"
        )
    return f"""
WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM e),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM p WHERE vec_id IS NOT NULL ORDER BY sha256('3:' || vec_id) LIMIT {k}),
{", ".join(steps)},
f AS MATERIALIZED ({near(rounds)})
SELECT vec_id, x.c::INTEGER AS cluster, x.d AS distance, sum(x.d) OVER (PARTITION BY x.c)::BIGINT AS cluster_inertia, sum(x.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM f JOIN c{rounds} c ON c.c = f.x.c"""


ORACLES: dict[str, str] = {"op4_sharding": OP4, "op6_neardup": OP6, "op8_lm": OP8, "op9_substring": OP9, "op10_mixing": OP10, "op11_search": OP11, "op12_join": OP12, "op13_centroids": _clusters()}
