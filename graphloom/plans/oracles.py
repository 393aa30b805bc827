"""Query name -> DuckDB SQL over the driver's views, written apart from the Spark plans."""

from __future__ import annotations

_K = 2**48
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, ITEM, DOCUMENT, USER = (k * _K + 1 for k in range(9))
NOW, EPOCH = 1706745600, 1704067200

_PROPS = {
    "region": "'{}'",
    "nation": "'{}'",
    "customer": "json_object('acctbal', printf('%.2f', c_acctbal), 'segment', c_mktsegment)::varchar",
    "supplier": "json_object('acctbal', printf('%.2f', s_acctbal))::varchar",
    "part": "json_object('brand', p_brand, 'size', p_size::varchar, 'type', p_type)::varchar",
}
_PROPS["order"] = "json_object('priority', o_orderpriority, 'status', o_orderstatus)::varchar"
_PROPS["item"] = "json_object('label', label::varchar)::varchar"
_PROPS["document"] = """'{' || concat_ws(',', '"lang":' || to_json(lang)::varchar, '"source":' || to_json(source)::varchar) || '}'"""
_ORDER_MASK = "nullif((case when o_orderkey % 2 = 0 then 1 else 0 end) + (case when o_orderkey % 3 = 0 then 2 else 0 end), 0)::bigint"

E = f"""e AS (
 SELECT r_regionkey::bigint + 1 AS id, 'region' AS entity_type, r_name AS name, {_PROPS['region']} AS properties, {EPOCH}::bigint AS created_at, NULL::bigint AS validity FROM region
 UNION ALL SELECT n_nationkey::bigint + {NATION}, 'nation', n_name, {_PROPS['nation']}, {EPOCH}, NULL FROM nation
 UNION ALL SELECT c_custkey + {CUSTOMER}, 'customer', c_name, {_PROPS['customer']}, {EPOCH}, NULL FROM customer
 UNION ALL SELECT s_suppkey + {SUPPLIER}, 'supplier', s_name, {_PROPS['supplier']}, {EPOCH}, NULL FROM supplier
 UNION ALL SELECT p_partkey + {PART}, 'part', p_name, {_PROPS['part']}, {EPOCH}, NULL FROM part
 UNION ALL SELECT o_orderkey + {ORDER}, 'order', 'Order#' || o_orderkey::varchar, {_PROPS['order']}, epoch(o_orderdate)::bigint, {_ORDER_MASK} FROM orders
 UNION ALL SELECT vec_id + {ITEM}, 'item', 'item_' || vec_id::varchar, {_PROPS['item']}, {EPOCH}, NULL FROM embeddings
 UNION ALL SELECT doc_id + {DOCUMENT}, 'document', 'doc_' || doc_id::varchar, {_PROPS['document']}, {EPOCH}, NULL FROM documents
 UNION ALL SELECT user_id + {USER}, 'user', 'user_' || user_id::varchar, '{{}}', floor(epoch(min(ts)))::bigint, NULL FROM events GROUP BY user_id
)"""
_T = 1 << 60
R = f"""r AS (
 SELECT 'part_of' AS rel_type, {3 * _T} + n_nationkey::bigint AS id, n_nationkey::bigint + {NATION} AS source_id, n_regionkey::bigint + 1 AS target_id, 1.0::double AS weight, NULL::bigint AS validity FROM nation
 UNION ALL SELECT 'located_in', {_T} + 2 * c_custkey::bigint, c_custkey + {CUSTOMER}, c_nationkey::bigint + {NATION}, 1.0, NULL FROM customer
 UNION ALL SELECT 'located_in', {_T} + 2 * s_suppkey::bigint + 1, s_suppkey + {SUPPLIER}, s_nationkey::bigint + {NATION}, 1.0, NULL FROM supplier
 UNION ALL SELECT 'placed_by', {4 * _T} + o_orderkey::bigint, o_orderkey + {ORDER}, o_custkey + {CUSTOMER}, 1.0, {_ORDER_MASK} FROM orders
 UNION ALL SELECT 'contains', l_orderkey::bigint * 4096 + min(l_linenumber)::bigint, l_orderkey + {ORDER}, l_partkey + {PART}, round(avg(l_quantity) / 50, 6), NULL FROM lineitem GROUP BY l_orderkey, l_partkey
 UNION ALL SELECT 'supplied_by', {5 * _T} + l_partkey::bigint * 268435456 + l_suppkey, l_partkey + {PART}, l_suppkey + {SUPPLIER}, round(1 - (avg(l_discount) + 0.0), 6), NULL FROM lineitem GROUP BY l_partkey, l_suppkey
 UNION ALL SELECT 'next_item', {2 * _T} + v, v + {ITEM}, t + {ITEM}, 0.5, NULL FROM (SELECT vec_id AS v, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) AS t FROM embeddings) WHERE v <> t
)"""
V = "v AS (SELECT vec_id + {ITEM} AS entity_id, embedding::double[] AS x FROM embeddings)"
H = """h AS (
 SELECT o_orderkey + 1 AS id, list_prepend(o_custkey + {CUSTOMER}, parts) AS members, least(1.0, o_totalprice / 500000) AS weight, len(parts) + 1 AS arity, epoch(o_orderdate)::bigint AS created_at
 FROM orders JOIN (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey + {PART})) AS parts FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
), b AS (SELECT id AS hyperedge_id, unnest(members) AS entity_id, generate_subscripts(members, 1) - 1 AS position, weight, arity FROM h)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _links(direction: str, where: str = "true") -> str:
    out = f"SELECT source_id AS node, target_id AS far, 0::bigint AS dir, id AS rel_id, rel_type, weight FROM r WHERE {where}"
    back = f"SELECT target_id, source_id, 1::bigint, id, rel_type, weight FROM r WHERE {where}"
    return "links AS (" + {"out": out, "in": back.replace("target_id,", "target_id AS node,", 1).replace("source_id,", "source_id AS far,", 1).replace("1::bigint", "1::bigint AS dir").replace(" id,", " id AS rel_id,"), "both": f"{out} UNION ALL {back}"}[direction] + ")"


def _levels(start: int, depth: int) -> str:
    parts = [f"l0 AS (SELECT {start}::bigint AS id, []::bigint[] AS key, NULL::varchar AS rel_type, NULL::double AS weight, 0 AS depth)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(k))
        parts.append(
            f"l{k} AS (SELECT far AS id, key, rel_type, weight, {k} AS depth FROM (SELECT far, p.key || [dir, rel_id] AS key, links.rel_type, links.weight, "
            f"row_number() OVER (PARTITION BY far ORDER BY p.key || [dir, rel_id]) AS n FROM links JOIN l{k - 1} p ON p.id = links.node WHERE far NOT IN ({seen})) WHERE n = 1)"
        )
    return ",\n".join(parts)


def _union(depth: int, first: int = 0) -> str:
    return " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(first, depth + 1))


def _neighbors(start: int, depth: int, r: str = R, e: str = E) -> str:
    return _with(e, r, _links("both"), _levels(start, depth)) + (
        f"SELECT e.id AS entity_id, e.entity_type, e.name, u.depth, u.rel_type, u.weight FROM ({_union(depth, 1)}) u JOIN e USING (id)"
    )


def _bfs(start: int, direction: str, depth: int, where: str = "true") -> str:
    return _with(E, R, _links(direction, where), _levels(start, depth)) + f"SELECT e.id AS entity_id, e.entity_type, u.depth FROM ({_union(depth)}) u JOIN e USING (id)"


_COS = "CASE WHEN list_dot_product({a}, {a}) > 0 AND list_dot_product({b}, {b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0 END"
_TOP = f"q AS (SELECT x AS qx FROM v WHERE entity_id = {ITEM}), scored AS (SELECT entity_id, round({_COS.format(a='x', b='qx')}, 6) AS similarity FROM v, q)"
_PAIRS = _with(R, V) + f"SELECT r.source_id, r.target_id, round({_COS.format(a='a.x', b='b.x')}, 6) AS similarity FROM r JOIN v a ON a.entity_id = r.source_id JOIN v b ON b.entity_id = r.target_id WHERE rel_type = 'next_item'"
_ITEM_LINKS = "near AS (SELECT DISTINCT entity_id, far FROM (SELECT source_id AS entity_id, target_id AS far FROM r WHERE rel_type = 'next_item' UNION ALL SELECT target_id, source_id FROM r WHERE rel_type = 'next_item') WHERE entity_id <> far)"
_PAPERS = "papers AS (SELECT 'p' || p_partkey::varchar AS arxiv_id, p_name AS title, round(p_retailprice / 1000, 6) AS utility, p_brand AS skill_created, p_partkey AS k, list_distinct(string_split_regex(lower(p_name), '\\s+')) AS words FROM part)"
_BRANDS = "brands AS (SELECT p_brand AS name, 'Makes ' || string_agg(p_type, ' ' ORDER BY p_type) AS description FROM (SELECT DISTINCT p_brand, p_type FROM part) GROUP BY p_brand)"
_FEEDBACK = "fb AS (SELECT user_id + {USER} AS entity_id, greatest(-1.0, least(1.0, sum(CASE WHEN event_type = 'error' THEN -0.01::double ELSE 0.01::double END))) AS feedback FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id)"
_USERS = "u AS (SELECT user_id + {USER} AS entity_id, floor(epoch(min(ts)))::bigint AS created_at, count(*) FILTER (event_type IN ('view', 'click')) AS access FROM events GROUP BY user_id)"
_JACCARD = "len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b})))"
_DEPS = "d AS (SELECT DISTINCT l_partkey + {PART} AS source_id, l_suppkey + {SUPPLIER} AS target_id FROM lineitem UNION ALL SELECT DISTINCT l_orderkey + {ORDER}, l_partkey + {PART} FROM lineitem)"
_RIPPLE = (
    f", one AS (SELECT source_id AS entity_id FROM d WHERE target_id = {SUPPLIER}), two AS (SELECT DISTINCT source_id AS entity_id FROM d WHERE target_id IN (SELECT entity_id FROM one)), "
    f"hops AS (SELECT entity_id, 1 AS hop FROM one UNION ALL SELECT entity_id, 2 FROM two WHERE entity_id NOT IN (SELECT entity_id FROM one) AND entity_id <> {SUPPLIER}) "
)


def _pagerank(iterations: int, converged: bool = False) -> str:
    """The scores after a number of iterations; with converged, the relation stopped: those of the first whose change is below 1e-6."""
    parts = [R] * (not converged) + ["m AS (SELECT source_id AS s, target_id AS t, count(*) AS m FROM r GROUP BY ALL)", "o AS (SELECT s, sum(m) AS deg FROM m GROUP BY s)", "w AS MATERIALIZED (SELECT m.s, m.t, m.m / o.deg AS p FROM m JOIN o USING (s))",
             "n AS (SELECT s AS id FROM w UNION SELECT t FROM w)", "cnt AS (SELECT count(*)::double AS c FROM n)", "p0 AS MATERIALIZED (SELECT id, 1.0 / c AS score FROM n, cnt)"]
    for k in range(1, iterations + 1):
        parts.append(f"g{k} AS (SELECT w.t AS id, sum(p.score * w.p) AS got FROM w JOIN p{k - 1} p ON p.id = w.s GROUP BY w.t)")
        parts.append(f"d{k} AS (SELECT coalesce(sum(p.score), 0) AS dangling FROM p{k - 1} p WHERE p.id NOT IN (SELECT s FROM o))")
        parts.append(f"p{k} AS MATERIALIZED (SELECT n.id, (1 - 0.85::double) / c + 0.85::double * (coalesce(got, 0) + dangling / c) AS score FROM n LEFT JOIN g{k} USING (id), cnt, d{k})")
    if not converged:
        return _with(*parts) + f"SELECT id AS entity_id, round(score, 9) AS score FROM p{iterations}"
    moves = " UNION ALL ".join(f"SELECT {k} AS k, (SELECT sum(abs(a.score - b.score)) FROM p{k} a JOIN p{k - 1} b USING (id)) AS change" for k in range(1, iterations + 1))
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM p{k}" for k in range(1, iterations + 1))
    parts += [f"moves AS MATERIALIZED ({moves})", f"stopped AS (SELECT id, score FROM ({every}) WHERE k = (SELECT coalesce(min(k), {iterations}) FROM moves WHERE change < 1e-6))"]
    return "WITH " + ",\n".join(parts) + "\n"


def _hyper_pagerank(iterations: int) -> str:
    parts = [H, "deg AS (SELECT entity_id, count(DISTINCT hyperedge_id) AS degree FROM b GROUP BY entity_id)", "c AS (SELECT count(*)::double AS c FROM deg)", "p0 AS MATERIALIZED (SELECT entity_id, degree, 1.0 / c AS score FROM deg, c)"]
    for k in range(1, iterations + 1):
        parts.append(f"s{k} AS (SELECT hyperedge_id, b.entity_id, weight, arity, score / degree AS share FROM b JOIN p{k - 1} USING (entity_id))")
        parts.append(f"a{k} AS (SELECT entity_id, sum(0.85::double * weight / (arity * arity) * (tot - share)) AS got FROM (SELECT *, sum(share) OVER (PARTITION BY hyperedge_id) AS tot FROM s{k}) GROUP BY entity_id)")
        parts.append(f"x{k} AS (SELECT p.entity_id, degree, (1 - 0.85::double) / c + coalesce(got, 0) AS score FROM p{k - 1} p LEFT JOIN a{k} USING (entity_id), c)")
        parts.append(f"p{k} AS MATERIALIZED (SELECT entity_id, degree, score / (SELECT sum(score) FROM x{k}) AS score FROM x{k})")
    return _with(*parts) + f"SELECT entity_id, round(score, 9) AS score FROM p{iterations}"


_HO = f"""k0 AS (SELECT {CUSTOMER}::bigint AS id),
k1 AS (SELECT entity_id AS id, min([-weight, hyperedge_id::double, position::double]) AS key FROM b WHERE entity_id <> {CUSTOMER} AND arity BETWEEN 2 AND 100 AND hyperedge_id IN (SELECT hyperedge_id FROM b WHERE entity_id = {CUSTOMER}) GROUP BY entity_id),
k2 AS (SELECT far.entity_id AS id, min(k1.key || [-far.weight, far.hyperedge_id::double, far.position::double]) AS key FROM k1 JOIN b near ON near.entity_id = k1.id JOIN b far ON far.hyperedge_id = near.hyperedge_id AND far.entity_id <> k1.id
 WHERE far.arity BETWEEN 2 AND 100 AND far.entity_id <> {CUSTOMER} AND far.entity_id NOT IN (SELECT id FROM k1) GROUP BY far.entity_id)"""
_ITEM_ROOTS = """link AS (SELECT vec_id + {ITEM} AS v, (vec_id * 7 + 3) % (SELECT count(*) FROM embeddings) + {ITEM} AS w FROM embeddings),
reach AS (SELECT v AS root, v AS id FROM link UNION SELECT reach.root, link.w FROM reach JOIN link ON link.v = reach.id),
items AS (SELECT id AS entity_id, min(root) AS component FROM reach GROUP BY id)"""


def _components(rounds: int = 14) -> str:
    """Smallest labels spread over the links of all types but next_item, whose rings are closed apart."""
    parts = ["ends AS (SELECT DISTINCT source_id AS v, target_id AS w FROM r WHERE rel_type <> 'next_item' UNION SELECT target_id, source_id FROM r WHERE rel_type <> 'next_item')"]
    parts.append("c0 AS MATERIALIZED (SELECT v, least(v, min(w)) AS c FROM ends GROUP BY v)")
    for k in range(1, rounds + 1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT ends.v, least(any_value(own.c), min(far.c)) AS c FROM ends JOIN c{k - 1} own ON own.v = ends.v JOIN c{k - 1} far ON far.v = ends.w GROUP BY ends.v)")
    last = "SELECT entity_id, component FROM items UNION ALL SELECT e.id, coalesce(c, e.id) FROM e LEFT JOIN c{0} ON v = e.id WHERE entity_type <> 'item'".format(rounds)
    return "WITH RECURSIVE " + ",\n".join([E, R, _ITEM_ROOTS, *parts, f"comp AS ({last})"])


_DFS = f"""WITH RECURSIVE {R}, adj AS (SELECT source_id AS node, list(target_id ORDER BY id) AS kids FROM r GROUP BY source_id),
walk AS (SELECT [{{'n': {ORDER}::bigint, 'd': 0}}] AS stack, []::bigint[] AS seen, NULL::bigint AS entity_id, 0 AS depth, -1 AS position, false AS hit
 UNION ALL SELECT CASE WHEN list_contains(seen, stack[1].n) OR stack[1].d >= 3 OR kids IS NULL THEN stack[2:] ELSE list_concat(list_transform(range(1, len(kids) + 1), lambda k: {{'n': kids[k], 'd': stack[1].d + 1}}), stack[2:]) END,
 CASE WHEN list_contains(seen, stack[1].n) THEN seen ELSE list_append(seen, stack[1].n) END, stack[1].n, stack[1].d, position + CASE WHEN list_contains(seen, stack[1].n) THEN 0 ELSE 1 END, NOT list_contains(seen, stack[1].n)
 FROM walk LEFT JOIN adj ON adj.node = stack[1].n WHERE len(stack) > 0)
SELECT entity_id, depth, position FROM walk WHERE hit"""


def _path(target: str) -> str:
    """Steps of the smallest key's path from ORDER to the one row of target among nodes three levels deep."""
    return _with(R, _links("out"), _levels(ORDER, 3)) + (
        f", every AS ({_union(3, 1)}), t AS (SELECT * FROM every WHERE id = ({target})), s AS (SELECT unnest(range(1, len(key) // 2 + 1)) AS step, key FROM t) "
        "SELECT step::int AS step, source_id AS from_id, target_id AS to_id, rel_type, weight FROM s JOIN r ON r.id = key[2 * step]"
    )


_CREATED_DAYS = (NOW - EPOCH) / 86400

ORACLES: dict[str, str] = {
    "entity_type_counts": _with(E) + "SELECT entity_type, count(*) AS n FROM e GROUP BY 1",
    "graph_stats": _with(E, R)
    + """, d AS (SELECT id, sum(o) AS o, sum(i) AS i FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM r UNION ALL SELECT target_id, 0, 1 FROM r) GROUP BY id), n AS (SELECT count(*) AS n FROM e), m AS (SELECT count(*) AS m FROM r)
 SELECT n AS total_entities, m AS total_relations, round(2 * m / n, 6) AS avg_degree, (SELECT max(greatest(o, i)) FROM d)::bigint AS max_degree, (SELECT max(o + i) FROM d)::bigint AS total_max_degree, round(m / (n * (n - 1)), 9) AS density FROM n, m""".replace(", d AS", ", d AS", 1),
    "list_entities": _with(E) + "SELECT id, name, created_at FROM e WHERE entity_type = 'order' ORDER BY created_at DESC, id DESC LIMIT 20",
    "relations_by_source": _with(R) + f"SELECT source_id, target_id, rel_type, weight FROM r WHERE source_id = {ORDER}",
    "property_lookup": "SELECT c_custkey + {CUSTOMER} AS id, c_mktsegment AS segment, printf('%.2f', c_acctbal)::double AS acctbal FROM customer",
    "fn_bit_count": _with(E) + "SELECT id, coalesce(bit_count(validity), 0)::int AS bits FROM e WHERE entity_type = 'order'",
    "fn_cosine": _PAIRS,
    "cosine_pairs": _PAIRS,
    "top_utility": _with(_PAPERS) + "SELECT arxiv_id, title, utility FROM papers ORDER BY utility DESC, arxiv_id LIMIT 5",
    "neighbors_d1": _neighbors(CUSTOMER, 1),
    "neighbors_d2": _neighbors(CUSTOMER, 2),
    "bfs_out": _bfs(ORDER, "out", 3),
    "bfs_in": _bfs(REGION, "in", 2),
    "bfs_both": _bfs(CUSTOMER, "both", 2),
    "bfs_filtered": _bfs(ORDER, "out", 3, "rel_type IN ('placed_by', 'located_in') AND weight >= 0.5"),
    "find_related": _with(E, R, _links("both"), _levels(ORDER, 1)) + "SELECT id AS entity_id, rel_type, weight FROM l1 WHERE weight >= 0.5",
    "context": _neighbors(CUSTOMER, 1) + f" UNION ALL SELECT id, entity_type, name, 0, NULL, NULL FROM e WHERE id = {CUSTOMER}",
    "shortest_path": _path("SELECT g.target_id FROM r a JOIN r n ON n.source_id = a.target_id JOIN r g ON g.source_id = n.target_id WHERE a.source_id = {ORDER} AND a.rel_type = 'placed_by'"),
    "shortest_path_ties": _path("SELECT max(id) FROM l2 WHERE id >= {SUPPLIER} AND id < {PART}"),
    "vector_topk": _with(V, _TOP) + "SELECT entity_id, similarity FROM scored ORDER BY similarity DESC, entity_id LIMIT 10",
    "semantic_search": _with(V, _TOP) + "SELECT entity_id, 'item' AS entity_type, 'item_' || (entity_id - {ITEM})::varchar AS name, similarity FROM scored ORDER BY similarity DESC, entity_id LIMIT 10",
    "similar_entities": _with(V, _TOP) + f"SELECT entity_id, similarity FROM scored WHERE entity_id <> {ITEM} ORDER BY similarity DESC, entity_id LIMIT 10",
    "hybrid_search": _with(R, V, _TOP, _ITEM_LINKS)
    + ", t AS (SELECT * FROM scored ORDER BY similarity DESC, entity_id LIMIT 10) SELECT entity_id, similarity, coalesce((SELECT string_agg(far::varchar, ',' ORDER BY far) FROM near WHERE near.entity_id = t.entity_id), '') AS context FROM t",
    "vector_fingerprint": "SELECT count(*) AS vector_count, sum(vec_id + {ITEM})::varchar AS id_sum, round(sum(list_dot_product(embedding::double[], range(1, len(embedding) + 1)::double[])), 4) AS content FROM embeddings",
    "version_list": "SELECT * FROM (VALUES (1::bigint, 'v1', 'main', 0, false), (2::bigint, 'v2', 'main', 1, false)) t(id, name, branch, bit_slot, is_merged)",
    "version_membership": _with(E) + f"SELECT id, CASE WHEN id = {ORDER + 1} THEN coalesce(validity, 0) | 1 WHEN id = {ORDER} THEN nullif(validity & ~1::bigint, 0) ELSE validity END AS validity FROM e WHERE entity_type = 'order'",
    "version_snapshot": _with(E) + "SELECT id, coalesce(validity, 0) | 32 AS validity FROM e WHERE entity_type = 'order'",
    "version_entities": "SELECT o_orderkey + {ORDER} AS id, 'Order#' || o_orderkey::varchar AS name FROM orders WHERE o_orderkey % 2 = 0",
    "version_relations": "SELECT o_orderkey + {ORDER} AS source_id, o_custkey + {CUSTOMER} AS target_id, 'placed_by' AS rel_type FROM orders WHERE o_orderkey % 3 = 0",
    "version_neighbors": _neighbors(CUSTOMER, 2, R.replace("r AS (", "rr AS (", 1) + ", r AS (SELECT * FROM rr WHERE (rel_type <> 'placed_by' OR validity & 1 = 1) AND source_id NOT IN (SELECT o_orderkey + {ORDER} FROM orders WHERE o_orderkey % 2 = 1))"),
    "version_diff": _with(E) + "SELECT id, CASE validity WHEN 3 THEN 'common' WHEN 2 THEN 'added' ELSE 'removed' END AS change FROM e WHERE entity_type = 'order' AND validity IS NOT NULL",
    "version_history": "SELECT * FROM (VALUES (1::bigint, 'v1'), (2::bigint, 'v2')) t(id, name)",
    "version_merge_union": _with(E) + "SELECT id, CASE WHEN validity IS NOT NULL THEN validity | 4 END AS validity FROM e WHERE entity_type = 'order'",
    "version_merge_intersection": _with(R) + "SELECT source_id, target_id, CASE WHEN validity = 3 THEN 7 ELSE validity END::bigint AS validity FROM r WHERE rel_type = 'placed_by'",
    "version_delete_bits": _with(E) + "SELECT id, nullif(validity & ~1::bigint, 0) AS validity FROM e WHERE entity_type = 'order'",
    "list_hyperedges": _with(H) + "SELECT id, arity::int AS arity, round(weight, 6) AS weight FROM h WHERE arity BETWEEN 5 AND 8 ORDER BY created_at DESC, id DESC LIMIT 20",
    "hyperedge_overlap": _with(H) + f"SELECT hyperedge_id AS id, string_agg(entity_id::varchar, ',' ORDER BY entity_id) AS shared FROM b WHERE entity_id IN ({CUSTOMER}, {PART}, {PART + 1}) GROUP BY 1",
    "hyperedge_degree": _with(H) + "SELECT entity_id, count(DISTINCT hyperedge_id) AS degree FROM b GROUP BY 1",
    "ho_neighbors": _with(H) + f"SELECT hyperedge_id, entity_id, position::int AS position, round(weight, 6) AS weight FROM b WHERE entity_id <> {CUSTOMER} AND hyperedge_id IN (SELECT hyperedge_id FROM b WHERE entity_id = {CUSTOMER})",
    "entity_hyperedges": _with(H) + f"SELECT hyperedge_id AS id, arity::int AS arity FROM b WHERE entity_id = {CUSTOMER}",
    "ho_bfs": _with(H, _HO) + "SELECT id AS entity_id, 1 AS depth FROM k1 UNION ALL SELECT id, 2 FROM k2",
    "ho_path": _with(H, _HO) + ", t AS (SELECT key FROM k2 ORDER BY id DESC LIMIT 1) SELECT 1 AS step, key[2]::bigint AS hyperedge_id FROM t UNION ALL SELECT 2, key[5]::bigint FROM t",
    "hyper_pagerank_i10": _hyper_pagerank(10),
    "pagerank_i10": _pagerank(10),
    "pagerank_converged": "WITH " + R + ", " + _pagerank(100, converged=True)[5:] + "SELECT id AS entity_id, round(score, 6) AS score FROM stopped",
    "analyze_structure": _components()
    + ", " + _pagerank(100, converged=True)[5:] + "SELECT (SELECT id FROM stopped ORDER BY round(score, 9) DESC, id LIMIT 1) AS top_entity, (SELECT count(DISTINCT component) FROM comp) AS num_components, (SELECT max(n) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS largest_component",
    "weak_components": _components() + "SELECT entity_id, component FROM comp",
    "component_sizes": _components() + "SELECT component, count(*) AS size FROM comp GROUP BY component",
    "scc": "WITH RECURSIVE " + R + ", " + _ITEM_ROOTS + " SELECT entity_id, component FROM items WHERE entity_id IN (SELECT source_id FROM r) UNION ALL SELECT DISTINCT id, id FROM (SELECT source_id AS id FROM r WHERE rel_type <> 'next_item' UNION ALL SELECT target_id FROM r WHERE rel_type <> 'next_item')",
    "dfs": _DFS,
    "ann_stats": "SELECT count(*) AS vector_count, 64 AS dimension, 3 AS bits, count(*) * 64 AS code_bytes, round(32 / 3::double, 6) AS nominal_ratio FROM embeddings",
    "community_modularity": _with(R)
    + ", g AS (SELECT source_id % 10 AS a, target_id % 10 AS b, weight FROM r), m AS (SELECT sum(weight) AS m FROM g), o AS (SELECT a AS c, sum(weight) AS o FROM g GROUP BY a), i AS (SELECT b AS c, sum(weight) AS i FROM g GROUP BY b) "
    "SELECT round((SELECT sum(weight) FROM g WHERE a = b) / m, 6) AS intra_weight_fraction, round((SELECT sum(weight) FROM g WHERE a = b) / m - (SELECT sum(o.o * i.i) FROM o JOIN i USING (c)) / (m * m), 6) AS modularity FROM m",
    "confidence_formula": "SELECT c_custkey + {CUSTOMER} AS entity_id, round(c_acctbal / 10000 * exp(-0.05::double * (c_custkey % 60)) + 0.1::double * ln(1 + c_custkey % 20) + greatest(-1, least(1, c_custkey % 7 - 3)), 6) AS confidence FROM customer",
    "feedback_sum": _with(_FEEDBACK) + "SELECT entity_id, round(feedback, 6) AS feedback FROM fb",
    "live_confidence": _with(_FEEDBACK, _USERS) + f"SELECT entity_id, round(exp(-0.05::double * greatest(0, {NOW} - created_at) / 86400) + 0.1::double * ln(1 + access) + coalesce(feedback, 0), 6) AS confidence FROM u LEFT JOIN fb USING (entity_id)",
    "feedback_fold": _with(_USERS)
    + ", steps AS (SELECT user_id + {USER} AS entity_id, list(CASE WHEN event_type = 'error' THEN -0.3::double ELSE 0.3::double END ORDER BY event_id) AS x FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id) "
    + f"SELECT entity_id, round(exp(-0.05::double * greatest(0, {NOW} - created_at) / 86400) + 0.1::double * ln(1 + access) + list_reduce(list_prepend(0.0::double, x), lambda s, v: greatest(-1.0, least(1.0, s + v))), 6) AS confidence FROM u JOIN steps USING (entity_id)",
    "ripple": _with(_DEPS) + _RIPPLE + "SELECT entity_id, hop, 0.4::double * power(0.5, hop) AS penalty FROM hops",
    "ripple_log": _with(_DEPS) + _RIPPLE + "SELECT entity_id, 1.0::double AS old_value, greatest(0, 1 - 0.4::double * power(0.5, hop)) AS new_value FROM hops",
    "temporal_validity": "SELECT o_orderkey + {ORDER} AS entity_id, round(CASE WHEN 970000000 < epoch(o_orderdate) THEN 0.0 WHEN 970000000 > epoch(o_orderdate) + 1500 * 86400 THEN exp(-0.1::double * (970000000 - (epoch(o_orderdate) + 1500 * 86400)) / 86400) ELSE 1.0 END::double, 6) AS validity_factor FROM orders",
    "dependency_indegree": _with(_DEPS) + "SELECT target_id AS entity_id, count(*) AS dependents FROM d GROUP BY 1",
    "smart_search": _with(R, V, _TOP)
    + f", pool AS (SELECT * FROM scored ORDER BY similarity DESC, entity_id LIMIT 30), i AS (SELECT target_id AS entity_id, count(*) AS n FROM r WHERE rel_type = 'next_item' GROUP BY 1), "
    f"w AS (SELECT p.*, exp(-0.05::double * {_CREATED_DAYS}) AS confidence, coalesce(coalesce(n, 0) / (SELECT nullif(max(coalesce(n, 0)), 0) FROM pool LEFT JOIN i USING (entity_id))::double, 0.0) AS importance FROM pool p LEFT JOIN i USING (entity_id)) "
    "SELECT entity_id, similarity, round(confidence, 6) AS confidence, round(importance, 6) AS importance, 1.0::double AS temporal, round(0.5::double * similarity + 0.2::double * confidence + 0.2::double * importance + 0.1::double, 6) AS score FROM w ORDER BY score DESC, entity_id LIMIT 10",
    "rag_exact": _with(R, V, _TOP, _ITEM_LINKS)
    + """, s1 AS (SELECT * FROM scored ORDER BY similarity DESC, entity_id LIMIT 50), s2 AS (SELECT entity_id, similarity AS vs FROM s1 WHERE similarity >= 0.3 ORDER BY similarity DESC, entity_id LIMIT 20),
 x AS (SELECT entity_id, similarity AS vs FROM scored WHERE similarity >= 0.3 AND entity_id IN (SELECT far FROM near WHERE entity_id IN (SELECT entity_id FROM s2)) AND entity_id NOT IN (SELECT entity_id FROM s2)),
 pool AS (SELECT * FROM s2 UNION ALL SELECT * FROM x), n AS (SELECT count(*) AS n FROM pool),
 g AS (SELECT p.entity_id, vs, round(CASE WHEN n > 1 THEN (SELECT count(*) FROM near WHERE near.entity_id = p.entity_id AND far IN (SELECT entity_id FROM pool)) / (n - 1)::double ELSE 0 END, 6) AS gs FROM pool p, n),
 top AS (SELECT entity_id, vs, gs, round(0.6::double * vs + 0.4::double * gs, 6) AS score FROM g WHERE round(0.6::double * vs + 0.4::double * gs, 6) >= 0.25 ORDER BY score DESC, entity_id LIMIT 10),
 around AS (SELECT t.entity_id, near.far, 1 AS hop FROM top t JOIN near USING (entity_id) UNION ALL SELECT t.entity_id, b.far, 2 FROM top t JOIN near a ON a.entity_id = t.entity_id JOIN near b ON b.entity_id = a.far WHERE b.far <> t.entity_id),
 ranked AS (SELECT entity_id, far, row_number() OVER (PARTITION BY entity_id ORDER BY CASE WHEN far IN (SELECT entity_id FROM pool) THEN 0 ELSE 1 END, min(hop), far) AS k FROM around GROUP BY entity_id, far)
 SELECT entity_id, vs AS vector_score, gs AS graph_score, score, coalesce((SELECT string_agg(far::varchar, ',' ORDER BY k) FROM ranked WHERE k <= 5 AND ranked.entity_id = top.entity_id), '') AS context FROM top""",
    "import_papers": _with(_PAPERS) + "SELECT row_number() OVER (ORDER BY arxiv_id) AS id, title AS name, arxiv_id, utility FROM papers",
    "import_skills": _with(_BRANDS) + "SELECT row_number() OVER (ORDER BY name) AS id, name, description FROM brands",
    "extract_description": _with(_BRANDS) + "SELECT name, description FROM brands",
    "jaccard": _with(_PAPERS) + f"SELECT a.arxiv_id, round({_JACCARD.format(a='a.words', b='b.words')}, 6) AS similarity FROM papers a JOIN papers b ON b.k = a.k + 1",
    "derived_from": _with(_PAPERS, _BRANDS)
    + ", p AS (SELECT row_number() OVER (ORDER BY arxiv_id) AS id, skill_created FROM papers), k AS (SELECT row_number() OVER (ORDER BY name) + 999999999 AS id, name FROM brands) SELECT p.id AS source_id, k.id AS target_id FROM p JOIN k ON k.name = p.skill_created",
    "related_by_keywords": _with(_PAPERS) + f", n AS (SELECT DISTINCT title, list_sort(words) AS w FROM papers) SELECT x.title AS a, y.title AS b, round({_JACCARD.format(a='x.w', b='y.w')}, 6) AS similarity FROM n x JOIN n y ON x.title < y.title WHERE {_JACCARD.format(a='x.w', b='y.w')} > 0.3",
    "similar_descriptions": _with(_BRANDS) + f", n AS (SELECT name, list_distinct(string_split(description || ' ' || name, ' ')) AS w FROM brands) SELECT x.name AS a, y.name AS b, round({_JACCARD.format(a='x.w', b='y.w')}, 6) AS similarity FROM n x JOIN n y ON x.name < y.name WHERE {_JACCARD.format(a='x.w', b='y.w')} > 0.3",
    "needs_embedding": _with(E) + "SELECT id, name FROM e WHERE entity_type <> 'item' OR id % 7 = 0 OR id % 10 = 0",
    "embed_stats": _with(E) + ", p AS (SELECT entity_type, entity_type <> 'item' OR id % 7 = 0 OR id % 10 = 0 AS pending FROM e) SELECT entity_type, count(*) AS total, count(*) FILTER (pending) AS pending, count(*) FILTER (NOT pending) AS done FROM p GROUP BY 1",
    "export_d3_nodes": _with(E) + """SELECT id, '{"id":' || id::varchar || ',"name":' || to_json(name)::varchar || ',"type":"' || entity_type || '","properties":' || properties || '}' AS json FROM e""",
    "export_d3_links": _with(R) + """SELECT id, '{"source":' || source_id::varchar || ',"target":' || target_id::varchar || ',"type":"' || rel_type || '","weight":' || weight::varchar || '}' AS json FROM r""",
    "export_dot_lines": _with(E, R)
    + """, k AS (SELECT * FROM e ORDER BY id LIMIT 100), f AS (SELECT entity_type, row_number() OVER (ORDER BY min(id)) - 1 AS c FROM k GROUP BY entity_type),
 pal AS (SELECT ['#4e79a7', '#f28e2b', '#59a14f', '#e15759', '#76b7b2', '#edc948', '#b07aa1', '#9c755f'] AS p)
 SELECT 0 AS part, id, '  ' || id::varchar || ' [label="' || replace(replace(replace(name, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '", fillcolor="' || p[c % 8 + 1] || '"];' AS line FROM k JOIN f USING (entity_type), pal
 UNION ALL SELECT 1, id, '  ' || source_id::varchar || ' -> ' || target_id::varchar || ' [label="' || rel_type || '", weight=' || printf('%.4f', weight) || '];' FROM r WHERE source_id IN (SELECT id FROM k) AND target_id IN (SELECT id FROM k)""",
    "entities_created_between": _with(E) + f"SELECT entity_type, count(*) AS n, min(created_at) AS first, max(created_at) AS last FROM e WHERE created_at BETWEEN {EPOCH - 86400 * 1200} AND {EPOCH} GROUP BY 1",
    "sql_kg_views": "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_name ILIKE 'customer%' GROUP BY n_name",
}

_NAMES = {"NATION": NATION, "CUSTOMER": CUSTOMER, "SUPPLIER": SUPPLIER, "PART": PART, "ORDER": ORDER, "ITEM": ITEM, "DOCUMENT": DOCUMENT, "USER": USER}
for _query, _text in ORACLES.items():
    for _name, _id in _NAMES.items():
        _text = _text.replace("{" + _name + "}", str(_id))
    ORACLES[_query] = _text
