"""Query name -> callable(spark, sf_dir), each over whole tables with fixed parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import functions as fn
from graphloom.operators import algo, confidence, export, hyper, quantized, relate, retrieval, traverse, vectors, versioning
from graphloom.operators.traverse import Direction
from graphloom.sources import imports
from graphloom.sources.mapping import EPOCH, NOW, ORDINALS, Source, gid

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CUSTOMER, ORDER, ITEM, SUPPLIER, PART, REGION = ((ORDINALS[k] << 48) + 1 for k in ("customer", "order", "item", "supplier", "part", "region"))
K = 10


_SOURCES: dict[tuple[str, str], Source] = {}


def source(spark: SparkSession, sf_dir: str) -> Source:
    """The graph of a directory; queries of one application share its tables."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SOURCES:
        _SOURCES[key] = Source(spark, sf_dir)
    return _SOURCES[key]


def query(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(source(spark, sf_dir))
    return f


# reads and scalar functions
@query
def entity_type_counts(s):
    return s.entities().groupBy("entity_type").agg(F.count("*").alias("n"))


@query
def graph_stats(s):
    return traverse.graph_stats(s.entities(), s.relations())


@query
def list_entities(s):
    return s.entities("order").orderBy(F.desc("created_at"), F.desc("id")).limit(20).select("id", "name", "created_at")


@query
def relations_by_source(s):
    return s.relations().where(F.col("source_id") == ORDER).select("source_id", "target_id", "rel_type", "weight")


@query
def property_lookup(s):
    e = s.entities("customer")
    return e.select("id", F.get_json_object("properties", "$.segment").alias("segment"), F.get_json_object("properties", "$.acctbal").cast("double").alias("acctbal"))


@query
def fn_bit_count(s):
    fn.register(s.spark)
    s.entities("order").createOrReplaceTempView("kg_orders")
    return s.spark.sql("SELECT id, kg_bit_count(validity) AS bits FROM kg_orders")


@query
def fn_cosine(s):
    fn.register(s.spark)
    s.vectors().createOrReplaceTempView("kg_vectors")
    s.relations("next_item").createOrReplaceTempView("kg_next")
    return s.spark.sql(
        "SELECT n.source_id, n.target_id, round(kg_cosine_similarity(a.vector, b.vector), 6) AS similarity "
        "FROM kg_next n JOIN kg_vectors a ON a.entity_id = n.source_id JOIN kg_vectors b ON b.entity_id = n.target_id"
    )


@query
def top_utility(s):
    return s.papers().select("arxiv_id", "title", "utility").orderBy(F.desc("utility"), "arxiv_id").limit(5)


# traversal
@query
def neighbors_d1(s):
    return traverse.neighbors(s.entities(), s.relations(), CUSTOMER, 1)


@query
def neighbors_d2(s):
    return traverse.neighbors(s.entities(), s.relations(), CUSTOMER, 2)


@query
def bfs_out(s):
    return traverse.bfs(s.entities(), s.relations(), ORDER, Direction.OUTGOING, 3)


@query
def bfs_in(s):
    return traverse.bfs(s.entities(), s.relations(), REGION, Direction.INCOMING, 2)


@query
def bfs_both(s):
    return traverse.bfs(s.entities(), s.relations(), CUSTOMER, Direction.BOTH, 2)


@query
def bfs_filtered(s):
    return traverse.bfs(s.entities(), s.relations(), ORDER, Direction.OUTGOING, 3, ["placed_by", "located_in"], 0.5)


@query
def find_related(s):
    return traverse.find_related(*s.fresh(), ORDER, 0.5).select("entity_id", "rel_type", "weight")


@query
def context(s):
    return traverse.context(*s.fresh(), CUSTOMER, 1)


@query
def shortest_path(s):
    r = s.relations()
    home = r.where((F.col("source_id") == ORDER) & (F.col("rel_type") == "placed_by")).select(F.col("target_id").alias("source_id"))
    nation = r.where("rel_type = 'located_in'").join(home, "source_id").select(F.col("target_id").alias("source_id"))
    target = r.where("rel_type = 'part_of'").join(nation, "source_id").select("target_id").first()
    return traverse.shortest_path(r, ORDER, target["target_id"], 10)


@query
def shortest_path_ties(s):
    """To the last supplier two hops away: of all parts that lead there, the one whose relations come first."""
    far = traverse.bfs(s.entities(), s.relations(), ORDER, Direction.OUTGOING, 2).where("depth = 2 AND entity_type = 'supplier'").agg(F.max("entity_id")).first()[0]
    return traverse.shortest_path(s.relations(), ORDER, far, 10)


@query
def dfs(s):
    return traverse.dfs(s.entities(), s.relations(), ORDER, Direction.OUTGOING, 3)


# vectors
def _q(s):
    return vectors.vector_of(s.vectors(), ITEM)


@query
def cosine_pairs(s):
    return vectors.pairs(s.vectors(), s.relations("next_item"))


@query
def vector_topk(s):
    return vectors.top_k(s.vectors(), _q(s), K)


@query
def semantic_search(s):
    return retrieval.semantic(s.entities("item"), s.vectors(), _q(s), K)


@query
def similar_entities(s):
    return vectors.similar_entities(s.vectors(), ITEM, K)


@query
def hybrid_search(s):
    return retrieval.hybrid(s.entities("item"), s.relations("next_item"), s.vectors(), _q(s), K)


@query
def vector_fingerprint(s):
    return vectors.fingerprint(s.vectors())


@query
def ann_topk(s):
    return quantized.QuantizedIndex(len(_q(s)), 4).build(s.vectors()).search(_q(s), K)


@query
def ann_stats(s):
    return quantized.QuantizedIndex(len(_q(s)), 3).build(s.vectors()).stats()


# versions
@query
def version_list(s):
    return versioning.listed(s.versions()).select("id", "name", "branch", "bit_slot", "is_merged")


@query
def version_membership(s):
    e = versioning.mark(s.entities("order"), 0, F.col("id") == ORDER + 1)
    return versioning.unmark(e, 0, F.col("id") == ORDER).select("id", "validity")


@query
def version_snapshot(s):
    return versioning.mark(s.entities("order"), 5).select("id", "validity")


@query
def version_entities(s):
    return versioning.version_entities(s.entities(), 0, "order").select("id", "name")


@query
def version_relations(s):
    return versioning.version_relations(s.relations(), 1).select("source_id", "target_id", "rel_type")


@query
def version_neighbors(s):
    e = versioning.mark(s.fresh()[0], 0, F.col("entity_type") != "order")
    r = versioning.mark(s.fresh()[1], 0, F.col("rel_type") != "placed_by")
    return versioning.version_neighbors(e, r, 0, CUSTOMER, 2)


@query
def version_diff(s):
    return versioning.diff(s.entities("order"), 0, 1)


@query
def version_history(s):
    return versioning.history(s.entities("order"), s.versions(), ORDER).select("id", "name")


@query
def version_merge_union(s):
    e, _ = versioning.merge(s.entities("order"), s.relations("placed_by"), [0, 1], 2, versioning.MergeStrategy.UNION)
    return e.select("id", "validity")


@query
def version_merge_intersection(s):
    _, r = versioning.merge(s.entities("order"), s.relations("placed_by"), [0, 1], 2, versioning.MergeStrategy.INTERSECTION)
    return r.select("source_id", "target_id", "validity")


@query
def version_delete_bits(s):
    return versioning.unmark(s.entities("order"), 0).select("id", "validity")


# hypergraph
@query
def list_hyperedges(s):
    return hyper.list_hyperedges(s.hyperedges(), "order", 5, 8, 20).select("id", "arity", F.round("weight", 6).alias("weight"))


@query
def hyperedge_overlap(s):
    return hyper.overlap(s.hyperedges(), [CUSTOMER, PART, PART + 1]).select("id", F.array_join("shared", ",").alias("shared"))


@query
def hyperedge_degree(s):
    return hyper.degree(s.hyperedges())


@query
def ho_neighbors(s):
    return hyper.neighbors(s.hyperedges(), CUSTOMER).select("hyperedge_id", "entity_id", "position", F.round("weight", 6).alias("weight"))


@query
def entity_hyperedges(s):
    return hyper.entity_hyperedges(s.hyperedges(), CUSTOMER).select("id", "arity")


@query
def ho_bfs(s):
    return hyper.bfs(s.hyperedges(), CUSTOMER, 2)


@query
def ho_path(s):
    edges = hyper.kept(s.hyperedges())
    far = hyper.bfs(edges, CUSTOMER, 2).where("depth = 2").agg(F.max("entity_id")).first()[0]
    return hyper.path(edges, CUSTOMER, far if far is not None else CUSTOMER, 3)


@query
def hyper_pagerank_i10(s):
    return hyper.pagerank(s.hyperedges(), iterations=10).select("entity_id", F.round("score", 9).alias("score"))


# algorithms
@query
def pagerank_i10(s):
    return algo.pagerank(s.fresh()[1], iterations=10, tolerance=None).select("entity_id", F.round("score", 9).alias("score"))


@query
def pagerank_converged(s):
    return algo.pagerank(s.fresh()[1]).select("entity_id", F.round("score", 6).alias("score"))


@query
def weak_components(s):
    return algo.weak_components(*s.fresh())


@query
def scc(s):
    return algo.strong_components(s.fresh()[1])


@query
def component_sizes(s):
    return algo.component_sizes(algo.weak_components(*s.fresh()))


@query
def louvain(s):
    return algo.louvain(*s.fresh())


@query
def community_modularity(s):
    groups = s.entities().select(F.col("id").alias("entity_id"), (F.col("id") % 10).alias("community"))
    return algo.modularity(s.relations(), groups)


@query
def analyze(s):
    return algo.analyze(*s.fresh())


@query
def analyze_structure(s):
    """analyze without the communities, whose number depends on the order of moves."""
    return algo.analyze(*s.fresh(), communities=False)


# confidence and retrieval
@query
def confidence_formula(s):
    c = s.table("customer")
    key = F.col("c_custkey")
    value = confidence.formula(F.col("c_acctbal") / 10000, F.lit(0.05), (key % 60).cast("double"), key % 20, (key % 7 - 3).cast("double"))
    return c.select(gid("customer", "c_custkey").alias("entity_id"), F.round(value, 6).alias("confidence"))


@query
def feedback_sum(s):
    return confidence.feedback_sums(s.confidence_log()).select("entity_id", F.round("feedback", 6).alias("feedback"))


@query
def live_confidence(s):
    return confidence.live(s.entities("user"), s.confidence_log(), NOW).select("entity_id", F.round("confidence", 6).alias("confidence"))


@query
def feedback_fold(s):
    log = s.confidence_log().select("entity_id", F.col("id").alias("seq"), F.round(30 * (F.col("new_value") - F.col("old_value")), 6).alias("amount"))
    return confidence.fold_feedback(s.entities("user"), log, NOW).select("entity_id", F.round("confidence", 6).alias("confidence"))


@query
def ripple(s):
    return confidence.ripple(s.dependencies(), SUPPLIER, 0.4)


@query
def ripple_log(s):
    return confidence.ripple_log(s.fresh()[0], confidence.ripple(s.dependencies(), SUPPLIER, 0.4))


@query
def temporal_validity(s):
    o = s.entities("order")
    start = F.col("created_at")
    valid = confidence.temporal_validity(start, start + 1500 * 86_400, 970_000_000)
    return o.select(F.col("id").alias("entity_id"), F.round(valid, 6).alias("validity_factor"))


@query
def dependency_indegree(s):
    return confidence.dependency_indegree(s.dependencies())


def _item_dependencies(s):
    return s.relations("next_item").select("id", "source_id", "target_id", F.lit("depends_on").alias("dep_type"), "created_at")


@query
def smart_search(s):
    return retrieval.smart(s.entities("item"), s.vectors(), _item_dependencies(s), s.confidence_log(), _q(s), K, NOW)


@query
def rag_exact(s):
    return retrieval.rag(s.entities("item"), s.relations("next_item"), s.vectors(), _q(s), K, exact_stage1=True)


@query
def rag_search(s):
    return retrieval.rag(s.entities("item"), s.relations("next_item"), s.vectors(), _q(s), K)


# imports, relation building, export
@query
def import_papers(s):
    p = imports.papers(s.papers())
    return p.select("id", "name", F.get_json_object("properties", "$.arxiv_id").alias("arxiv_id"), F.round(F.get_json_object("properties", "$.utility").cast("double"), 6).alias("utility"))


@query
def import_skills(s):
    k = imports.skills(s.brands())
    return k.select("id", "name", F.get_json_object("properties", "$.description").alias("description"))


@query
def extract_description(s):
    return s.brands().select("name", imports.description("content").alias("description"))


@query
def jaccard(s):
    p = s.papers().select("arxiv_id", relate.keyword_set("keywords").alias("t"), s_key().alias("k"))
    nxt = p.select((F.col("k") - 1).alias("k"), F.col("t").alias("u"))
    return p.join(nxt, "k").select("arxiv_id", F.round(relate.jaccard("t", "u"), 6).alias("similarity"))


def s_key():
    return F.substring("arxiv_id", 2, 20).cast("long")


@query
def derived_from(s):
    papers, skills = imports.papers(s.papers()), imports.skills(s.brands(), 1_000_000_000)
    return relate.derived_from(papers, skills)


@query
def related_by_keywords(s):
    names = s.papers().select(F.col("title").alias("id"), relate.keyword_set("keywords").alias("tokens")).distinct()
    return relate.jaccard_pairs(names, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def similar_descriptions(s):
    d = s.brands().select(F.col("name").alias("id"), relate.word_set(F.concat_ws(" ", imports.description("content"), "name")).alias("tokens"))
    return relate.jaccard_pairs(d, 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _some_vectors(s):
    zero = F.transform("vector", lambda x: x * 0)
    v = s.vectors().where("entity_id % 7 <> 0")
    return v.withColumn("vector", F.when(F.col("entity_id") % 10 == 0, zero).otherwise(F.col("vector")))


@query
def needs_embedding(s):
    return imports.needs_embedding(s.entities(), _some_vectors(s))


@query
def embed_stats(s):
    return imports.embed_stats(s.entities(), _some_vectors(s))


@query
def export_d3_nodes(s):
    return export.d3_nodes(s.entities())


@query
def export_d3_links(s):
    return export.d3_links(s.relations())


@query
def export_dot_lines(s):
    return export.dot_lines(s.entities(), s.relations(), 100)


@query
def entities_created_between(s):
    return s.entities().where(F.col("created_at").between(EPOCH - 86_400 * 1200, EPOCH)).groupBy("entity_type").agg(F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"))


@query
def sql_kg_views(s):
    """Raw SQL over the graph's views: the CTE, JOIN and LIKE shape of hand-written queries."""
    s.entities("customer", "nation").createOrReplaceTempView("kg_entities")
    s.relations("located_in").createOrReplaceTempView("kg_relations")
    return s.spark.sql(
        "WITH homes AS (SELECT r.source_id, n.name AS nation FROM kg_relations r JOIN kg_entities n ON n.id = r.target_id) "
        "SELECT h.nation, count(*) AS customers FROM kg_entities e JOIN homes h ON h.source_id = e.id WHERE e.name ILIKE 'customer%' GROUP BY h.nation"
    )
