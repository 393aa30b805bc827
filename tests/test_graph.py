"""Micro-graphs with known answers, through the facade."""

import random

import pytest

from graphloom import schema
from graphloom.operators import algo, confidence, export, quantized, relate, versioning
from graphloom.operators.traverse import Direction
from graphloom.store import KnowledgeGraph


def build(spark, names, links=()):
    kg = KnowledgeGraph.in_memory(spark)
    ids = kg.insert_entities([{"entity_type": "n", "name": n} for n in names], now=100)
    at = dict(zip(names, ids, strict=True))
    if links:
        kg.insert_relations([{"source_id": at[a], "target_id": at[b], "rel_type": "r", "weight": w} for a, b, w in links], now=100)
    return kg, at


def names(kg, df, column="entity_id"):
    by = {r["id"]: r["name"] for r in kg.entities.select("id", "name").collect()}
    return [by[r[column]] for r in df.collect()]


def test_traversal_of_tee(spark):
    kg, at = build(spark, "ABCD", [("A", "B", 1.0), ("B", "C", 1.0), ("A", "D", 0.5)])
    depth = {r["entity_id"]: r["depth"] for r in kg.bfs(at["A"], Direction.OUTGOING, 2).collect()}
    assert depth == {at["A"]: 0, at["B"]: 1, at["D"]: 1, at["C"]: 2}
    walk = kg.dfs(at["A"]).orderBy("position").collect()
    assert walk[0]["entity_id"] == at["A"] and len(walk) == 4
    assert kg.shortest_path(at["A"], at["C"]).count() == 2
    assert kg.shortest_path(at["D"], at["A"]).count() == 0
    assert kg.shortest_path(at["A"], at["A"]).count() == 0
    s = kg.stats().first()
    assert (s["total_entities"], s["total_relations"], s["max_degree"]) == (4, 3, 2)
    assert sorted(names(kg, kg.find_related(at["A"], 0.7))) == ["B"]
    assert sorted(names(kg, kg.get_neighbors(at["C"], 2))) == ["A", "B"]
    assert kg.get_neighbors(at["C"], 0).count() == 0
    with pytest.raises(schema.InvalidDepth):
        kg.get_neighbors(at["A"], 6)
    with pytest.raises(schema.EntityNotFound):
        kg.get_neighbors(999, 1)


def test_a_weak_first_edge_hides_a_strong_parallel_one(spark):
    kg, at = build(spark, "AB", [("A", "B", 0.1), ("A", "B", 0.9)])
    assert kg.find_related(at["A"], 0.5).count() == 0


def test_pagerank_and_components(spark):
    kg, at = build(spark, ["1", "2", "3", "4"], [("1", "2", 1.0), ("2", "3", 1.0), ("1", "3", 1.0)])
    rows = kg.pagerank().collect()
    assert len(rows) == 3 and rows[0]["entity_id"] == at["3"]
    assert abs(sum(r["score"] for r in rows) - 1) < 1e-6
    sizes = [r["size"] for r in algo.component_sizes(kg.connected_components()).collect()]
    assert sizes == [3, 1]


def test_components_equal_on_one_task_and_by_levels(spark):
    """Paths in either order of ids, a ring, a star around its largest id and isolated nodes, by levels alone and on one task, in few jobs."""
    r = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(k + 1, k) for k in range(50, 90)] + [(100 + k, 100 + (k * 7 + 3) % 30) for k in range(30)] + [(199, k) for k in range(150, 199)]
    links += [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    entities = spark.range(320)
    relations = spark.createDataFrame(links, "source_id long, target_id long")
    root = list(range(320))
    for _ in range(320):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    want = dict(enumerate(root))
    spark.sparkContext.setJobGroup("one task", "")
    assert {x[0]: x[1] for x in algo.weak_components(entities, relations).collect()} == want
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one task")) <= 8  # a round was several jobs
    spark.sparkContext.setJobGroup("levels", "")
    assert {x[0]: x[1] for x in algo.weak_components(entities, relations, whole=90).collect()} == want


def test_pagerank_and_strong_components_in_few_jobs(spark):
    """Layers into a ring and a dead end: on joined turns, by layers, and on one task; the turns were a job or more each."""
    r = random.Random(4)
    links = [(k, 100 + r.randrange(30)) for k in range(100) for _ in range(3)] + [(100 + k, 200 + k % 9) for k in range(30)] + [(200 + k, 300 + (k * 2 + 1) % 9) for k in range(9)]
    links += [(300 + k, 300 + (k * 7 + 3) % 12) for k in range(12)] + [(204, 400), (204, 400), (0, 400)]
    relations = spark.createDataFrame(links, "source_id long, target_id long")
    nodes = sorted({x for e in links for x in e})
    for iterations, tolerance in ((10, None), (100, 1e-6), (2, None)):
        score = dict.fromkeys(nodes, 1 / len(nodes))
        for _ in range(iterations):
            got = dict.fromkeys(nodes, 0.0)
            for a, b in links:
                got[b] += score[a] / sum(x == a for x, _ in links)
            left = (1 - sum(got.values())) / len(nodes)
            new = {x: 0.15 / len(nodes) + 0.85 * (got[x] + left) for x in nodes}
            change = sum(abs(new[x] - score[x]) for x in nodes)
            score = new
            if tolerance and change < tolerance:
                break
        for whole in ([1000, 60] if tolerance else [1000, 60, 0]):
            spark.sparkContext.setJobGroup(f"pagerank {iterations} {whole}", "")
            found = {x[0]: x[1] for x in algo.pagerank(relations, iterations=iterations, tolerance=tolerance, whole=whole).collect()}
            assert found.keys() == score.keys() and max(abs(found[x] - score[x]) for x in nodes) < 1e-12
            assert not whole or len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"pagerank {iterations} {whole}")) <= 30
    strong = [{x[0]: x[1] for x in algo.strong_components(relations, whole=whole).collect()} for whole in (1000, 60)]
    assert strong[0] == strong[1] and strong[0].keys() == set(nodes) and all(x == c for x, c in strong[0].items() if not 300 <= x < 312)
    assert [strong[0][x] for x in range(300, 312)] == [min(y for y in range(300, 312) if reach(x, y) and reach(y, x)) for x in range(300, 312)]


def reach(a, b):
    for _ in range(13):
        if a == b:
            return True
        a = 300 + ((a - 300) * 7 + 3) % 12
    return False


def test_strong_components(spark):
    kg, at = build(spark, "ABCDEFG", [("A", "B", 1.0), ("B", "C", 1.0), ("C", "A", 1.0), ("C", "D", 1.0), ("D", "E", 1.0), ("E", "D", 1.0), ("E", "F", 1.0)])
    rows = {r["entity_id"]: r["component"] for r in kg.strongly_connected_components().collect()}
    assert rows == {at["A"]: at["A"], at["B"]: at["A"], at["C"]: at["A"], at["D"]: at["D"], at["E"]: at["D"], at["F"]: at["F"]}
    assert {r["entity_id"]: r["component"] for r in algo.strong_components(kg.relations, max_exact=0).collect()} == rows


def test_louvain_stays_inside_components(spark):
    links = [("1", "2", 1.0), ("2", "3", 1.0), ("1", "3", 1.0), ("4", "5", 1.0), ("5", "6", 1.0), ("4", "6", 1.0), ("3", "4", 0.1)]
    kg, at = build(spark, [*"1234567"], links)
    groups = {r["entity_id"]: r["community"] for r in kg.louvain().collect()}
    assert len(groups) == 7 and len({groups[at[k]] for k in "123456"}) <= 2 and groups[at["7"]] == at["7"]
    row = algo.modularity(kg.relations, kg.louvain()).first()
    assert 0.9 < row["intra_weight_fraction"] <= 1
    spread = {r["entity_id"]: r["community"] for r in algo.louvain(kg.entities, kg.relations, max_exact=0).collect()}
    assert len(spread) == 7 and spread[at["7"]] == at["7"]


def test_louvain_is_whole_on_both_paths(spark):
    r = random.Random(2)
    ends = [(b * 10 + i, b * 10 + j) for b in range(8) for i in range(10) for j in range(10) if i != j and r.random() < 0.5]
    ends += [(r.randrange(40), r.randrange(40)) for _ in range(25)] + [(r.randrange(40, 80), r.randrange(40, 80)) for _ in range(25)]
    links = [(a, b, round(r.uniform(0.2, 1), 3)) for a, b in sorted(set(ends)) if a != b]  # two components of four blocks
    kg, at = build(spark, [str(k) for k in range(80)], [(str(a), str(b), w) for a, b, w in links])
    whole = algo._louvain([(at[str(a)], at[str(b)], w) for a, b, w in links], sum(w for *_, w in links))
    smallest = {c: min(n for n in whole if whole[n] == c) for c in whole.values()}
    exact = kg.louvain().cache()
    assert {x["entity_id"]: x["community"] for x in exact.collect()} == {n: smallest[c] for n, c in whole.items()}
    q = lambda membership: algo.modularity(kg.relations, membership).first()["modularity"]
    spread = algo.louvain(kg.entities, kg.relations, max_exact=0).cache()
    assert q(spread) > q(exact) - 0.02


def test_bowtie_hypergraph(spark):
    kg, at = build(spark, [*"01234"])
    kg.insert_hyperedge([at["0"], at["1"], at["2"]], "team", 0.9)
    kg.insert_hyperedge([at["2"], at["3"], at["4"]], "team", 0.8)
    assert sorted(names(kg, kg.get_higher_order_neighbors(at["0"]))) == ["1", "2"]
    assert sorted(names(kg, kg.higher_order_bfs(at["0"], 2))) == ["1", "2", "3", "4"]
    assert kg.higher_order_shortest_path(at["0"], at["4"], 5).count() == 2
    ranks = {r["entity_id"]: r["score"] for r in kg.hypergraph_entity_pagerank(iterations=30).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and max(ranks, key=ranks.get) == at["2"]
    with pytest.raises(schema.InvalidArity):
        kg.insert_hyperedge([at["0"]], "team")
    with pytest.raises(schema.InvalidInput):
        kg.insert_hyperedge([at["0"], at["0"]], "team")
    kg.delete_entity(at["4"])
    assert {len(r["entity_ids"]) for r in kg.hyperedges.collect()} == {3, 2}


def test_crud_and_cascade(spark):
    kg, at = build(spark, "AB", [("A", "B", 0.5)])
    kg.insert_vector(at["A"], [1.0, 0.0])
    with pytest.raises(schema.InvalidVectorDimension):
        kg.insert_vector(at["B"], [1.0])
    with pytest.raises(schema.InvalidWeight):
        kg.insert_relation(at["A"], at["B"], "r", 1.5)
    with pytest.raises(schema.EntityNotFound):
        kg.insert_relation(at["A"], 77, "r")
    kg.update_entity(at["A"], "m", "A2", {"k": 1})
    assert kg.get_entity(at["A"])["name"] == "A2"
    kg.delete_entity(at["A"])
    assert (kg.entities.count(), kg.relations.count(), kg.vectors.count()) == (1, 0, 0)
    assert kg.insert_entity("n", "C") == 3  # ids are not reused
    with pytest.raises(ValueError):
        with kg.transaction():
            kg.delete_entity(at["B"])
            raise ValueError
    assert kg.entities.count() == 2


def test_save_and_open(spark, tmp_path):
    kg, at = build(spark, "AB", [("A", "B", 0.5)])
    kg.save(str(tmp_path / "g"))
    kg.delete_entity(at["A"])
    kg.save(str(tmp_path / "g"))
    back = KnowledgeGraph.open(spark, str(tmp_path / "g"))
    assert back.entities.count() == 1 and back.next_id["kg_entities"] == 3
    assert back.sql("SELECT name FROM kg_entities WHERE name ILIKE 'b%'").first()["name"] == "B"
    assert KnowledgeGraph.schema_version(spark, str(tmp_path / "g")) == schema.SCHEMA_VERSION and not KnowledgeGraph.exists(spark, str(tmp_path / "none"))


def test_a_crash_while_saving_leaves_the_last_generation(spark, tmp_path, monkeypatch):
    from graphloom import store

    kg, at = build(spark, "AB", [("A", "B", 0.5)])
    kg.insert_entity("", "nameless kind")
    kg.save(str(tmp_path / "g"))
    kg.delete_entity(at["A"])
    real = store._write
    for crash in ("_state.json", "_done"):

        def write(session, path, text, crash=crash):
            if crash in path:
                raise KeyboardInterrupt
            real(session, path, text)

        monkeypatch.setattr(store, "_write", write)
        with pytest.raises(KeyboardInterrupt):
            kg.save(str(tmp_path / "g"))
        back = KnowledgeGraph.open(spark, str(tmp_path / "g"))
        assert back.entities.count() == 3 and back.relations.count() == 1 and back.entities.where("entity_type = ''").count() == 1


def test_a_table_that_always_changes_in_turn_is_cut(spark):
    kg, at = build(spark, "AB")
    for k in range(12):
        kg.insert_entity("n", f"x{k}")
        kg.insert_relation(at["A"], at["B"], "r")
        assert len(kg.relations._jdf.queryExecution().logical().toString()) < 12_000
    assert kg.relations.count() == 12 and kg.entities.count() == 14


def test_keys_beyond_the_old_stride_stay_apart(spark, tmp_path):
    from graphloom.sources.mapping import gid, rel_id

    keys = spark.createDataFrame([(0,), (10_000_000,), (10**8 + 7,), (2**48 - 2,)], "k long")
    ids = [r[0] for kind in ("order", "item", "user") for r in keys.select(gid(kind, "k")).collect()]
    assert len(set(ids)) == 12 and max(ids) < 2**53
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(2**48,)], "k long").select(gid("order", "k")).collect()
    with pytest.raises(Exception, match="out of range"):
        keys.select(rel_id("contains", F.col("k") - 1)).collect()


def test_small_calls(spark):
    kg, at = build(spark, "ABC", [("A", "B", 0.5)])
    kg.set_property(at["A"], "k", [1], now=5)
    assert kg.get_property(at["A"], "k") == [1] and kg.get_property(at["A"], "z") is None
    assert {r["id"] for r in kg.get_entities_by_ids([at["A"], at["C"], 99]).collect()} == {at["A"], at["C"]}
    kg.insert_vectors([(at["A"], [1.0, 0.0]), (at["B"], [0.0, 1.0])])
    assert kg.get_vector(at["A"]) == [1.0, 0.0]
    h = kg.insert_hyperedge([at["A"], at["B"]], "t", now=1)
    kg.update_hyperedge(h, [at["C"], at["B"]], "u", 0.5, now=9)
    row = kg.get_hyperedge(h)
    assert (row["entity_ids"], row["hyperedge_type"], row["updated_at"]) == ([at["C"], at["B"]], "u", 9)
    from graphloom.operators import hyper

    assert kg.hyperedges.where(hyper.contains(at["C"])).select(hyper.entity_set().alias("s")).first()["s"] == sorted([at["B"], at["C"]])
    kg.delete_hyperedge(h)
    with pytest.raises(schema.HyperedgeNotFound):
        kg.get_hyperedge(h)
    kg.add_dependency(at["B"], at["A"])
    assert [r["entity_id"] for r in kg.dependents_of(at["A"]).collect()] == [at["B"]]
    v = kg.ensure_version("v")
    assert kg.ensure_version("v") == v and kg.get_version(v)["name"] == "v"
    with pytest.raises(schema.EntityNotFound):
        kg.higher_order_bfs(99, 2)


def test_sql_functions(spark):
    import json

    kg, at = build(spark, "ABC", [("A", "B", 0.5), ("B", "C", 0.5)])
    one = lambda text: kg.sql(text).first()[0]
    assert json.loads(one("SELECT kg_stats()")) == {"total_entities": 3, "total_relations": 2, "avg_degree": 1.333333, "max_degree": 1, "density": 0.333333333}
    assert json.loads(one("SELECT kg_pagerank()")) == {"algorithm": "pagerank", "damping": 0.85, "max_iterations": 100, "tolerance": 1e-6, "rows": "kg_pagerank_result"}
    assert json.loads(one("SELECT kg_bfs(7)"))["max_depth"] == 3 and json.loads(one("SELECT kg_shortest_path(1, 2, 4)"))["max_depth"] == 4
    assert one("SELECT kg_version()") and json.loads(one("SELECT kg_louvain()"))["algorithm"] == "louvain" and one("SELECT kg_connected_components()")
    kg.publish("bfs", at["A"])
    assert one("SELECT count(*) FROM kg_bfs_result") == 3
    kg.publish("shortest_path", at["A"], at["C"])
    assert one("SELECT max(step) FROM kg_shortest_path_result") == 2
    assert one(f"SELECT e.name FROM kg_bfs_result b JOIN kg_entities e ON e.id = b.entity_id WHERE depth = 2") == "C"


def test_indexes(spark, tmp_path):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "entity_id long, vector array<float>")
    index = quantized.QuantizedIndex(8, 4).build(v.where("entity_id < 40")).add(v.where("entity_id >= 30"))
    same = lambda a, b: [tuple(r) for r in a.search(x[3].tolist(), 5).collect()] == [tuple(r) for r in b.search(x[3].tolist(), 5).collect()]
    assert len(index) == 60 and same(index, quantized.QuantizedIndex(8, 4).build(v))
    assert same(index, quantized.QuantizedIndex.from_bytes(spark, index.to_bytes()))
    index.save(str(tmp_path / "i"))
    assert same(index, quantized.QuantizedIndex.load(spark, str(tmp_path / "i")))
    both = index.search_batch([x[3].tolist(), x[9].tolist()], 5)
    assert [tuple(r)[1:] for r in both.where("query = 0").orderBy("similarity", ascending=False).collect()][0][0] == 3 and both.count() == 10
    assert len(index.remove([3, 4])) == 58 and len(index.clear()) == 0
    line = quantized.LinearScanIndex(spark, 8).add(v)
    assert line.search(x[3].tolist(), 1).first()["entity_id"] == 3 and len(line) == 60 and line.stats().first()["vector_bytes"] == 60 * 32
    with pytest.raises(schema.InvalidVectorDimension):
        line.search([1.0], 1)
    assert len(line.clear()) == 0


def test_command_line_and_kept_index(spark, tmp_path, capsys):
    from graphloom import cli
    from graphloom.sources import imports

    (tmp_path / "skills" / "s1").mkdir(parents=True)
    (tmp_path / "skills" / "s1" / "SKILL.md").write_text("# s1\n\nfast graph search\n")
    rows = [("a1", "graph search", '["machine", "learning"]', 1.5, "s1"), ("a2", "vision", '["machine", "vision"]', 0.5, None)]
    table = spark.createDataFrame(rows, "arxiv_id string, title string, keywords string, utility double, skill_created string")
    for c in ("file_path", "last_accessed", "created_at", "notes"):
        table = table.selectExpr("*", f"cast(null as string) {c}")
    table.write.parquet(str(tmp_path / "papers"))
    program = tmp_path / "embed.py"
    program.write_text("import json, sys\nfor line in sys.stdin:\n    t = json.loads(line)\n    print(json.dumps([float(len(t)), float(t.count('a')) + 0.5]))\n")
    import sys as system

    embedder, db = f"{system.executable} {program}", str(tmp_path / "kg")
    assert cli.run(["migrate", "--source", str(tmp_path / "papers"), "--skills", str(tmp_path / "skills"), "--target", db], spark) == 0
    assert "papers\t2" in capsys.readouterr().out
    assert cli.run(["--db", db, "embed", "--all", "--dimension", "2", "--embedder", embedder], spark) == 0
    assert "processed\t3" in capsys.readouterr().out
    assert cli.run(["search", "graph search", "--k", "2", "--db", db, "--embedder", embedder], spark) == 0
    assert "graph search" in capsys.readouterr().out
    for argv in (["stats"], ["context", "1", "--depth", "1"], ["find-related", "1", "--threshold", "0.1"], ["similar", "1", "--k", "1"]):
        assert cli.run([*argv, "--db", db], spark) == 0
    out = capsys.readouterr().out
    assert "paper\t2" in out and "derived_from" in out and "total_entities" in out
    assert cli.run(["stats", "--db", str(tmp_path / "none")], spark) == 1
    kg = KnowledgeGraph.open(spark, db)
    assert kg.index() is kg.index() and kg.rag("vision", imports.FixedEmbedder([1.0, 0.0]), 2).count() == 2
    assert not imports.check_dependencies([system.executable, "-c", "raise SystemExit(3)"])


def test_old_tables_are_brought_up_to_date(spark):
    old = spark.createDataFrame([(1, 2, 3, "r", bytearray(b"\x00\x00\x00\x00\x00\x00\xe8?"))], "id long, source_id long, target_id long, rel_type string, weight binary")
    row = schema.conform(old, "kg_relations").first()
    assert row["weight"] == 0.75 and row["validity"] is None and row["confidence"] == 1.0
    null = spark.createDataFrame([(1, None)], "id long, weight double")
    assert schema.conform(null, "kg_relations").first()["weight"] == 1.0


def test_vectors_and_quantized_recall(spark):
    import numpy as np

    kg, at = build(spark, "ABC")
    kg.insert_vectors([(at["A"], [1, 0, 0, 0]), (at["B"], [0.9, 0.1, 0, 0]), (at["C"], [0, 0, 1, 0])])
    assert names(kg, kg.similar_entities(at["A"], 2)) == ["B", "C"]
    assert names(kg, kg.search_vectors([1, 0, 0, 0], 1)) == ["A"]
    assert kg.search_vectors([1, 0, 0, 0], 0).count() == 0
    with pytest.raises(schema.EntityNotFound):
        kg.similar_entities(99, 1)
    x = np.random.default_rng(1).normal(size=(400, 32))
    v = spark.createDataFrame([(i, [float(t) for t in r]) for i, r in enumerate(x)], "entity_id long, vector array<float>")
    true = x @ x[:20].T / np.linalg.norm(x, axis=1)[:, None]
    got = []
    for bits in (1, 2, 4):
        index = quantized.QuantizedIndex(32, bits).build(v)
        found = index.search_batch([r.tolist() for r in x[:20]], 10).collect()
        hits = sum(r["entity_id"] in set(np.argsort(-true[:, r["query"]])[:10].tolist()) for r in found)
        got.append(hits / 200)
    assert got[0] < got[1] < got[2] and got[2] > 0.7
    with pytest.raises(schema.InvalidInput):
        quantized.QuantizedIndex(4, 9)


def test_confidence_and_ripple(spark):
    kg, at = build(spark, "ABCD")
    for a, b in ("BA", "CB", "DC"):
        kg.add_dependency(at[a], at[b])
    rows = {r["entity_id"]: r["penalty"] for r in confidence.ripple(kg.dependencies, at["A"], 0.4).collect()}
    assert rows == {at["B"]: 0.2, at["C"]: 0.1}
    kg.propagate_ripple(at["A"], 0.4, now=100)
    by = {r["id"]: r["confidence"] for r in kg.entities.collect()}
    assert abs(by[at["B"]] - 0.8) < 1e-12 and abs(by[at["C"]] - 0.9) < 1e-12 and by[at["D"]] == 1.0
    assert kg.log.where("reason = 'ripple'").count() == 2
    base = kg.get_confidence(at["D"], now=100)
    assert kg.update_confidence(at["D"], -5.0, now=100) == pytest.approx(base - 1)
    kg.record_access([at["D"]], now=100)
    assert kg.get_entity(at["D"])["access_count"] == 1


def test_versions(spark):
    kg, at = build(spark, "ABC")
    v1, v2 = kg.create_version("v1", now=1), kg.create_version("v2", now=2)
    kg.version_add(v1, [at["A"], at["B"]])
    kg.version_add(v2, [at["B"], at["C"]])
    change = {r["id"]: r["change"] for r in kg.version_compare(v1, v2)[0].collect()}
    assert change == {at["A"]: "removed", at["B"]: "common", at["C"]: "added"}
    u = kg.version_merge([v1, v2], "u", versioning.MergeStrategy.UNION, now=3)
    i = kg.version_merge([v1, v2], "i", versioning.MergeStrategy.INTERSECTION, now=4)
    assert kg.version_entities(u).count() == 3 and kg.version_entities(i).count() == 1
    assert [r["name"] for r in kg.version_entity_history(at["A"]).collect()] == ["u", "v1"]
    with pytest.raises(schema.DuplicateVersionName):
        kg.create_version("v1")
    kg.delete_version(v1)
    assert kg.get_entity(at["A"])["validity"] == versioning.bit(2)
    assert versioning.bit(63) == -(1 << 63)
    with pytest.raises(schema.CorruptBitSlot):
        versioning.bit(64)
    with pytest.raises(schema.InvalidMerge):
        kg.version_merge([v2], "x", versioning.MergeStrategy.UNION)


def test_slots_run_out(spark):
    full = spark.createDataFrame([(k, f"v{k}", "main", None, None, k, False, k) for k in range(64)], "id long, name string, branch string, parent_id long, description string, created_at long, is_merged boolean, bit_slot int")
    with pytest.raises(schema.VersionLimitExceeded):
        versioning.free_slot(full)
    assert versioning.free_slot(full.where("id <> 63")) == 63


def test_relations_from_papers_and_skills(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "SKILL.md").write_text("# s1\n\n fast graph search \n")
    (tmp_path / "s2").mkdir()
    (tmp_path / "s2" / "SKILL.md").write_text("# s2\nfast graph walk")
    rows = [("a1", "T1", '["machine", "learning"]', 1.5, "s1"), ("a2", "T2", '["machine", "vision"]', None, None), ("a3", "T3", None, 2.0, None)]
    table = spark.createDataFrame(rows, "arxiv_id string, title string, keywords string, utility double, skill_created string")
    for c in ("file_path", "last_accessed", "created_at", "notes"):
        table = table.selectExpr("*", f"cast(null as string) {c}")
    kg = KnowledgeGraph.in_memory(spark)
    assert kg.migrate_papers(table) == 3 and kg.migrate_skills(str(tmp_path)) == 2
    assert kg.build_relationships() == 3
    weights = {r["rel_type"]: r["weight"] for r in kg.relations.collect()}
    assert weights["derived_from"] == 1.0 and weights["related_by_keywords"] == pytest.approx(1 / 3) and weights["similar_to"] == 0.5
    assert kg.embed_missing(lambda texts: [[0.1] * 384 for _ in texts]) == 5
    assert kg.embed_missing(lambda texts: [[0.1] * 384 for _ in texts]) == 0


def test_jaccard_pairs_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    sets = {i: {r.choice("abcdefghij") for _ in range(r.randint(0, 6))} for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, tokens array<string>")
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) > 0.3}
    got = relate.jaccard_pairs(df, 0.3).collect()
    assert {(x["a"], x["b"]) for x in got} == want and len(got) == len(want)


def test_exports(spark, tmp_path):
    kg, at = build(spark, ['q"x', "B", "C"], [('q"x', "B", 0.8), ("B", "C", 1.0)])
    dot = kg.export_dot(export.DotConfig(max_nodes=2))
    assert 'label="q\\"x"' in dot and "weight=0.8000" in dot and dot.count("->") == 1
    meta = kg.export_d3(str(tmp_path / "d3"), now=0)
    assert meta == {"node_count": 3, "link_count": 2, "exported_at": "1970-01-01T00:00:00Z"}
    assert export.d3_nodes(kg.entities).where("id = 2").first()["json"] == '{"id":2,"name":"B","type":"n","properties":{}}'


def test_smart_search_and_rag(spark):
    kg, at = build(spark, ["e1", "e2", "e3"], [("e1", "e2", 0.3), ("e1", "e3", 0.9)])
    kg.insert_vectors([(at["e1"], [1, 0, 0, 0]), (at["e2"], [0, 1, 0, 0]), (at["e3"], [0.8, 0.6, 0, 0])])
    top = kg.rag_search([1, 0, 0, 0], 2).collect()
    assert top[0]["entity_id"] == at["e1"] and top[0]["vector_score"] == 1.0 and top[0]["context"]
    for a in ("e1", "e3"):
        kg.add_dependency(at[a], at["e2"])
    from graphloom.operators.retrieval import Weights

    kg.weights = Weights(0.0, 0.0, 1.0, 0.0)
    assert kg.smart_search([1, 0, 0, 0], 1, now=100).first()["entity_id"] == at["e2"]


def test_streaming_counts(spark, tmp_path):
    from graphloom import streaming

    rows = [("2024-01-01 00:10:00", 1, "view"), ("2024-01-01 00:20:00", 1, "click"), ("2024-01-01 00:30:00", 1, "error"), ("2024-01-02 00:00:00", 2, "view")]
    spark.createDataFrame(rows, "ts string, user_id long, event_type string").selectExpr("cast(ts as timestamp) ts", "user_id", "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "in"))
    q = streaming.access_counts(stream).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["user_id"], r["accesses"]) for r in spark.table("hits").collect()} == {(1, 2), (2, 1)}


SMALLEST = "/root/testdata/sf0.001"


def test_walks_compute_only_what_they_reach(spark):
    """The graph is not kept whole for a walk, and a few nodes are looked up before links are aggregated."""
    from pyspark.sql import functions as F

    from graphloom.plans import registry
    from graphloom.runtime import near

    s = registry.source(spark, SMALLEST)
    s._seen.clear()
    for name in ("context", "find_related", "version_neighbors", "ripple", "ripple_log"):
        assert registry.QUERIES[name](spark, SMALLEST).count()
        assert not s._seen, name
    few = spark.range(1).select(F.lit(registry.ORDER).alias("source_id"))
    plan = s.relations("contains", "placed_by").join(near(few, 1), "source_id", "left_semi")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


def test_hyperedges_of_a_walk_are_computed_once(spark):
    from pyspark.sql import functions as F

    from graphloom.operators import hyper
    from graphloom.plans import registry

    edges = hyper.kept(registry.source(spark, SMALLEST).hyperedges())
    assert hyper.kept(edges) is edges
    path = hyper.path(edges, registry.CUSTOMER, hyper.bfs(edges, registry.CUSTOMER, 2).where("depth = 2").agg(F.max("entity_id")).first()[0], 3)
    assert path.count() == 2


def test_hypergraph_pagerank_by_blocks_equals_brute_force(spark):
    """Members over several blocks of hyperedges; an edge's members and an entity's edges lie in different ones."""
    from graphloom.operators import hyper

    r = random.Random(5)
    edges = [(k, sorted(r.sample(range(12), a)), round(r.uniform(0.1, 1), 3), a) for k in range(20) for a in [r.randrange(2, 5)]]
    table = spark.createDataFrame(edges, "id long, entity_ids array<long>, weight double, arity int")
    nodes = sorted({x for e in edges for x in e[1]})
    degree = {x: sum(x in e[1] for e in edges) for x in nodes}
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(2):
        new = {x: 0.15 / len(nodes) + sum(0.85 * w / k**2 * score[y] / degree[y] for _, m, w, k in edges if x in m for y in m if y != x) for x in nodes}
        score = {x: v / sum(new.values()) for x, v in new.items()}
    found = {x[0]: x[1] for x in hyper.pagerank(table, iterations=2, block=20).collect()}
    assert found.keys() == score.keys() and max(abs(found[x] - score[x]) for x in nodes) < 1e-12


def test_louvain_contracts_single_links_and_analyze_takes_its_components(spark):
    r = random.Random(5)
    ends = [(b * 10 + i, b * 10 + j) for b in range(3) for i in range(10) for j in range(10) if i != j and r.random() < 0.5] + [(0, 10), (11, 20), (21, 1)]
    ends += [(40 + k, r.randrange(30)) for k in range(20)] + [(60 + k, 40 + k) for k in range(20)]  # nodes with one link each, two in a row
    ends += [(90 + k, 90 + (k + 1) % 5) for k in range(5)]  # a small component
    links = [(str(a), str(b), 1.0) for a, b in sorted(set(ends))]
    kg, at = build(spark, [str(k) for k in range(100)], links)
    got = {x["entity_id"]: x["community"] for x in algo.louvain(kg.entities, kg.relations, max_exact=10, whole=170).collect()}
    assert len(got) == 100 and all(got[at[str(60 + k)]] == got[at[str(40 + k)]] for k in range(20))
    assert len({got[at[str(k)]] for k in range(90, 95)}) == 1 and got[at["35"]] == at["35"]
    row = algo.analyze(kg.entities, kg.relations, max_exact=10, whole=170).first()
    assert (row["num_components"], row["largest_component"], row["num_communities"]) == (27, 70, len(set(got.values())))
