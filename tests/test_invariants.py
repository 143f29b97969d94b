"""Small fixtures against brute force, and properties of iterative operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.operators import density, gated, graph, kge, learn, linkpred, metrics, neighbors, ordering, sampling, stacking, vectors
from knotwork.operators import triples as triple_ops
from knotwork.operators.patterns import bgp_match
from knotwork.operators.skew import salted_join
from knotwork.sources import rdf, rdfxml, tables

rng = np.random.default_rng(7)


def points_frame(spark, values, keys=None):
    keys = range(len(values)) if keys is None else keys
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(keys, values)], "key long, vec array<double>")


def blobs(count=40, seed=1):
    local = np.random.default_rng(seed)
    return np.concatenate([local.normal(size=(count, 3)) * 0.2 + centre for centre in ([0, 0, 0], [6, 0, 0], [0, 6, 0])])


def brute_knn(values, queries, k, itself):
    out = {}
    for i, q in enumerate(queries):
        away = [(round(float(np.sqrt(((q - v) ** 2).sum())), 9), j) for j, v in enumerate(values) if not (itself and i == j)]
        out[i] = [j for _, j in sorted(away)[:k]]
    return out


@pytest.mark.parametrize("block_rows", [16384, 40, 7])
def test_knn_equals_brute_force(spark, block_rows):
    values = np.concatenate([blobs(30), np.zeros((9, 3)), rng.normal(size=(20, 3))])
    rows = neighbors.knn(points_frame(spark, values), 5, block_rows=block_rows).collect()
    found = {}
    for row in sorted(rows, key=lambda r: (r["src"], r["place"])):
        found.setdefault(row["src"], []).append(row["dst"])
    assert found == brute_knn(values, values, 5, True)


@pytest.mark.parametrize("block_rows", [16384, 20])
def test_knn_with_many_copies(spark, block_rows):
    values = np.concatenate([np.zeros((30, 3)), blobs(10), np.ones((25, 3)), rng.normal(size=(9, 3))])
    rows = neighbors.knn(points_frame(spark, values), 4, block_rows=block_rows, copy_limit=8).collect()
    found = {i: [r["dst"] for r in sorted(rows, key=lambda r: r["place"]) if r["src"] == i] for i in range(len(values))}
    assert found == brute_knn(values, values, 4, True)


def test_knn_of_other_rows(spark):
    values, asked = rng.normal(size=(60, 4)), rng.normal(size=(11, 4))
    rows = neighbors.knn(points_frame(spark, values), 3, points_frame(spark, asked), include_self=True, block_rows=16).collect()
    found = {i: [r["dst"] for r in sorted(rows, key=lambda r: r["place"]) if r["src"] == i] for i in range(11)}
    assert found == brute_knn(values, asked, 3, False)


def test_prefix_sums_and_quantiles(spark):
    values = [float(x) for x in rng.integers(0, 50, 300)]
    frame = spark.createDataFrame([("a" if i % 3 else "b", v) for i, v in enumerate(values)], "g string, v double")
    rows = ordering.grouped_quantiles(frame, ["g"], "v", {"q": 1 / 3, "m": 0.5}).collect()
    for row in rows:
        part = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == row["g"]]
        assert row["q"] == pytest.approx(np.quantile(part, 1 / 3)) and row["m"] == pytest.approx(np.median(part))
        assert row["n"] == len(part)


def test_dense_ids_are_in_label_order(spark):
    labels = [f"n{rng.integers(1000)}" for _ in range(400)]
    rows = ordering.dense_ids(spark.createDataFrame([(x,) for x in labels], "x string"), "x").collect()
    assert {r["label"]: r["id"] for r in rows} == {x: i for i, x in enumerate(sorted(set(labels)))}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_salted_join_equals_join(spark, how):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(200)], "k int, a int")
    right = spark.createDataFrame([(i, -i) for i in range(0, 100, 2)], "k int, b int")
    plain = sorted(map(tuple, left.join(right, "k", how).collect()), key=str)
    assert sorted(map(tuple, salted_join(left, right, ["k"], how, hot_rows=10, salts=4).collect()), key=str) == plain


def brute_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    return sum(pairs) / len(pairs)


def test_auc_equals_pairs(spark):
    y, s = rng.integers(0, 2, 120), rng.integers(0, 15, 120) / 10
    frame = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")
    assert metrics.roc_auc(frame).first()[0] == pytest.approx(brute_auc(y, s))
    one = frame.filter("y = 1")
    assert metrics.roc_auc(one).first()[0] is None


def test_metrics_without_positives(spark):
    frame = spark.createDataFrame([(0, 0), (1, 0)], "y int, prediction int")
    row = metrics.binary_metrics(frame).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 140)] + [(200, 201)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(999,)], "key long")
    found = {r["key"]: r["component"] for r in graph.connected_components(frame, nodes, hot_rows=5).collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[x] == 100 for x in range(100, 140))
    assert found[201] == 200 and found[999] == 999


def test_forest_weight_equals_kruskal(spark):
    edges = {tuple(sorted((int(a), int(b)))): float(w) for a, b, w in zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 9, 150)) if a != b}
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight double")
    parent = list(range(40))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    total, count = 0.0, 0
    for (a, b), w in sorted(edges.items(), key=lambda e: e[1]):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            total, count = total + w, count + 1
    rows = graph.minimum_spanning_forest(frame, hot_rows=10).collect()
    assert len(rows) == count and sum(r["weight"] for r in rows) == pytest.approx(total)


def gain_of_any_move(edges, labels):
    """The greatest modularity gain of moving one node to a neighbour's community, by plain sums."""
    degree, total, links = {}, {}, {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            degree[x] = degree.get(x, 0.0) + w
            links.setdefault(x, {}).setdefault(labels[y], 0.0)
            links[x][labels[y]] += w
    for x, d in degree.items():
        total[labels[x]] = total.get(labels[x], 0.0) + d
    both = sum(degree.values())
    best = 0.0
    for x, around in links.items():
        stay = around.get(labels[x], 0.0) - degree[x] * (total[labels[x]] - degree[x]) / both
        best = max([best] + [w - degree[x] * total[c] / both - stay for c, w in around.items() if c != labels[x]])
    return best


@pytest.mark.parametrize("task_edges", [10**6, 0])
def test_no_node_of_a_settled_level_gains_by_a_move(spark, task_edges):
    local = np.random.default_rng(8)
    pairs = {tuple(sorted((int(a), int(b)))) for a, b in zip(local.integers(0, 30, 90), local.integers(0, 30, 90)) if a != b}
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    labels, moved = graph._settled_labels(graph.both_ways(frame).cache(), 1.0, 42, 10**6, task_edges)
    assert moved
    assert gain_of_any_move([(a, b, 1.0) for a, b in pairs], dict(map(tuple, labels.collect()))) < 1e-8


def test_communities_of_three_blobs(spark):
    edges = neighbors.knn_graph(points_frame(spark, blobs()), 8).cache()
    found = graph.communities(edges).cache()
    labels = {r["key"]: r["community"] for r in found.collect()}
    assert len(labels) == 120
    for start in (0, 40, 80):
        other = {labels[i] for i in range(120) if not start <= i < start + 40}
        assert not other & {labels[i] for i in range(start, start + 40)}
    quality = graph.modularity(edges, found.select("key", F.col("community").alias("label"))).first()[0]
    spread = graph.label_propagation(edges, 5)
    assert quality >= graph.modularity(edges, spread).first()[0] - 1e-9
    assert 0 < quality < 1


def test_density_clusters_and_assignment(spark):
    values = np.concatenate([blobs(), [[30, 30, 30], [-30, 30, 0]]])
    model = density.fit_density(points_frame(spark, values), min_cluster_size=10, min_samples=5)
    rows = {r["key"]: r for r in model.members.collect()}
    kept = {r["cluster"] for r in rows.values() if r["cluster"] >= 0}
    assert len(kept) == 3 and rows[120]["cluster"] == -1 and rows[121]["strength"] == 0
    for start in (0, 40, 80):
        inside = [rows[i]["cluster"] for i in range(start, start + 40) if rows[i]["cluster"] >= 0]
        assert len(set(inside)) == 1 and len(inside) >= 30
    assert all(0 <= r["strength"] <= 1 for r in rows.values())
    new = points_frame(spark, [[0.01, 0, 0], [6, 0.01, 0], [90, 0, 0]], [500, 501, 502])
    given = {r["key"]: r["cluster"] for r in density.density_assign(model, points_frame(spark, values), new).collect()}
    assert given[500] == rows[0]["cluster"] or given[500] in kept
    assert given[501] in kept and given[501] != given[500] and given[502] == -1


def test_density_of_a_single_point(spark):
    rows = density.density_clusters(points_frame(spark, [[1.0, 2.0]]), min_cluster_size=2).collect()
    assert [(r["cluster"], r["strength"]) for r in rows] == [(-1, 0.0)]


def test_silhouette_sentinel_and_value(spark):
    values = blobs(10)
    frame = points_frame(spark, values).withColumn("cluster", (F.col("key") / 10).cast("int"))
    assert vectors.silhouette(frame).first()[0] > 0.8
    assert vectors.silhouette(frame.withColumn("cluster", F.lit(-1))).first()[0] == -1.0


def test_pca_finds_the_long_axis(spark):
    values = rng.normal(size=(200, 5)) * [5, 1, 1, 1, 1]
    flat, shares = vectors.pca(points_frame(spark, values), 2)
    first = np.array([r["vec"][0] for r in flat.orderBy("key").collect()])
    assert abs(np.corrcoef(first, values[:, 0])[0, 1]) > 0.99 and shares[0] > shares[1]
    assert abs(first.mean()) < 1e-9


def test_fuzzy_weights_sum_to_log_k(spark):
    near = neighbors.knn(points_frame(spark, rng.normal(size=(50, 3))), 8).cache()
    weights = neighbors.fuzzy_knn_weights(near, 8).collect()
    assert all(0 <= r["weight"] <= 1 + 1e-9 for r in weights)
    assert max(r["weight"] for r in weights) == pytest.approx(1.0)


PEOPLE = [(f"http://x#Patient_{i}", "iri", p, o, k) for i in range(12) for p, o, k in (
    ("http://x#age", str(20 + i), "literal"), ("http://x#kind", "1_0" if i % 2 else "1.0f", "literal"), ("http://x#of", f"http://x#Ward_{i % 2}", "iri"))]


def people(spark):
    return spark.createDataFrame(PEOPLE, "subj string, subj_kind string, pred string, obj string, obj_kind string")


def test_literal_strategies(spark):
    frame = people(spark)
    assert triple_ops.choose_strategy(frame) == "categorize"
    levels = {r["subj"]: r["level"] for r in triple_ops.literal_bucket(triple_ops.numeric_literals(frame).filter("relation = 'age'"), triple_ops.literal_thresholds(frame)).collect()}
    assert sorted(levels.values()).count("Low") == 4 and levels["http://x#Patient_11"] == "High"
    out = triple_ops.convert_literals(frame, "categorize", schema_relations=True).collect()
    # 12 ages and 6 readable kinds give six triples each, 6 tokens, 12 links, 7 schema rows.
    assert len(out) == 18 * 6 + 6 + 12 + 7
    assert triple_ops.convert_literals(frame, "drop").count() == 12
    with pytest.raises(ValueError):
        triple_ops.convert_literals(frame, "other")


def test_patterns_must_be_connected(spark):
    with pytest.raises(ValueError):
        bgp_match(people(spark), [("?a", "http://x#age", "?b"), ("?c", "http://x#of", "?d")])
    pairs = bgp_match(people(spark), [("?a", "http://x#of", "?w"), ("?a", "http://x#age", "?n")], hot_rows=3)
    assert pairs.count() == 12


@pytest.mark.parametrize("side", ["tail", "head"])
@pytest.mark.parametrize("model", kge.MODELS)
def test_gradients_match_differences(model, side):
    local = np.random.default_rng(3)
    width = 6 if model in ("complex", "rotate") else 3
    known, end = local.normal(size=(2, 4, width))
    relation = local.normal(size=(4, 3 if model == "rotate" else width))
    drawn = local.normal(size=(5, width))
    weight, own = local.normal(size=(4, 5)), local.normal(size=4)

    def total(known, relation, end, drawn):
        query, _ = kge.queries_and_slopes(model, known, relation, side)
        return (kge.candidate_scores(model, query, drawn)[0] * weight).sum() + (kge.own_scores(model, query, end)[0] * own).sum()

    query, query_back = kge.queries_and_slopes(model, known, relation, side)
    by_query, by_drawn = kge.candidate_scores(model, query, drawn)[1](weight)
    more, by_end = kge.own_scores(model, query, end)[1](own)
    slopes = [*query_back(by_query + more), by_end, by_drawn]
    parts = [known, relation, end, drawn]
    for which, slope in enumerate(slopes):
        for i in np.ndindex(slope.shape):
            up, down = [[x.copy() for x in parts] for _ in range(2)]
            up[which][i] += 1e-6
            down[which][i] -= 1e-6
            assert slope[i] == pytest.approx((total(*up) - total(*down)) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("buckets", [1, 2, 8])
def test_each_round_pairs_disjoint_buckets_and_all_pairs_meet(spark, buckets):
    every = spark.range(buckets).selectExpr("cast(id as int) as a").crossJoin(spark.range(buckets).selectExpr("cast(id as int) as b"))
    met = {(r.a, r.b): r.m for r in every.select("a", "b", kge.meeting(F.col("a"), F.col("b"), buckets).alias("m")).collect()}
    for round_ in range(max(1, buckets - 1)):
        mates = dict(map(tuple, spark.range(buckets).select("id", kge.partner(F.col("id").cast("int"), round_, buckets)).collect()))
        assert all(mates[mates[i]] == i for i in mates) and (buckets == 1 or all(mates[i] != i for i in mates))
        assert all(met[i, mates[i]] == round_ for i in mates)


def ring(spark, nodes=240):
    links = [(i, k, (i * (k + 1) + 7 * k) % nodes) for i in range(nodes) for k in range(4)]
    return spark.createDataFrame(links, "head long, relation long, tail long").distinct()


@pytest.mark.parametrize(("model", "buckets"), [("transe", 8), ("rotate", 1), ("rotate", 2), ("rotate", 8), ("complex", 2)])
def test_losses_fall_with_any_number_of_buckets(spark, model, buckets):
    _, _, losses = kge.train_kge(ring(spark), model, dim=16, epochs=20, batch=32, buckets=buckets, passes=10)
    assert np.mean(losses[:10]) > np.mean(losses[10:]) and losses[-1] < 0.75 * losses[0]


def test_state_files_of_a_training_go_with_its_rounds(spark):
    from pathlib import Path

    from knotwork.session import scratch

    folder = Path(scratch(spark, "x")).parent
    before = {p.name for p in folder.glob("*")}
    kge.train_kge(ring(spark), "transe", dim=4, epochs=9, batch=32, buckets=4, passes=3)
    assert len({p.name for p in folder.glob("*")} - before) <= 6


def test_training_needs_triples(spark):
    with pytest.raises(ValueError):
        kge.train_kge(ring(spark).limit(0))


def test_training_beats_chance(spark):
    links = [(i, 0, (i + 1) % 30) for i in range(30)] + [(i, 1, (i + 2) % 30) for i in range(30)]
    frame = spark.createDataFrame(links, "head long, relation long, tail long")
    entities, relations, losses = kge.train_kge(frame, "rotate", dim=8, epochs=40, batch=16, passes=10)
    assert losses[-1] < losses[0]
    ranks = linkpred.rank_candidates(frame, frame, entities, relations, "rotate").cache()
    assert ranks.count() == 120
    out = linkpred.kge_metric_extract(linkpred.rank_metrics(ranks)).first()
    assert out["inverse_harmonic_mean_rank"] > 0.3


def test_filtered_ranks_by_hand(spark):
    entities = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, vec array<double>")
    relations = spark.createDataFrame([(0, [1.0])], "id long, vec array<double>")
    known = spark.createDataFrame([(0, 0, 1), (0, 0, 2), (0, 0, 4)], "head long, relation long, tail long")
    rows = {(r["tail"], r["side"]): r for r in linkpred.rank_candidates(known, known, entities, relations, "transe").collect()}
    # Tail of (0, 0, 4): candidates 0 and 3 are left beside 4, and both are nearer to 1.
    assert rows[(4, "tail")]["optimistic"] == 3 and rows[(4, "tail")]["candidates"] == 3
    # Tail of (0, 0, 2): 0 is as near to 1 as 2 is.
    assert (rows[(2, "tail")]["optimistic"], rows[(2, "tail")]["pessimistic"], rows[(2, "tail")]["realistic"]) == (1, 2, 1.5)


def class_rows(spark, count=160, seed=5):
    local = np.random.default_rng(seed)
    y = local.integers(0, 2, count)
    x = local.normal(size=(count, 4)) + 1.5 * y[:, None] * [1, 1, 0, 0]
    rows = [(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "key long, y int, features array<double>")


FITS = {
    "logistic": learn.logistic(), "neighbors": learn.nearest_vote(), "svm": learn.kernel_svm(max_iter=20),
    "forest": learn.forest(20, 5), "mlp": learn.mlp((8, 4), 50), "boosted": learn.boosted("A", 5),
    "gated": learn.gated(gated.GatedConfig(epochs=15, batch=16)),
}


@pytest.mark.parametrize("name", FITS)
def test_classifiers_learn(spark, name):
    rows = sampling.stratified_split(class_rows(spark)).cache()
    scored = FITS[name](rows.filter("not is_test"))(rows.filter("is_test"))
    assert scored.filter("probability < 0 or probability > 1").count() == 0
    assert metrics.roc_auc(scored, score="probability").first()[0] > 0.7


def test_gated_loss_falls_and_gates_are_shares(spark):
    rows = class_rows(spark)
    model = gated.fit_gated(rows, gated.GatedConfig(epochs=5, batch=16))
    assert model.losses[-1] < model.losses[0]
    gates = np.array([r["gate"] for r in model.score(rows).collect()])
    assert ((gates > 0) & (gates < 1)).all()


def test_stacking_and_importance(spark):
    rows = sampling.stratified_split(class_rows(spark)).cache()
    train, test = rows.filter("not is_test").drop("is_test"), rows.filter("is_test").drop("is_test")
    models = {"logistic": learn.logistic(max_iter=20), "forest": learn.forest(5, 3)}
    out = stacking.oof_stacking(train, test, models, folds=3)
    assert out.count() == test.count() and metrics.evaluate(out).first()["roc_auc"] > 0.7
    drops = {r["feature"]: r["auc_drop"] for r in stacking.permutation_importance(models["logistic"](train), test).collect()}
    assert min(drops[0], drops[1]) > max(drops[2], drops[3]) - 0.05


def test_split_shares(spark):
    rows = spark.createDataFrame([(i, int(i < 52)) for i in range(116)], "key long, y int")
    assert sampling.stratified_split(rows).filter("is_test").count() == 24
    folds = sampling.stratified_folds(rows).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {10, 11}


NT = r'''# a comment
<http://x#a> <http://x#p> "say \"hi\" . \\ é\U0001F600\n" .
<http://x#a> <http://x#p> "1.5"^^<http://www.w3.org/2001/XMLSchema#float> . # end
_:b1 <http://x#q> <http://x#a> .
<http://x#a> <http://x#p> "oui"@fr .
<http://x#a> <http://x#p> _:b.2 .
this is no triple
'''


def test_ntriples(spark, tmp_path):
    path = tmp_path / "g.nt"
    path.write_text(NT, encoding="utf-8")
    rows = {(r["subj"], r["obj"]): r for r in rdf.read_ntriples(spark, str(path)).collect()}
    assert rows[("http://x#a", 'say "hi" . \\ é😀\n')]["obj_kind"] == "literal"
    assert rows[("http://x#a", "1.5")]["obj_datatype"].endswith("float")
    assert rows[("b1", "http://x#a")]["subj_kind"] == "bnode" and rows[("http://x#a", "oui")]["obj_lang"] == "fr"
    assert rows[("http://x#a", "b.2")]["obj_kind"] == "bnode" and len(rows) == 5
    assert [r["value"] for r in rdf.bad_ntriples(spark, str(path)).collect()] == ["this is no triple"]


XML = '''<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:ex="http://x#">
  <rdf:Description rdf:about="http://x#Patient_1">
    <rdf:type rdf:resource="http://x#Patient"/>
    <ex:MCP.1 rdf:datatype="http://www.w3.org/2001/XMLSchema#float">3.5</ex:MCP.1>
    <ex:tumor-size>10 &amp; 14</ex:tumor-size>
    <ex:friend rdf:resource="http://x#Patient_2"/>
    <ex:friend rdf:resource="http://x#Patient_3"/>
  </rdf:Description>
  <rdf:Description rdf:about="http://x#Patient_2"><ex:tumor-size>5</ex:tumor-size></rdf:Description>
</rdf:RDF>'''


def test_rdfxml(spark, tmp_path):
    path = tmp_path / "g.owl"
    path.write_text(XML)
    rows = {(r["subj"][-1], r["pred"].split("#")[-1], r["obj"], r["obj_kind"]) for r in rdfxml.read_rdfxml(spark, str(path)).collect()}
    assert rows == {
        ("1", "type", "http://x#Patient", "iri"), ("1", "MCP.1", "3.5", "literal"), ("1", "tumor-size", "10 & 14", "literal"),
        ("1", "friend", "http://x#Patient_2", "iri"), ("1", "friend", "http://x#Patient_3", "iri"), ("2", "tumor-size", "5", "literal"),
    }


def test_tables_need_a_key(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("entity,leiden,hdbscan_label\na,1,x\nb,,2\n")
    rows = {r["key"]: (r["community"], r["density_cluster"]) for r in tables.read_cluster_table(spark, str(path)).collect()}
    assert rows == {"a": (1, -1), "b": (-1, 2)}
    other = tmp_path / "d.csv"
    other.write_text("name,leiden\na,1\n")
    with pytest.raises(ValueError):
        tables.read_cluster_table(spark, str(other))
