"""Hand-computed cases of the core operators."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from linkloom.functions import text as T
from linkloom.functions import vectors as V
from linkloom.operators import evolve, features, graph, sampling, similarity
from linkloom.operators import links as L
from linkloom.operators import metrics as M
from linkloom.operators.code_parser import declarations
from linkloom.operators.similarity import relaxed_wmd, word_movers_distance
from linkloom.operators.skew import hot_join
from linkloom.plans import techniques
from linkloom.sources import readers as R
from linkloom.sources import writers as S


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.fixture(scope="module")
def sims(spark):
    rows = [("C1", "E1", "R1", "a", 0.9), ("C1", "E1", "R2", "a", 0.8), ("C1", "E2", "R1", "a", 0.4), ("C1", "E2", "R2", "a", 0.7), ("C1", "E3", "R1", "a", 0.6), ("C1", "E3", "R2", "a", 0.2)]
    return spark.createDataFrame(rows, "code string, elem string, req string, part string, sim double")


def test_camel_case(spark):
    t = F.array(F.lit("getUserName"), F.lit("HTTPServerError"), F.lit("UC10E1"))
    assert one(spark, T.camel_case(t))[0] == ["get", "User", "Name", "HTTP", "Server", "Error", "UC10", "E1"]


def test_majority_keeps_ties(spark, sims):
    got = {(r.req, r.sim, r.votes) for r in L.majority_links(sims, F.lit(0.3), F.lit(0.5)).collect()}
    assert got == {("R1", 0.9, 2), ("R2", 0.8, 2)}
    mean = {(r.req, round(r.sim, 6)) for r in L.majority_links(sims, F.lit(0.3), F.lit(0.5), how_code="mean").collect()}
    assert mean == {("R1", 0.75), ("R2", 0.75)}


def test_top_n(sims):
    got = [(r.req, r.sim, r.votes) for r in L.top_n_links(sims, F.lit(0.3), 1).collect()]
    assert got == [("R1", 0.9, 2)]


def test_precision_recall_and_duplicates(spark):
    gold = spark.createDataFrame([("R1", "C1"), ("R2", "C2")], "req string, code string")
    links = spark.createDataFrame([("r1", "C1", 0.5), ("R2", "C1", 0.5)], "req string, code string, sim double")
    r = M.evaluate(links, gold).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 0.5, 0.5)
    twice = spark.createDataFrame([("R1", "C1", 0.5), ("R1", "C1", 0.5)], "req string, code string, sim double")
    r = M.evaluate(twice, gold.filter("req = 'R1'")).first()
    assert (r.found, r.hits, r.precision, r.recall) == (2, 1, 0.5, 1.0)
    assert M.evaluate(links.limit(0), gold).first()["f1"] == 0.0


def test_average_precision(spark):
    links = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 0), ("q", "c", 0.7, 1)], "req string, code string, sim double, hit int")
    assert M.average_precision(links, ("req",)).first()["ap"] == pytest.approx(0.833333, abs=1e-6)
    curve = spark.createDataFrame([(0.5, 1.0), (1.0, 0.5)], "recall double, precision double")
    assert M.integral_average_precision(curve).first()["ap"] == 0.75


def test_weighted_sum_and_replication(spark):
    rows = spark.createDataFrame([("C", "E", "R", 0.5, False), ("C", "E", "R", 0.9, True), ("C", "E", "R", 0.7, True)], "code string, elem string, req string, sim double, near boolean")
    assert L.weighted_sums(rows, 0.8).first()["sim"] == pytest.approx(0.56)
    assert L.replicated_votes(rows, 0.75).first()["votes"] == 6 + 2
    with pytest.raises(ValueError):
        L.replicated_votes(rows, 1.0)


def test_numbers(spark):
    r = one(spark, V.jaccard(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcdd"))), V.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")), V.top_percent(F.lit(25), 0.1), V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))))
    assert list(r) == [0.5, 0.0, 2, 0.0]
    x = spark.createDataFrame([(0.2,), (0.5,), (0.8,)], "sim double")
    assert sorted(round(r.sim, 6) for r in L.normalise(x).collect()) == [0.0, 0.5, 1.0]
    assert [r.sim for r in L.normalise(spark.createDataFrame([(0.4,), (0.4,)], "sim double")).collect()] == [0.4, 0.4]


def test_file_threshold(spark):
    x = spark.createDataFrame([(0.5,), (None,)], "sim double")
    assert L.file_threshold(x, F.lit(0.5)).count() == 1 and L.file_threshold(x, F.lit(0.5), True).count() == 2


def test_tfidf(spark):
    t = spark.createDataFrame([("d1", "alpha"), ("d1", "beta"), ("d2", "alpha"), ("d2", "alpha"), ("d2", "gamma")], "file string, word string")
    w = {(r.file, r.word): round(r.weight, 6) for r in features.tfidf(t).collect()}
    assert w == {("d1", "alpha"): 0.579739, ("d1", "beta"): 0.814802, ("d2", "alpha"): 0.81818, ("d2", "gamma"): 0.574962}
    x = features.tfidf(t)
    assert features.sparse_cosine(x.filter("file = 'd1'"), x.filter("file = 'd2'")).first()["sim"] == pytest.approx(0.474331, abs=1e-6)


def test_word_movers_distance(spark):
    v = {"x": np.array([0.0, 0.0]), "y": np.array([1.0, 0.0]), "z": np.array([0.0, 2.0])}
    assert word_movers_distance(["x", "y"], ["x"], v) == pytest.approx(0.5)
    assert word_movers_distance(["x"], ["x"], v) == 0.0 and word_movers_distance(["q"], ["x"], v) == float("inf")
    rng = np.random.default_rng(3)
    for _ in range(30):
        words = {f"w{i}": rng.normal(size=3) for i in range(6)}
        a, b = rng.choice(list(words), 4).tolist(), rng.choice(list(words), 3).tolist()
        got = word_movers_distance(a, b, words)
        # every unit of twelve by brute force over assignments
        big_a, big_b = [x for x in a for _ in range(3)], [x for x in b for _ in range(4)]
        cost = np.array([[np.linalg.norm(words[p] - words[q]) for q in big_b] for p in big_a])
        best = _assign(cost) / 12
        assert got == pytest.approx(best, abs=1e-9)
    vec = spark.createDataFrame([(k, x.tolist()) for k, x in v.items()], "word string, vec array<double>")
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "a int, word string"), spark.createDataFrame([(2, "x")], "b int, word string")
    assert relaxed_wmd(a, b, vec, spark.createDataFrame([(1, 2)], "a int, b int")).first()["rwmd"] == pytest.approx(0.5)


def _assign(cost):
    """The cheapest perfect matching, by dynamic programming over subsets."""
    n = len(cost)
    best = {0: 0.0}
    for i in range(n):
        nxt = {}
        for mask, c in best.items():
            for j in range(n):
                if not mask >> j & 1:
                    m = mask | 1 << j
                    if c + cost[i][j] < nxt.get(m, float("inf")):
                        nxt[m] = c + cost[i][j]
        best = nxt
    return best[(1 << n) - 1]


def test_fronts_and_crowding(spark):
    p = spark.createDataFrame([("A", 3, 1), ("B", 2, 2), ("C", 1, 3), ("D", 1, 1)], "ind string, x int, y int")
    assert {(r.ind, r.front) for r in evolve.fronts(p, ["x", "y"]).collect()} == {("A", 1), ("B", 1), ("C", 1), ("D", 2)}
    c = evolve.crowding(spark.createDataFrame([(str(v), 1, v) for v in (0, 1, 3, 6)], "ind string, front int, v int"), ["v"])
    got = {r.ind: r.crowding for r in c.collect()}
    assert math.isinf(got["0"]) and math.isinf(got["6"]) and got["1"] == pytest.approx(0.5) and got["3"] == pytest.approx(0.833333, abs=1e-6)
    sims = {(f"r{i}", f"c{i}"): (i / 20,) for i in range(20)}
    s = evolve.Settings(size=10, genes=4, generations=15)
    assert evolve.search(sims, s) == evolve.search(sims, s)
    assert evolve.search(sims, s)[0][1][0] > 0.7 and evolve.search({}, s) == []


def test_rules_and_graphs(spark):
    links = spark.createDataFrame([("A", "R", 0.5)], "code string, req string, sim double")
    rel = spark.createDataFrame([("A", "B")], "sub string, super string")
    assert {(r.code, r.sim) for r in L.rule_links(links, rel, "up").collect()} == {("A", 0.5), ("B", None)}
    rows = [("f", 1, "main() <x>"), ("f", 2, "    a() <x>"), ("f", 3, "        b() <x>"), ("f", 4, "    c() <x>"), ("f", 5, "        b() <x>")]
    got = sorted((r.caller, r.callee) for r in graph.call_tree_edges(spark.createDataFrame(rows, "file string, line_no int, line string")).collect())
    assert got == [("a", "b"), ("c", "b"), ("main", "a"), ("main", "c")]
    issues = spark.createDataFrame([("1", {"sub": ["2"]}), ("2", {"sub": ["3", "1"]}), ("3", None)], "issueid string, children map<string,array<string>>")
    assert {(r.root, r.issueid, r.depth) for r in graph.descend(issues).collect()} >= {("1", "3", 2), ("2", "1", 1), ("3", "3", 0)}


def test_declarations():
    src = '/** Doc of T. */\npublic class T extends B implements I {\n  private int[] a = {1};\n  /* run it */ public String run(int x, String[] ys) { this.a = x; int z = 3; return "{"; }\n  enum E { ONE, TWO }\n}\n'
    d = {(x[1], x[3]): x for x in declarations(src)}
    assert d[("class", "T")][7] == ["B", "I"] and d[("class", "T")][8] == "Doc of T."
    run = d[("method", "run")]
    assert run[5] == ["int", "String[]"] and run[6] == ["x", "ys"] and run[4] == "String" and run[10] == ["a", "z"]
    assert ("attribute", "a") in d and ("constant", "ONE") in d
    c = {x[3] for x in declarations("/* f */ static int f(int a) { return a; }\ntypedef unsigned long size;\n", c=True)}
    assert {"f", "size"} <= c
    assert list(declarations("class {{{ /* ")) is not None


def test_round_trips(spark, tmp_path):
    gold = spark.createDataFrame([("R1", "A.java"), ("R1", "B.java"), ("R2", "A.java")], "req string, code string")
    S.write_lines(S.gold_lines(gold), str(tmp_path / "g"))
    assert {tuple(r) for r in R.gold_text(spark.read.text(str(tmp_path / "g"))).collect()} == {tuple(r) for r in gold.collect()}
    (tmp_path / "x.xml").write_text("<links><link><req>R1</req><x/><code>A</code></link><link><req>R2</req><code>B</code></link></links>")
    assert {tuple(r) for r in R.gold_xml(spark, str(tmp_path / "x.xml")).collect()} == {("R1", "A"), ("R2", "B")}
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_bytes(b"\xef\xbb\xbfone\r\ntwo")
    got = R.lines(R.texts(spark, str(tmp_path / "t"))).select("stem", "pos", "line").collect()
    assert [tuple(r) for r in got] == [("a", 0, "one"), ("a", 1, "two")]
    assert R.files(spark, str(tmp_path / "t")).first()["file_name"] == "a.txt"


def test_sampling(spark):
    df = spark.createDataFrame([(str(i),) for i in range(101)], "k string")
    got = sampling.sample_share(df, "k", 0.3, 5)
    assert got.filter("chosen").count() == 31 and got.count() == 101
    assert sorted(r.k for r in got.filter("chosen").collect()) == sorted(r.k for r in sampling.sample_share(df, "k", 0.3, 5).filter("chosen").collect())


def test_hot_join(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    side = big.groupBy("k").agg(F.count("*").alias("n"))
    assert hot_join(big, side, "k", "n", 20_000).count() == 20_000


def test_technique_registries():
    assert len(techniques.word_bag_techniques()) >= 38 and len(techniques.element_techniques()) == 23
    assert "methods" not in techniques.element_techniques()["only_class_name_comment"]


def test_row_order_does_not_matter(spark, sims):
    grid = spark.createDataFrame([(0.3, 0.5, 0.5), (0.3, 0.5, 0.85)], "e double, m double, f double")
    gold = spark.createDataFrame([("R1", "C1")], "req string, code string")
    a = sorted(map(tuple, techniques.sweep(sims, grid, gold).collect()))
    b = sorted(map(tuple, techniques.sweep(sims.orderBy(F.desc("elem")), grid, gold).collect()))
    assert a == b and a[0][3] >= a[1][3]


def test_wmd_of_all_methods_and_parts(spark, small):
    from linkloom.plans import domain as D

    a = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (3, "odd"), (4, "z"), (4, "odd")], "a long, word string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (2, "twin"), (3, "odd"), (4, "twin"), (5, "x"), (5, "twin")], "b long, word string")
    vec = {"x": [0.0, 1.0], "y": [2.0, 0.5], "z": [-1.0, 3.0], "twin": [0.0, 1.0]}
    bags = [{}, {}]
    for bag, t in zip(bags, (a, b), strict=True):
        for k, w in t.collect():
            bag.setdefault(k, []).append(w)
    table = spark.createDataFrame(list(vec.items()), "word string, vec array<double>")
    for rows in (2, 100):
        got = {(r.a, r.b): r for r in similarity.wmd_all(a, b, table, True, rows).collect()}
        assert len(got) == 20
        for (i, j), r in got.items():
            want = similarity.word_movers_distance(bags[0][i], bags[1][j], {k: np.array(v) for k, v in vec.items()})
            assert r.wmd == want or abs(r.wmd - want) < 1e-9
            assert r.rwmd <= r.wmd + 1e-9
        want = {(r.a, r.b): r.rwmd for r in similarity.relaxed_wmd(a, b, table, a.select("a").distinct().join(b.select("b").distinct())).collect()}
        assert all(abs(got[k].rwmd - x) < 1e-9 for k, x in want.items()) and {k for k, r in got.items() if r.rwmd < float("inf")} == set(want)
    n = D.method_words(spark, small).select("elem").distinct().count() * D.part_words(spark, small).select("part").distinct().count()
    assert n > 10_000


def test_evaluation_of_every_tool(spark, small):
    from linkloom import queries as Q
    from linkloom.plans import domain as D

    tools = {r.tool for r in spark.read.parquet(f"{small}/trace_score.parquet").select("tool").distinct().collect()}
    assert len(tools) > 1
    gold = {(r.req, r.code) for r in D.trace_gold(spark, small).collect()}
    scores = {}
    for r in spark.read.parquet(f"{small}/trace_score.parquet").collect():
        if r.score is not None and not math.isnan(r.score) and r.req_filename is not None and r.code_filename is not None:
            k = (r.tool, r.req_filename.lower(), r.code_filename.lower())
            scores[k] = max(scores.get(k, r.score), r.score)
    got = {(r.tool, r.f): (r.found, r.hits, r.gold) for r in Q.queries()["swp07_third_party"](spark, small).collect()}
    want = {}
    for f in (x / 10 for x in range(1, 9)):
        for t in tools:
            found = [k[1:] for k, s in scores.items() if k[0] == t and s > f]
            if found:
                want[t, f] = (len(found), len(gold & set(found)), len(gold))
    assert got == want


def test_map_and_recall_beyond_the_longest_ranking(spark):
    rows = [("r", f"c{i:02}", 1.0 - i / 100, int(i in (0, 11))) for i in range(12)] + [("q", "c00", 0.5, 1)]
    links = spark.createDataFrame(rows, "req string, code string, sim double, hit int")
    got = {r.k: (round(r.map, 9), round(r.recall, 9)) for r in M.map_and_recall(links, 2, 4, 15).collect()}
    assert got == {k: (1.0, 0.5) if k < 12 else (round((1 + (1 + 2 / 12) / 2) / 2, 9), 0.75) for k in range(1, 16)}


def test_dominations_and_all_fronts(spark):
    rng = np.random.default_rng(16)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (150, 2)))] + [(150 + i, 20.0 + i, 20.0 + i) for i in range(60)]
    df = spark.createDataFrame(pts, "ind long, a double, b double")
    over = lambda p, q: p[1] >= q[1] and p[2] >= q[2] and p[1:] != q[1:]
    for size in (1000, 7):
        assert evolve.dominations(df, "a", "b", size).first()[0] == sum(over(p, q) for p in pts for q in pts)
    left, want = set(pts), {}
    for k in range(1, len(pts) + 1):
        front = {q for q in left if not any(over(p, q) for p in left)}
        want |= {q[0]: k for q in front}
        left -= front
    assert max(want.values()) > 60
    assert {r.ind: r.front for r in evolve.fronts_of_two(df, "a", "b").collect()} == want
    few = spark.createDataFrame([(i, float(i), float(i)) for i in range(4)], "ind long, a double, b double")
    assert {r.ind: r.front for r in evolve.fronts(few, ["a", "b"]).collect()} == {3: 1, 2: 2, 1: 3, 0: 4}


def test_pairs_of_all_files(spark, small):
    from linkloom import queries as Q
    from linkloom.plans import domain as D

    got = {(r.tool, r.req, r.code): r.sim for r in Q.queries()["jn08_completion"](spark, small).collect()}
    for tool in {k[0] for k in got}:
        s = {(r.req, r.code): round(r.sim, 6) for r in D.trace_scores(spark, small).filter(F.col("tool") == tool).collect()}
        pairs = {(r, c) for r in {k[0] for k in s} for c in {k[1] for k in s}}
        assert {k[1:]: x for k, x in got.items() if k[0] == tool} == {k: s.get(k, 0.0) for k in pairs}
    gold = {}
    for r in spark.read.parquet(f"{small}/trace_link.parquet").collect():
        if r.dataset is not None and r.req_filename is not None and r.code_filename is not None:
            gold.setdefault(r.dataset, set()).add((r.req_filename.lower(), r.code_filename.lower()))
    want = sorted((d, r, c, int((r, c) in g)) for d, g in gold.items() for r in {k[0] for k in g} for c in {k[1] for k in g})
    assert sorted((r.dataset, r.requirement_filename, r.code_filename, r.valid) for r in Q.queries()["jn14_labelled_pairs"](spark, small).collect()) == want
    nodes = {r.id for r in D.elem(spark, small).collect()}
    assert max(nodes) > 300
    edges = {(r.caller, r.callee) for r in D.call_edges(spark, small).collect()}
    assert {(r.caller, r.callee) for r in Q.queries()["set09_known_edges"](spark, small).collect()} == {e for e in edges if set(e) <= nodes}


def test_tfidf_of_all_documents(spark, small, tmp_path):
    from linkloom import queries as Q

    rows = [(1, "Über die naïve 漢字", "code"), (2, "die e\u0301tude", "issue"), (3, "die x9", None), (4, None, "note"), (5, "die wort", "note")]
    spark.createDataFrame(rows, "doc_id long, text string, artefact_kind string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda n: Q.queries()[n](spark, str(tmp_path)).collect()
    got = {(r.file, r.word): r.weight for r in run("emb15_tfidf")}
    assert set(got) == {(1, "über"), (1, "die"), (1, "naïve"), (1, "漢字"), (2, "die"), (2, "e\u0301tude"), (3, "die"), (3, "x9"), (5, "die"), (5, "wort")}
    rare = math.log(5 / 2) + 1
    assert got[3, "x9"] == round(rare / math.hypot(rare, 1), 6)
    assert {r.file for r in run("jn12_file_word_weight")} == {r.file for r in run("fn08_tfidf_filter")} == {1, 2, 3, 5}


def test_refinement_goes_on_while_f1_improves(spark, monkeypatch):
    grid = spark.createDataFrame([(0.3, 0.3, 0.3)], "e double, m double, f double")
    steps = iter(range(100))

    class Best:
        def first(self):
            n = min(next(steps), 30)
            return Row(e=0.3, m=0.3, f=0.3, f1=n / 100)

    monkeypatch.setattr(techniques, "sweep", lambda *a, **k: None)
    monkeypatch.setattr(techniques.M, "best_cell", lambda *a, **k: Best())
    assert techniques.refine_best(grid, grid, grid)["f1"] == 0.3


# --- populations -----------------------------------------------------------------------------------------------


def _pop(spark, links):
    return spark.createDataFrame([(i, r, c) for i, gs in links.items() for r, c in gs], "ind long, req string, code string")


def _groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.ind, set()).add((r.req, r.code))
    return out


def test_population_operators(spark):
    a, b, c, d, e = (("r", x) for x in "abcde")
    pop = _pop(spark, {1: [a, b, c], 2: [c, d], 3: [e]})
    couples = spark.createDataFrame([(1, 2)], "a long, b long")
    assert _groups(evolve.swapped(pop, couples, 1)) == {1: {b, c, d}, 2: {c, a}, 3: {e}}
    assert _groups(evolve.swapped(pop, couples, 9)) == {1: {b, c, d}, 2: {c, a}, 3: {e}}  # two has one to give
    fresh = _pop(spark, {1: [a, e], 2: [a, b, e]})
    assert _groups(evolve.replaced(pop, fresh, 2)) == {1: {b, c, e}, 2: {a, b}, 3: {e}}
    pool = evolve.numbered(spark.createDataFrame([a, b, c, d, e], "req string, code string"), ["req", "code"])
    assert {(r.code, r["at"]) for r in pool.collect()} == {(x, i) for i, x in enumerate("abcde", 1)}
    sizes = spark.createDataFrame([(1, 2), (2, 4), (3, 9), (4, 2), (5, 0)], "ind long, size int")
    assert _groups(evolve.trimmed(pop, pool, sizes)) == {1: {a, b}, 2: {a, b, c, d}, 3: {a, b, c, d, e}, 4: {a, b}}
    ranked = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.1), (3, 1, 0.7)], "ind long, front int, crowding double")
    matches = spark.createDataFrame([(7, 1), (7, 2), (8, 2), (8, 3)], "match long, ind long")
    assert {(r.match, r.ind) for r in evolve.winners(matches, ranked).collect()} == {(7, 2), (8, 3)}
    v = lambda xs: spark.createDataFrame(xs, "ind long, value double")
    old, new = v([(1, 0.9), (2, 0.1)]), v([(3, 0.5), (4, 0.4)])
    assert [[r.ind for r in evolve.elite(old, new, 2, p).collect()] for p in ("merge", "first", "none")] == [[1, 3], [1, 3], [3, 4]]


def test_a_search_draws_from_the_whole_table(spark):
    rows = [(f"r{i}", f"c{j}", 1.0 if i == j else 0.1, float(j) / 20) for i in range(30) for j in range(20)]
    pool = evolve.TablePool(spark.createDataFrame(rows, "req string, code string, x double, y double"), ["x", "y"])
    assert len(pool) == 600
    s = evolve.Settings(size=12, genes=5, generations=4)
    found = evolve.search(pool, s)
    assert found and all(len(p) == 5 for p, _ in found) and len(pool.values) > 150
    assert evolve.search(evolve.TablePool(spark.createDataFrame(rows, "req string, code string, x double, y double"), ["x", "y"]), s) == found
    assert evolve.search(evolve.TablePool(spark.createDataFrame([], "req string, code string, x double"), ["x"]), s) == []


# --- techniques ------------------------------------------------------------------------------------------------

SOURCES = [
    ("a.java", "/** Tourist data of the house */ public class TouristHouse extends Base { private String streetName; /** gives the street of the house */ public String getStreet(int houseNumber) { return findHouse(houseNumber); } public House findHouse(int n) { return null; } int hidden() { return 1; } }"),
    ("b.java", "public interface MenuCard { String dish(int index); }"),
    ("c.java", "public class Printer { }"),
]


@pytest.fixture(scope="module")
def inputs(spark):
    from linkloom.operators.code_parser import parse_sources
    from linkloom.plans import runner

    code = parse_sources(spark.createDataFrame(SOURCES, "file string, content string")).cache()
    reqs = spark.createDataFrame([("r1", "Tourist house\nThe street of the house. It has a number."), ("r2", "Menu\nA dish of the card."), ("r3", "")], "req string, text string")
    words = sorted({w for t in ("tourist house street number the of it has a dish menu card printer get find index data gives base name n string int",) for w in t.split()})
    rng = np.random.default_rng(18)
    vec = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in words], "word string, vec array<double>")
    return runner.Inputs(reqs, code, vec, spark.createDataFrame([("r1", "a.java"), ("r2", "b.java")], "req string, code string"), {})


def test_declarations_that_are_public(inputs):
    got = {(r.file, r.kind, r.name) for r in inputs.code.collect()}
    assert {("a.java", "method", "getStreet"), ("a.java", "method", "findHouse"), ("b.java", "method", "dish"), ("a.java", "attribute", "streetName")} <= got
    assert ("a.java", "method", "hidden") not in got


def test_parts_and_bags(inputs):
    from linkloom.plans import runner

    def bags(df, key, owner):
        out = {}
        for r in df.collect():
            out.setdefault((r[owner], r[key]), []).append(r.word)
        return sorted((k[0], sorted(v)) for k, v in out.items())

    assert bags(runner.requirement_parts(inputs, "N,D"), "part", "req") == [("r1", ["a", "has", "house", "it", "number", "of", "street", "the", "the"]), ("r1", ["house", "tourist"]), ("r2", ["a", "card", "dish", "of", "the"]), ("r2", ["menu"])]
    assert len(bags(runner.requirement_parts(inputs, "S"), "part", "req")) == 3
    assert bags(runner.code_bags(inputs.code, "element", "cls+m"), "elem", "code") == [("a.java", ["find", "house", "house", "int", "tourist"]), ("a.java", ["get", "house", "int", "street", "tourist"]), ("a.java", ["house", "tourist"]), ("b.java", ["card", "dish", "int", "menu"]), ("b.java", ["card", "menu"]), ("c.java", ["printer"])]
    votes = lambda v: sorted((r.code, r.is_class) for r in runner.voting(runner.code_bags(inputs.code, "element", "cls+m"), v).collect())
    methods = [("a.java", False), ("a.java", False), ("b.java", False)]
    assert votes(techniques.Voter.NEVER) == methods and votes(techniques.Voter.OPTIONAL) == sorted([*methods, ("c.java", True)]) and len(votes(techniques.Voter.ALWAYS)) == 6


def test_word_bag_techniques_against_brute_force(spark, inputs):
    from linkloom.plans import runner

    vec = {r.word: np.array(r.vec) for r in inputs.word_vec.collect()}
    two = [techniques.WordBagTechnique("element", "S", "cls+m", techniques.Voter.ALWAYS), techniques.WordBagTechnique("file", "T", "cls+m", techniques.Voter.NEVER)]
    got = {(r.technique, r.code, r.req): (r.votes, round(r.sim, 9)) for r in runner.run_word_bags(two, inputs).collect()}

    def rwmd(a, b):
        a, b = [w for w in a if w in vec], [w for w in b if w in vec]
        side = lambda x, y: np.mean([min(np.linalg.norm(vec[p] - vec[q]) for q in y) for p in x])
        return max(side(a, b), side(b, a))

    want = {}
    for t in two:
        bag = lambda df, k, o: {key: [r.word for r in rows] for key, rows in _by(df.collect(), k, o).items()}
        elems, parts = bag(runner.code_bags(inputs.code, t.level, t.texts), "elem", "code"), bag(runner.requirement_parts(inputs, t.parts), "part", "req")
        votes = {}
        for (e, code), words in elems.items():
            best = {}
            for (_, req), other in parts.items():
                best[req] = min(best.get(req, 9e9), rwmd(words, other))
            req = min(best, key=lambda r: (best[r], r))
            votes.setdefault(code, []).append((req, best[req]))
        for code, vs in votes.items():
            n = {r: sum(x == r for x, _ in vs) for r, _ in vs}
            for r in n:
                if n[r] == max(n.values()):
                    want[t.name, code, r] = (n[r], round(-min(s for x, s in vs if x == r), 9))
    assert got == want


def _by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


def test_element_techniques(inputs):
    from linkloom.plans import runner

    sets = {k: techniques.element_techniques()[k] for k in ("identifiers", "comment_to_class", "attributes", "only_methods", "tfidf_identifiers")}
    got = {}
    for r in runner.element_tokens(inputs.code, sets).filter("code = 'a.java'").collect():
        got.setdefault(r.technique, {}).setdefault(r.elem, []).append(r.word)
    bags = {t: sorted(sorted(v) for v in x.values()) for t, x in got.items()}
    own = [["find", "house", "house", "int", "n", "tourist"], ["get", "house", "house", "int", "number", "street", "tourist"]]
    assert bags["identifiers"] == sorted([["house", "tourist"], *own]) == bags["tfidf_identifiers"] and bags["only_methods"] == own
    assert sorted(["name", "street"]) in bags["attributes"] and sorted("tourist house gives the street of the house".split()) in bags["comment_to_class"]
    v = runner.file_vectors(runner.element_vectors(inputs.code, sets, inputs.word_vec)).collect()
    assert {(r.technique, r.code) for r in v} >= {(t, "a.java") for t in sets} and {r.elements for r in v if r.code == "a.java" and r.technique == "identifiers"} == {3}
    out = runner.evaluated(runner.run_elements(sets, inputs), inputs).collect()
    assert {r.technique for r in out} == set(sets) and all(r.gold == 2 for r in out)
    with pytest.raises(ValueError, match="unknown flags"):
        runner.element_tokens(inputs.code, {"x": frozenset({"nothing"})})


def test_processors_and_calls(inputs):
    from linkloom.plans import runner

    assert runner.body_calls(inputs.code).count() == 1  # getStreet calls findHouse
    out = {name: {(r.code, r.req) for r in df.collect()} for name, df in runner.processors(inputs).items()}
    assert len(out) == 6 and all(len({c for c, _ in v}) >= 2 for v in out.values())


def test_nearest_by_exact_distance(spark):
    rng = np.random.default_rng(19)
    words = [f"w{i}" for i in range(30)]
    vec = {w: rng.normal(size=3) for w in words}
    table = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "word string, vec array<double>")
    bag = lambda n, m: {i: [words[j] for j in rng.integers(0, 30, rng.integers(1, m))] for i in range(n)}
    a, b = bag(40, 5), bag(6, 6)
    a[40], b[6] = ["unknown"], ["unknown"]
    df = lambda x, k: spark.createDataFrame([(i, w) for i, ws in x.items() for w in ws], f"{k} long, word string")
    got = {(r.b, r.rank): (r.a, round(r.wmd, 7)) for r in similarity.nearest_by_wmd(df(a, "a"), df(b, "b"), table, 3).collect()}
    for j, ws in b.items():
        d = sorted((round(word_movers_distance(x, ws, vec), 7), i) for i, x in a.items())
        assert [got.get((j, k)) for k in (1, 2, 3)] == ([(i, x) for x, i in d[:3]] if j < 6 else [None] * 3)


def test_pair_classifier_on_unseen_pairs(spark):
    rng = np.random.default_rng(20)
    words = [f"{x}{y}" for x in ("tour", "menu", "card", "street", "house", "drone", "badge", "guest") for y in ("ist", "list", "form", "page")]
    rows = []
    for i in range(3000):
        a = rng.choice(words, 6).tolist()
        hit = int(i % 5 == 0)
        rows.append((i, a, (rng.choice(a, 2) if hit else rng.choice(words, 2)).tolist(), hit))
    p = spark.createDataFrame(rows, "i long, a array<string>, b array<string>, hit int")
    out = similarity.pair_probabilities(p, "hit", 300).collect()
    hits = [r.probability for r in out if r.hit]
    rest = [r.probability for r in out if not r.hit]
    assert len(out) == 3000 and np.mean([h > x for h in hits[:200] for x in rest[:500]]) > 0.9  # held-out: the sample has 600 of 3,000
    assert similarity.pair_probabilities(p.limit(0), "hit").count() == 0
    assert {r.probability for r in similarity.pair_probabilities(p.filter("hit = 1").limit(5), "hit").collect()} == {1.0}


def test_lemmas(spark):
    w = lambda xs: spark.createDataFrame([(x,) for x in xs], "word string")
    got = {r.word: r.lemma for r in features.noun_lemmas(w(["houses", "house", "boxes", "box", "cities", "city", "men", "glass", "bus"]), w(["house", "box", "city", "man", "bus", "glass"])).collect()}
    assert got == {"houses": "house", "house": "house", "boxes": "box", "box": "box", "cities": "city", "city": "city", "men": "man", "glass": "glass", "bus": "bus"}


def test_only_own_directories_are_reset(spark, tmp_path):
    with pytest.raises(ValueError, match="not an output path"):
        S.reset_directory(spark, f"file://{tmp_path}/other")
    (tmp_path / "linkloom").mkdir()
    (tmp_path / "linkloom" / "x").mkdir()
    (tmp_path / "linkloom" / "x" / "f").write_text("1")
    S.reset_directory(spark, f"file://{tmp_path}/linkloom/x")
    assert list((tmp_path / "linkloom" / "x").iterdir()) == []


def test_plans_with_a_shuffle_are_not_run_to_count_their_partitions(spark):
    from linkloom.runtime import partitions, spread

    df = spark.range(100)
    assert partitions(df) == df.rdd.getNumPartitions() and partitions(df.groupBy("id").count()) is None
    assert spread(df.groupBy("id").count()).count() == 100


def test_pairs_that_share_a_word_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(features, "blocks", lambda t, key: similarity.blocks(t, key, 2))
    a = {f"r{i}": {f"w{j}" for j in range(9) if (i * 5 + j * 3) % 4 == 0} for i in range(5)}
    b = {f"c{i}": {f"w{j}" for j in range(9) if (i + j * j) % 3 == 0} | {f"own{i}"} for i in range(7)}
    rows = lambda t, key: spark.createDataFrame([(k, w) for k, ws in t.items() for w in ws], f"{key} string, word string")
    got = features.sparse_jaccard(rows(a, "a"), rows(b, "b"))
    assert {(r.a, r.b): round(r.sim, 9) for r in got.collect()} == {(x, y): round(len(v & w) / len(v | w), 9) for x, v in a.items() for y, w in b.items() if v & w}
    weights = lambda t: spark.createDataFrame([(k, w, len(w) + len(k) / 7 + i) for k, ws in t.items() for i, w in enumerate(sorted(ws))], "file string, word string, weight double")
    of = lambda t: {(r.file, r.word): r.weight for r in weights(t).collect()}
    x, y, cosines = of(a), of(b), features.sparse_cosine(weights(a), weights(b))
    assert {(r.a, r.b): round(r.sim, 9) for r in cosines.collect()} == {(p, q): round(sum(x[p, w] * y[q, w] for w in a[p] & b[q]), 9) for p in a for q in b if a[p] & b[q]}
    for df in (got, cosines):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_labelled_pairs_are_not_shuffled(spark):
    reqs = spark.createDataFrame([("d", f"R{i}", f"text {i}") for i in range(4)] + [("e", "R0", "other")], "dataset string, req string, requirement string")
    codes = spark.createDataFrame([("d", f"C{i}", f"c{i}") for i in range(3)] + [("e", "C0", "c0")], "dataset string, code string, code_entry string")
    gold = spark.createDataFrame([("d", "r1", "c2"), ("d", "R1", "C0"), ("d", "R3", "c1"), ("e", "R9", "c0")], "dataset string, req string, code string")
    pairs = sampling.labelled_pairs(reqs, codes, gold)
    got = sorted((r.dataset, r.requirement_filename, r.code_filename, r.valid) for r in pairs.collect())
    hits = {("R1", "C2"), ("R1", "C0"), ("R3", "C1")}
    assert got == sorted([("d", f"R{i}", f"C{j}", int((f"R{i}", f"C{j}") in hits)) for i in range(4) for j in range(3)] + [("e", "R0", "C0", 0)])
    assert "LeftOuter" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_completed_pairs_are_not_shuffled(spark):
    links = spark.createDataFrame([("t", "R1", "C1", 0.5), ("t", "R1", "C1", 0.4), ("t", "R2", "C3", 0.1), ("u", "R1", "C2", 0.9)], "tool string, req string, code string, sim double")
    done = M.complete(links, links, links, run=("tool",))
    assert sorted((r.tool, r.req, r.code, r.sim) for r in done.collect()) == [("t", "R1", "C1", 0.4), ("t", "R1", "C1", 0.5), ("t", "R1", "C3", 0.0), ("t", "R2", "C1", 0.0), ("t", "R2", "C3", 0.1), ("u", "R1", "C2", 0.9)]
    assert "LeftAnti" not in done._jdf.queryExecution().executedPlan().toString()


def test_class_vectors_without_writing_elements(inputs):
    from linkloom.plans import runner

    sets = techniques.element_techniques()
    vectors = runner.class_vectors(inputs.code, sets, inputs.word_vec)
    old = {}
    tokens = runner.element_tokens(inputs.code, sets).withColumn("doc", F.concat_ws("|", "technique", "code"))
    plain = features.word_mean(tokens.filter("technique not like 'tfidf%'"), inputs.word_vec, ["technique", "code", "elem"])
    w = tokens.filter("technique like 'tfidf%'")
    weighted = features.weighted_word_mean(w, inputs.word_vec, features.tfidf(w, "doc"), ["technique", "code", "elem", "doc"], "doc").drop("doc")
    for r in runner.file_vectors(plain.unionByName(weighted)).collect():
        old[r.technique, r.code] = (r.elements, [round(x, 9) for x in r.vec])
    assert {(r.technique, r.code): (r.elements, [round(x, 9) for x in r.vec]) for r in vectors.collect()} == old
    assert "Aggregate" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_techniques_take_all_requirements(spark, small):
    import duckdb

    from linkloom import technique_queries

    n = duckdb.sql(f"SELECT count(*) FROM (SELECT DISTINCT req_id, req_filename FROM '{small}/issue_entry.parquet' WHERE req_filename IS NOT NULL AND req_text IS NOT NULL)").fetchall()[0][0]
    assert technique_queries.inputs(spark, small).reqs.count() == n


@pytest.mark.parametrize("score", ["mean_cosine", "relaxed_wmd", "word_cosine"])
def test_best_requirements_against_all_pairs(spark, inputs, monkeypatch, score):
    from linkloom.operators import nearest
    from linkloom.plans import runner

    monkeypatch.setattr(nearest, "blocks", lambda t, key, n: similarity.blocks(t, key, 2))
    words = nearest.Vocabulary(inputs.word_vec)
    bags, parts = runner.code_bags(inputs.code, "element", "cls+m+c"), runner.requirement_parts(inputs, "S")
    elements, distinct = nearest.word_bags(bags, ["code", "elem"], words)
    best = nearest.best_requirements(distinct, nearest.part_bags(parts, words), words, score).join(elements, "bag")
    want = L.top_n_votes(L.reduce_requirements(runner.scored(bags, parts, inputs.word_vec, score), "max"), 1)
    plain = lambda df: sorted((r.code, r.elem, r.req, round(r.sim, 9)) for r in df.collect())
    assert plain(best) == plain(want)


def test_nearest_by_exact_distance_writes_no_pairs(spark, monkeypatch):
    from linkloom.operators import nearest

    monkeypatch.setattr(similarity, "wmd_all", None)
    monkeypatch.setattr(nearest, "blocks", lambda t, key, n: similarity.blocks(t, key, 3))
    vec = spark.createDataFrame([(w, [float(i), float(i * i % 5)]) for i, w in enumerate("pqrstu")], "word string, vec array<double>")
    a = spark.createDataFrame([(i, w) for i, ws in enumerate(["pq", "q", "pq", "rst", "u", "st", "tt", "x"]) for w in ws], "a long, word string")
    b = spark.createDataFrame([(i, w) for i, ws in enumerate(["p", "stu", "rrq", "x"]) for w in ws], "b long, word string")
    got = {(r.b, r.rank): (r.a, round(r.wmd, 9)) for r in similarity.nearest_by_wmd(a, b, vec, 4).collect()}
    known, text = {r.word: np.array(r.vec) for r in vec.collect()}, lambda t, k: t.groupBy(k).agg(F.collect_list("word")).collect()
    for j, ws in text(b, "b"):
        d = sorted((round(word_movers_distance(x, ws, known), 9), i) for i, x in text(a, "a"))
        assert [got.get((j, k + 1)) for k in range(4)] == [(i, x) if x < math.inf else None for x, i in d[:4]]
