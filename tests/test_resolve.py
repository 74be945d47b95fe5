import random

from claimloom.functions.normalize import key, key_column, tokens
from claimloom.functions import similarity as s
from claimloom.operators import resolve
from claimloom.operators.components import components


def table(a, b):
    lev = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        lev.append([i])
        for j, y in enumerate(b, 1):
            lev[i].append(min(lev[i - 1][j] + 1, lev[i][j - 1] + 1, lev[i - 1][j - 1] + (x != y)))
    return lev


def brute_minimum(a, b):
    lev = table(a, b)
    t, u = tokens(a), tokens(b)
    return min(brute_scores(a, b, lev, t, u))


def brute_greatest(a, b):
    t, u = tokens(a), tokens(b)
    return max(brute_scores(a, b, table(a, b), t, u))


def brute_scores(a, b, lev, t, u):
    scores = [1 - lev[-1][-1] / max(len(a), len(b), 1), s.jaro_winkler(a, b), s.token_sort_ratio(a, b), s.token_set_ratio(a, b), len(t & u) / len(t | u) if t | u else 0.0]
    if min(len(a), len(b)) < 4:
        scores = [min(x, 0.95) for x in scores]
    return scores


def test_fuzzy_equals_all_pairs(spark):
    rng = random.Random(1)
    base = ["blue river", "northern light", "blue river capital partners europe", "northern light software", "a b acme robotics", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"]
    names = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice("abc ")
            names.append(" ".join("".join(w).split()))
    names += ["the " + b for b in base] + ["", "x"]
    cands = spark.createDataFrame([(i, "Startup", n) for i, n in enumerate(names)], "cand_id long, entity_type string, key string")
    index = spark.createDataFrame([("Startup", b, f"e{i}") for i, b in enumerate(base)], "entity_type string, key string, entity_id string")
    got = {r.cand_id: r.entity_id for r in resolve.fuzzy(cands, index).collect()}
    for i, n in enumerate(names):
        # the greatest similarity decides who is asked, the first of equals; the least decides the answer
        k = max(range(len(base)), key=lambda k: (brute_greatest(n, base[k]), -k))
        assert got.get(i) == (f"e{k}" if brute_minimum(n, base[k]) >= 0.95 else None), n


def test_resolution_of_a_batch(spark):
    entities = spark.createDataFrame([("startup:acme", "Startup", "Acme GmbH", "Acme", ["Acme AI"])], "id string, label string, name string, canonical_name string, aliases array<string>")
    index = resolve.registry(entities, key_column)
    cands = spark.createDataFrame([(1, 1, "Startup", "ACME", []), (2, 2, "Startup", "Foo Bar", []), (3, 3, "Startup", "foo bar GmbH", []), (4, 4, "Startup", "Bar Foo", ["Zed"]), (5, 5, "Startup", "zed", None), (6, 6, "Company", "Acme", [])], "cand_id long, seq long, entity_type string, name string, aliases array<string>")
    got = {r.cand_id: (r.entity_id, r.method) for r in resolve.resolve(cands, index, key_column).collect()}
    assert got[1] == ("startup:acme", "exact")
    assert {got[i][0] for i in (2, 3, 4, 5)} == {"startup:foo-bar"} and got[2][1] == "new"
    assert got[6] == ("company:acme", "new")


def test_blocked_matches_go_to_the_next_key(spark):
    index = spark.createDataFrame([("Startup", "acme", "e1"), ("Startup", "acme ai", "e2")], "entity_type string, key string, entity_id string")
    cands = spark.createDataFrame([(1, "Startup", ["acme", "acme ai"])], "cand_id long, entity_type string, keys array<string>")
    blocked = spark.createDataFrame([(1, "e1")], "cand_id long, entity_id string")
    assert resolve.exact(cands, index, blocked).first().entity_id == "e2"
    assert resolve.exact(cands, index).first().entity_id == "e1"


def test_graph_guard(spark):
    cands = spark.createDataFrame([(1, "acme"), (2, "abc")], "cand_id long, key string")
    names = spark.createDataFrame([("n1", "acme robotics"), ("n2", "abc def")], "node_id string, key string")
    edges = spark.createDataFrame([("n1", "e1"), ("n2", "e2")], "a string, b string")
    assert [(r.cand_id, r.entity_id) for r in resolve.blocked_by_graph(cands, names, edges).collect()] == [(1, "e1")]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in root)


def brute_nearest(rows, queries, k, threshold, excluded=()):
    """rows: id, type, vector or None; queries the same."""
    import numpy as np

    def unit(v):
        ok = v is not None and len(v) == 8 and all(x is not None for x in v) and np.isfinite(v).all() and np.linalg.norm(v) > 0
        return np.asarray(v) / np.linalg.norm(v) if ok else None

    out = {}
    for q, t, v in queries:
        a = unit(v)
        if a is None:
            continue
        near = sorted((-round(float(a @ unit(w)), 12), e) for e, kind, w in rows if kind == t and unit(w) is not None)[:k]
        near = [(e, (1 - c) / 2) for c, e in near if (q, e) not in excluded and (1 - c) / 2 >= threshold]
        if near:
            out[q] = near[0]
    return out


def test_nearest_by_cells_equals_all_pairs(spark):
    """Clusters, ties, copies, an overfull cell in several blocks, types, vectors that can't be compared."""
    import numpy as np

    from claimloom.operators import vectors

    rng = np.random.default_rng(0)
    centers = rng.normal(size=(6, 8))
    rows = [(i, "ab"[i % 2], (centers[i % 6] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(1000 + i, "a", rows[0][2]) for i in range(40)] + [(2000 + i, "b", rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(3000, "a", None), (3001, "a", [0.0] * 8), (3002, "a", [1.0]), (3003, "a", [float("nan")] * 8), (3004, "a", [None] + [1.0] * 7), ((1 << 60) + 1, "c", [1.0] * 8)]
    queries = [(i, t, v) for i, t, v in rows if i % 7 == 0 or i >= 3000] + [(5000, "c", [1.0] * 8), (5001, "none", [1.0] * 8)]
    df = spark.createDataFrame(rows, "entity_id long, entity_type string, vector array<double>")
    q = spark.createDataFrame(queries, "cand_id long, entity_type string, vector array<double>")
    own = {(i, i) for i, _, _ in queries}
    for k, threshold, cells, block in ((3, 0.5, 12, 16), (5, 0.9, 3, 7), (1, 0.0, 40, 1000), (50, 0.6, 1, 32)):
        vectors.BLOCK, vectors.ASKED = block, 5
        try:
            placed = vectors.placed_in_cells(df, cells)
            got = {r.cand_id: (r.entity_id, r.score) for r in resolve.nearest(q, placed, k, threshold, excluded=q.selectExpr("cand_id", "cand_id as entity_id")).collect()}
        finally:
            vectors.BLOCK, vectors.ASKED = 1024, 256
        want = brute_nearest(rows, queries, k, threshold, own)
        assert {i: e for i, (e, _) in got.items()} == {i: e for i, (e, _) in want.items()}, (k, cells)
        assert all(abs(got[i][1] - s) < 1e-9 for i, (_, s) in want.items())


def test_nearest_prunes_cells_and_reads_entities_once(spark):
    import numpy as np

    from claimloom.operators import vectors

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16)) * 5
    df = spark.createDataFrame([(i, (centers[i % 20] + rng.normal(0, 0.1, 16)).tolist()) for i in range(1000)], "entity_id long, vector array<double>")
    placed = vectors.placed_in_cells(df, 20)
    q = df.limit(50).selectExpr("'' as kind", "entity_id as cand_id", "vector", "cast(null as double) as bound")
    asked = vectors._asking(q, placed, 5, 2.0, False)
    assert asked.count() < 200  # of 1,000 pairs of a query and a cell
    plan = vectors.k_nearest(q.select("cand_id", "vector"), placed, 5, 0.5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "entity_id long, vector array<double>")
    one = spark.createDataFrame([(1, [1.0, 0.0])], "cand_id long, vector array<double>")
    assert resolve.nearest(one, none).collect() == []
    assert resolve.nearest(one.where("false"), one.selectExpr("cand_id as entity_id", "vector")).collect() == []


def test_merged_entities(spark):
    resolved = spark.createDataFrame([(i, "e") for i in range(8)], "cand_id long, entity_id string")
    mentions = spark.createDataFrame([(i, i, "Startup", n, st, d) for i, (n, st, d) in enumerate([("Acme", "attributed", "d0"), ("ACME", "stated", "d1"), ("Acme AI", "attributed", "d2"), ("Acme", "attributed", "d0"), ("Acme", "attributed", "d3"), ("Acme", "attributed", "d4"), ("Acme", "attributed", "d5"), ("Acme", "attributed", None)])], "cand_id long, seq long, entity_type string, name string, evidence_status string, description string")
    r = resolve.merged_entities(resolved, mentions, key_column).first()
    assert (r.canonical_name, r.aliases, r.evidence_status, r.descriptions) == ("Acme", ["Acme AI"], "stated", ["d0", "d1", "d2", "d3", "d4"])
    assert key("Acme AI", "Startup") == "acme ai"


def test_names_within_names(spark):
    rng = random.Random(2)
    words = "red blue green north south labs works data".split()
    keys = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    index = spark.createDataFrame([("Startup", k, f"e{k}") for k in keys] + [("Company", "red", "x")], "entity_type string, key string, entity_id string")
    cands = spark.createDataFrame([(i, "Startup", k) for i, k in enumerate(keys)] + [(999, "Startup", "red unheard")], "cand_id long, entity_type string, key string")
    got = {(r.a, r.b) for r in resolve.nested(cands, index).collect()}
    want = {(a, b) for a in [*keys, "red unheard"] for b in keys if set(a.split()) <= set(b.split()) or set(b.split()) <= set(a.split())}
    assert got == want


def test_vectors_decide_what_names_leave_open(spark):
    index = spark.createDataFrame([("Startup", "acme", "startup:acme"), ("Person", "ann", "person:ann"), ("Startup", "zed", "startup:zed")], "entity_type string, key string, entity_id string")
    known = spark.createDataFrame([("startup:acme", "Startup", [1.0, 0.0]), ("person:ann", "Person", [0.0, 1.0]), ("startup:zed", "Startup", [0.9, 0.5])], "entity_id string, entity_type string, vector array<double>")
    cands = spark.createDataFrame([(1, 1, "Startup", "Akme Robotics", []), (2, 2, "Startup", "Other", []), (3, 3, "Startup", "Acme", []), (4, 4, "Startup", "Akme Robots", [])], "cand_id long, seq long, entity_type string, name string, aliases array<string>")
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, [1.0, 0.1])], "cand_id long, vector array<double>")
    blocked = spark.createDataFrame([(4, "startup:acme")], "cand_id long, entity_id string")
    got = {r.cand_id: (r.entity_id, r.method) for r in resolve.resolve(cands, index, key_column, blocked=blocked, vectors=vectors, entity_vectors=known).collect()}
    assert got == {1: ("startup:acme", "embedding"), 2: ("startup:other", "new"), 3: ("startup:acme", "exact"), 4: ("startup:zed", "embedding")}


def test_the_last_entity_of_a_key_has_it(spark):
    entities = spark.createDataFrame([("a", "Topic", "X", "X", [], 2), ("b", "Topic", "X", "X", [], 1)], "id string, label string, name string, canonical_name string, aliases array<string>, seq long")
    assert resolve.registry(entities, key_column).first().entity_id == "a"
    assert resolve.registry(entities.drop("seq"), key_column).first().entity_id == "b"


def test_names_are_compared_once_and_in_many_tasks(spark, monkeypatch):
    """What is made of names is kept before it is read again, and pairs of names are dealt over tasks."""
    taken, told, long = [], [], "northern light software systems of greater europe and beyond n{} qq"
    monkeypatch.setattr(resolve, "PAIRS_A_TASK", 5)
    deal = resolve.dealt
    monkeypatch.setattr(resolve, "dealt", lambda df, key, rows: (taken.append(deal(df, key, rows).rdd.getNumPartitions()), deal(df, key, rows))[1])
    monkeypatch.setattr(resolve, "kept", lambda df, keep=resolve.kept: (told.append(df.columns), keep(df))[1])
    entities = spark.createDataFrame([(f"startup:{i}", "Startup", long.format(i), long.format(i), []) for i in range(20)], "id string, label string, name string, canonical_name string, aliases array<string>")
    cands = spark.createDataFrame([(i, i, "Startup", long.format(i) + " qq", []) for i in range(20)], "cand_id long, seq long, entity_type string, name string, aliases array<string>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = resolve.resolve(cands, resolve.registry(entities, key_column), key_column)
        assert max(taken, default=0) == 4 and len(told) == 4  # keys, the registry, pairs of names, what was matched
        assert {(r.cand_id, r.entity_id) for r in got.collect()} == {(i, f"startup:{i}") for i in range(20)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
