"""Work that grows with the tables, not with products of copies in them."""

import random
from urllib.parse import quote

from pyspark.sql import functions as F

from lodeline.functions import identity
from lodeline.operators import ownership, resolution
from lodeline.plans import catalog

DEPENDENCY = "dependency string, owner long, name string, alias string, constraint string, repository string"
CHILD = "parent long, child string, child_name string, version string, folder string, hidden boolean"


def most_rows(spark):
    """The most rows that a step of the last query gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1)
    values, metrics = store.executionMetrics(last.executionId()), last.metrics()
    found = [values.get(m.accumulatorId()) for m in (metrics.apply(i) for i in range(metrics.size())) if m.name() == "number of output rows"]
    return max(int(v.get().replace(",", "")) for v in found if v.isDefined())


def pairwise(dependencies, children):
    """The same by all pairs; versions are single numbers, constraints ">= n"."""
    known = [(p, ch, n, v, f) for p, ch, n, v, f, hidden in children if not hidden and ch is not None]
    out = {}
    for dep in {d[0] for d in dependencies if d[0]}:
        fits, misfits = [], set()
        for _, owner, name, alias, constraint, _ in (d for d in dependencies if d[0] == dep):
            for p, ch, n, v, f in known:
                if owner is None or p != owner:
                    continue
                ok = constraint is not None and v is not None and int(v) >= int(constraint[3:])
                if name is not None and n == name:
                    fits += [ch] * ok
                    misfits |= set() if ok else {ch}
                if f is not None and f in (name, alias) and not (ok and n == name):
                    misfits.add(ch)
        out[dep] = (len(fits), fits[0] if len(fits) == 1 else None, sorted(set(fits)), len(misfits))
    return out


def test_dependency_targets_by_pairs(spark):
    rng = random.Random(5)
    some = lambda *x: rng.choice([*x, None])
    dependencies = [(f"d{rng.randint(0, 50)}", some(1, 2), some("a", "b", "c"), some("a", "x"), some(">= 1", ">= 3"), None) for _ in range(70)] + [("e", 1, "a", "a", ">= 1", None)] * 2 + [(None, 1, "a", None, ">= 1", None)]
    children = [(some(1, 2), some(*(f"c{i}" for i in range(25))), some("a", "b", "c"), some("0", "2", "4"), some("a", "b", "x"), rng.random() < 0.1) for _ in range(60)]
    children += [(1, f"s{i}", "a", "2", "x", False) for i in range(3)]
    got = {r.dependency: (r.candidates, r.chart, r.candidate_charts or [], r.incompatible) for r in resolution.dependency_targets(spark.createDataFrame(dependencies, DEPENDENCY), spark.createDataFrame(children, CHILD), listed=True).collect() if r.dependency}
    assert got == pairwise(dependencies, children)


def test_dependencies_and_children_alike_are_not_paired(spark):
    n = 1500
    d = spark.range(n).select(F.concat(F.lit("d"), "id").alias("dependency"), F.lit(1).alias("owner"), F.lit("a").alias("name"), F.lit("x").alias("alias"), F.lit(">= 1").alias("constraint"), F.lit(None).cast("string").alias("repository"))
    c = spark.range(n).select(F.lit(1).alias("parent"), F.concat(F.lit("c"), "id").alias("child"), F.lit("a").alias("child_name"), (F.col("id") % 2).cast("string").alias("version"), F.lit("x").alias("folder"), F.lit(False).alias("hidden"))
    rows = resolution.dependency_targets(d, c).collect()
    assert len(rows) == n and {(r.candidates, r.incompatible, r.status) for r in rows} == {(n // 2, n // 2, "ambiguous")}
    assert most_rows(spark) < 10 * n


def test_ways_are_those_of_the_walk(spark):
    """Circles, a loop, edges that are there twice, a root that is there twice or nowhere, nodes below circles."""
    rng = random.Random(3)
    for pairs in ([(rng.randint(0, 6), rng.randint(0, 9)) for _ in range(16)], [(i // 2, i) for i in range(1, 30)] + [(i // 3, i) for i in range(1, 30)] + [(3, 3)], [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (3, 4), (None, 5), (4, None)]):
        edges = spark.createDataFrame(pairs, "parent int, child int")
        roots = spark.createDataFrame([(0,), (2,), (2,), (77,), (None,)], "root long")
        expected = ownership.walk(edges, roots).groupBy("root", "node", "depth").agg(F.count("*").alias("ways"))
        got = ownership.ways(edges, roots)
        assert got.schema.simpleString() == expected.schema.simpleString()
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    assert ownership.ways(edges, roots.limit(0)).count() == 0


def test_more_ways_than_could_be_listed(spark):
    """Every step doubles the ways."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] * 2, "parent long, child long")
    rows = ownership.ways(edges, spark.createDataFrame([(0,)], "root long")).collect()
    assert {(r.node, r.depth): r.ways for r in rows} == {(i, i): 2**i for i in range(21)}


def test_segments_of_every_character(spark):
    texts = ["".join(map(chr, range(256))), "a+b *~%7E%2A%20+", "", "x.y_z-~", "\u2028日本\U0001f600", None] + [chr(i) for i in range(128)]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", identity.encode_segment(F.col("s")).alias("e")).collect()
    assert [r.e for r in rows] == [None if r.s is None else quote(r.s, safe="~") for r in rows]


def test_whole_texts_are_not_taken_apart(spark):
    """No array with an item for each byte of a text."""
    df = spark.createDataFrame([("x y",)], "s string").select(identity.config_key_id(F.col("s"), identity.encode_value_segment(F.col("s"))).alias("e"))
    assert df.first().e == "x y@key/x%2520y" and "transform" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_configurations_are_parsed_once(spark):
    """What asks for keys reads a table of them."""
    df = catalog.QUERIES["configured_profiles"](spark, "/root/testdata/sf0.001")
    assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()


def test_possible_winners_shuffle_once(spark):
    """One shuffle by tree; a name without a place isn't there, and neither is what a tree without a file says of another."""
    source = "tree long, file string, source long, group string, alternative string"
    sources = spark.createDataFrame([(1, "a", 1, None, None), (1, "b", 2, "g", "x"), (2, "a", 1, None, None)], source)
    said = [(1, "a", 1, None, None, "n", "t1", 0, False), (1, "b", 2, "g", "x", "n", "t2", 0, False), (1, "c", 3, None, None, "lost", "t3", 0, False), (2, "a", 1, None, None, "n", "t4", 0, False)]
    said += [(2, None, 9, None, None, "m", "t5", i, False) for i in range(2)]
    definitions = spark.createDataFrame(said, f"{source}, name string, target string, start int, empty boolean")
    df = resolution.possible_winners(sources, definitions, spark.createDataFrame([(1, "g", 2)], "tree long, group string, alternatives int"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [tuple(r) for r in df.collect()] == [(1, "n", "t1", 1, False)]
