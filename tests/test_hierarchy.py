import random

from skein.operators import hierarchy as H

SCHEMA = "source_id string, target_id string"


def brute(pairs):
    parent = {}
    for s, t in pairs:
        if s is not None and t is not None:
            parent[t] = min(parent.get(t, s), s)
    out = {}
    for x in {*parent, *parent.values()}:
        path, seen = [x], {x}
        while path[-1] in parent and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        if path[-1] not in parent:
            out[x] = ("tree", path[-1], len(path) - 1, path[::-1])
            continue
        loop = path[path.index(parent[path[-1]]) :]
        out[x] = ("loop" if x in loop else "below_loop", min(loop), -1, None)
    return out


def check(spark, pairs):
    df = spark.createDataFrame(pairs, SCHEMA)
    got = {r["id"]: (r["state"], r["root_id"], r["depth"], r["path"]) for r in H.hierarchy(df, "target_id", "source_id", paths=True).collect()}
    assert got == brute(pairs)
    return df


def test_chain_branches_loops_and_dirt(spark):
    pairs = [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)]
    pairs += [("c10", "x"), ("x", "y"), ("c10", "z"), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("l2", "under"), ("under", "deeper"), ("self", "self"), ("self", "kid"), ("p", "q"), ("p", "q"), (None, "q"), ("p", None)]
    df = check(spark, pairs)
    deep = {(r["id"], r["root_id"], r["depth"]) for r in H.deep_or_looped(df, "target_id", "source_id", 12).collect()}
    assert ("c12", "c00", 12) in deep and ("c11", "c00", 11) not in deep
    assert {("l1", "l1", -1), ("l2", "l1", -1), ("l3", "l1", -1), ("self", "self", -1)} <= deep
    assert not {d[0] for d in deep} & {"under", "kid", "deeper"}
    assert H.descendants(H.hierarchy(df, "target_id", "source_id", paths=True)).filter("ancestor_id = 'c10'").count() == 33


def test_random_forests_and_loops(spark):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(120)]
    check(spark, [(rng.choice(ids), x) for x in ids if rng.random() < 0.93])


def test_empty_and_wide(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert H.hierarchy(df, "target_id", "source_id").count() == 0
    check(spark, [("hub", f"k{i}") for i in range(300)])


def test_a_parent_of_half_of_the_rows(spark):
    """The hub is hot in every round: it has leaves, chains and subtrees below it, and hangs deep itself."""
    pairs = [(f"top{i}", f"top{i + 1}") for i in range(6)] + [("top6", "hub")]
    pairs += [("hub", f"k{i}") for i in range(300)] + [(f"k{i}", f"m{i}") for i in range(0, 300, 3)] + [(f"m{i}", f"e{i}") for i in range(0, 300, 9)] + [("e0", "x0"), *((f"x{i}", f"x{i + 1}") for i in range(30))]
    check(spark, pairs)


def test_compressing_in_every_round_gives_the_same(spark):
    rng = random.Random(8)
    ids = [f"n{i}" for i in range(150)]
    pairs = [(rng.choice(ids), x) for x in ids if rng.random() < 0.95] + [(f"c{i}", f"c{i + 1}") for i in range(25)]
    df = spark.createDataFrame(pairs, SCHEMA)
    one = {tuple(r) for r in H.hierarchy(df, "target_id", "source_id").collect()}
    assert one == {tuple(r) for r in H.hierarchy(df, "target_id", "source_id", always=True).collect()}
