import random

import numpy as np
from inkmill.operators import matching as M


def alike(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b))


def defects(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        own = [f"w{j}" for j in range(rng.choice([7, 10, 12, 40]))]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = rng.choice(["z", "é\x00", "Ω"]) + str(rng.randint(0, 4))
        out.append((i, rng.choice(["a", "a", "b"]), rng.choice(["x", "x", None]), 1, rng.sample(sorted(set(own)), len(set(own))), rng.choice([None, None, "d", "e"])))
    return out + [(n + i, "a", "x", 1, [f"v{j}" for j in range(9)], None) for i in range(23)]


def test_blocks_of_many_parts_and_sets_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 8)
    monkeypatch.setattr(M, "COPIES", 4)
    rows = defects(150, 5)
    want = {
        (a[0], b[0], 1, round(alike(a[4], b[4]), 9)) for a in rows for b in rows
        if a[0] < b[0] and a[1:3] == b[1:3] and (a[5] is None or b[5] is None or a[5] == b[5]) and min(len(a[4]), len(b[4])) >= 7 and alike(a[4], b[4]) >= 0.8
    }
    df = spark.createDataFrame(rows, "id long, class string, severity string, line int, words array<string>, document string")
    found = M.near_defects(df)
    got = [(r.id_a, r.id_b, r.line, round(r.similarity, 9)) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) > 23 * 22 // 2


def test_pairs_are_not_shuffled(spark):
    from inkmill.plans.match_queries import QUERIES

    plan = QUERIES["near_defects"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Join" not in above  # from where pairs are found to the result
    assert "hashpartitioning(doc_id" not in plan  # lines are not joined with their documents


def test_sets_meet_in_pieces(monkeypatch):
    monkeypatch.setattr(M, "AT_ONCE", 16)
    monkeypatch.setattr(M, "COUNTED", 5)
    rng = random.Random(1)
    sets = [sorted(rng.sample(range(14), rng.randint(1, 12))) for _ in range(300)]
    block = np.array([rng.randint(0, 1) for _ in sets])
    apart = np.array([rng.randint(-1, 1) for _ in sets])
    own, size = np.array([w for x in sets for w in x]), np.array([len(x) for x in sets])
    want = {
        (i, j, alike(a, b)) for j, b in enumerate(sets) for i, a in enumerate(sets[:j])
        if block[i] == block[j] and (apart[i] == apart[j] or min(apart[i], apart[j]) < 0) and alike(a, b) >= 0.8
    }
    home = np.ones(len(sets), bool)
    parts = [[(int(i), int(j), float(s)) for x in M._near_sets(block, own, size, apart, home, own % 3 == p, 0.8) for i, j, s in zip(*x)] for p in range(3)]
    got = [x for part in parts for x in part]
    assert set(got) == want and len(got) == len(want) > 20
