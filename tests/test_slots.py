import random
import re

from inkmill.operators.slots import remapped_ids, sheet_tabs


def brute_remap(rows, existing, blocks=((901, 999), (9001, 9999))):
    used, out = {str(i).strip() for i in existing if i and str(i).strip()}, []
    for i in rows:
        own = (i or "").strip()
        if not re.match(r"^X-(?:9\d{2}|9\d{3})$", own) or own in used:
            own = next((f"X-{k:03d}" for a, b in blocks for k in range(a, b + 1) if f"X-{k:03d}" not in used), None)
        used.add(own)
        out.append(own)
    return out


def test_ids_move_to_the_first_free_numbers(spark):
    rng = random.Random(8)
    groups = {
        g: ([rng.choice([f"X-{rng.randint(899, 930)}", "F-1", None, "", f"X-{rng.randint(9000, 9010)}", " X-905 ", "X-012"]) for _ in range(n)], [rng.choice([f"X-{rng.randint(900, 925)}", "F-1", None]) for _ in range(m)])
        for g, (n, m) in enumerate([(60, 10), (40, 0), (150, 40), (0, 5), (1, 1), (5, 0)])
    }
    groups[9] = (["X-903", "X-904", "X-905", "a", "b", "X-901", "X-902", "X-903"], ["X-901"])
    groups[10] = (["a"] * 1110 + ["X-950", "X-900"], [])
    rows = spark.createDataFrame([(g, n, i, "z") for g, (ids, _) in groups.items() for n, i in enumerate(ids)], "grp long, ord long, id string, number string")
    existing = spark.createDataFrame([(g, i) for g, (_, ids) in groups.items() for i in ids], "grp long, id string")
    got = {(r.grp, r.ord): r.new_id for r in remapped_ids(rows, existing).collect()}
    assert got == {(g, n): i for g, (ids, held) in groups.items() for n, i in enumerate(brute_remap(ids, held))}
    assert remapped_ids(rows.limit(0), existing).count() == 0


def test_tabs_are_unique_in_a_book(spark):
    runs = [("run", "1"), ("Run", "01"), ("run", "1"), ("a/b:c", "all"), ("x" * 40, "2"), ("X" * 33, "2"), ("", "r/1"), (None, None), ("run~2", "1"), ("s", "y" * 40), ("s", "y" * 41)]
    df = spark.createDataFrame([("b", i, *r) for i, r in enumerate(runs)] + [("c", 0, "run", "1")], "book string, ord int, stem string, round string")
    got = {(r.book, r.ord): r.tab for r in sheet_tabs(df).collect()}
    tabs = [got["b", i] for i in range(len(runs))]
    assert tabs[:8] == ["run_r1", "Run~2_r1", "run~3_r1", "a_b_c_all", "x" * 28 + "_r2"[:3], "X" * 26 + "~2_r2", "run_r_1", "run_"]
    assert tabs[8] == "run~2~2_r1" and got["c", 0] == "run_r1"
    assert len({t.lower() for t in tabs}) == len(tabs) and max(map(len, tabs)) <= 31
