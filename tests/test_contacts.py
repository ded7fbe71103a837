from pyspark.sql import functions as F

from inkmill.operators import contacts as K


def test_addresses_added_removed_and_replaced(spark):
    texts = lambda rows: spark.createDataFrame(rows, "package string, text string")
    before = texts([("p", "A@lab.org, old@lab.org gone@lab.org your@x.org"), ("p", None), ("q", "q@lab.org")])
    after = texts([("p", "a@LAB.org new@lab.org seen@lab.org made@up.org"), ("q", "q@lab.org right@lab.org")])
    evidence = spark.createDataFrame([("write to Seen@lab.org", "x"), (None, "y")], "text string, package string")
    verified = spark.createDataFrame([("p", "OLD@lab.org", "new@lab.org"), ("q", "q@lab.org", "right@lab.org"), ("p", None, None)], "package string, old string, new string")
    got = sorted(map(tuple, K.address_changes(before, after, evidence, verified).collect()))
    assert got == [("p", "gone@lab.org", "removed", "warning"), ("p", "made@up.org", "added", "error"), ("q", "q@lab.org", "superseded", "warning")]


def test_floor_of_adjusted_p(spark):
    rows = ["A single pooled family, Holm.", "a 10 9 0.030 1", "b none 9 0.09 x", "c & 10 & 21 & \\textbf{1.81 \\times 10^{-5}} &", "d 10 21 1.0e-9", "e 10 4 0.0001", "f 10 6 2", None, "g 10 30 1.81 × 10-5"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)] + [(2, i, t) for i, t in enumerate(rows[1:])] + [(3, i, t) for i, t in enumerate([*rows[:3], "family of 19"])], "doc_id long, line long, raw string")
    assert [(r.doc_id, r.line, r.family) for r in K.floor_violations(df).orderBy("line").collect()] == [(1, 4, 6)]
    assert [r[0] for r in spark.createDataFrame([("1.8x10-3",), ("5 \\times 10^{−2}",), ("1e-3",), ("0.5",), ("x",)], "t string").select(K.printed_p(F.col("t"))).collect()] == [0.0018, 0.05, 0.001, 0.5, None]


def test_listings_know_quotes(spark, tmp_path):
    from inkmill.sources import tables

    text = ["junk", '"open', "==> a.csv <==", "m,o", "", '1,"two', "==> not.csv <==", "", 'three",4', '5," x""y", z"', "(base) $ head", "==> b.csv <==", 'p, "q"', None, '"r"s,"t'] + ["==> still text <=="]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, line long, raw string")
    got = [(r.path, r.block, r.nth, r.raw) for r in tables.dump_blocks(df).orderBy("block", "nth").collect()]
    assert got == [("a.csv", 1, i, t) for i, t in enumerate(["m,o", '1,"two', "==> not.csv <==", "", 'three",4', '5," x""y", z"'], 1)] + [("b.csv", 2, i, t) for i, t in enumerate(['p, "q"', '"r"s,"t', "==> still text <=="], 1)]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "other.CSV").write_text("member,opponent_id\na,b\n")
    assert tables.score_files(spark, str(tmp_path)) == tables.ANY_CSV
    (tmp_path / "sub" / "Round12_raw_scores.csv").write_text("x")
    assert tables.score_files(spark, str(tmp_path)) == tables.NAMED_SCORES
