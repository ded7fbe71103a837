import re

from inkmill.operators import reported as V

TEXTS = [
    "p < .050, P-value of 0.05 and p = 5 × 10⁻⁸; p=5e-8 (p ≤ 0.1) p of 12 patients", "n = 1,234 and N=1234; n = 12.5, n = 00012, n = 9007199254740993", "AUC = 12.3 AUROC was 0.91 auc of 12 patients, AUC: 9%",
    "a -12.5% drop, 12.50 % more, x1.5%", "95% CI [0.10, 0.2], CI: -0.5--0.1 (CI 1 to 2)", "R² = 0.80; R^2 of -1e-2; r = 0.8", "2-fold and 2.0 fold, threefold", "GSE123, gse123, PRJNA5 zenodo.77", "v1.2.3 and version 1.2.3 ver. 2.0", "", None, "p = 5 \\times 10^{-8}",
]


def brute(text):
    out = set()
    for label, pattern in V.LABELS:
        for m in re.finditer(pattern, text or ""):
            out.add((label, m[0] if label == "CI" else m[1]))
    return out


def test_values(spark):
    df = spark.createDataFrame([(i % 3, i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, line long, raw string, key string")
    found = V.reported_values(df)
    rows = found.collect()
    assert {(r.line, r.label, r.value) for r in rows} == {(i, *x) for i, t in enumerate(TEXTS) for x in brute(t)}
    keys = {(r.line, r.value): r.key for r in rows}
    assert keys[0, ".050"] == keys[0, "0.05"].replace("0.05", "<0.05") and keys[0, "5 × 10⁻⁸"] == keys[0, "5e-8"] == keys[11, "5 \\times 10^{-8}"]
    assert keys[1, "1,234"] == keys[1, "1234"] == "1234" and keys[1, "00012"] == "12" and keys[1, "9007199254740993"] == "9007199254740993"
    assert keys[3, "12.50"] == "12.5" and keys[3, "-12.5"] == "-12.5" and keys[2, "9%"] == "9%" and keys[7, "gse123"] == keys[7, "GSE123"]
    assert {r.key for r in rows if r.label == "CI"} == {"0.1..0.2", "-0.5..-0.1", "1.0..2.0"}
    inventory = {(r.label, r.key): (r.n, r.places) for r in V.value_inventory(found).collect()}
    assert inventory["n", "1234"] == (2, "1:1") and inventory["accession", "gse123"] == (2, "1:7")
    assert {(r.doc_id, r.label) for r in V.value_divergence(found).collect()} >= {(1, "n"), (0, "p-value"), (2, "AUC"), (0, "percentage")}
    assert V.reported_values(df.limit(0)).count() == 0


def test_values_of_the_query_lines(spark):
    import collections

    from inkmill.plans import claim_queries as Q

    lines = Q.claims(spark, "/root/testdata/sf0.001").selectExpr("doc_id", "line", f"{Q._REPORTED} AS raw").collect()
    want = collections.Counter((r.doc_id, r.line, label, m[0] if label == "CI" else m[1]) for r in lines for label, pattern in V.LABELS for m in re.finditer(pattern, r.raw))
    got = collections.Counter((r.doc_id, r.line, r.label, r.value) for r in Q.reported(spark, "/root/testdata/sf0.001").collect())
    assert got == want and len({k[2] for k in want}) == 9
    assert sum(r.n for r in Q.QUERIES["reported_values"](spark, "/root/testdata/sf0.001").collect()) == sum(want.values())


def test_inventory_lists_the_first_places(spark):
    from inkmill.operators.claims import inventory

    rows = [(d, line, "k", 1.5) for d in (3, 1, 2) for line in (9, 4, 4, 7)] + [(5, 1, "k", None), (None, 2, "m", 2.0), (4, 1, "m", 2.0)]
    found = spark.createDataFrame(rows, "doc_id long, line int, label string, number double")
    got = {(r.label, r.number): (r.n, r.n_docs, r.places) for r in inventory(found.where("number IS NOT NULL"), ["label", "number"], 5).collect()}
    assert got == {("k", 1.5): (12, 3, "1:4 1:7 1:9 2:4 2:7"), ("m", 2.0): (2, 1, "2 4:1")}
