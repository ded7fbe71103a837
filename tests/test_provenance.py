from pyspark.sql import functions as F

from inkmill.operators import provenance as V

CELLS = "file string, row int, label string, column string, place int, cell string"


def test_provenance_needs_number_row_and_context(spark):
    age = [("ages.csv", i, f"{who} cohort", "Age_years", 1, str(n)) for i, (who, n) in enumerate([("control", 40), ("treated adult", 42), ("treated child", 9), ("other", 42)])]
    cells = spark.createDataFrame([*age, *(("x.csv", i, None, "plot", 1, str(i)) for i in range(4)), ("p.csv", 0, "a", "ages", 1, "42%"), ("p.csv", 1, "a", "ages", 1, None)], CELLS)
    said = [
        "The treated adult age was 42 years", "The control cohort age was 42 years", "The age was 42", "The ages sum to 133", "The mean age was 133", "An age [42] differs", "See ^42^ for the age",
        "Nothing about 42", None, "", "The plots went to 3", "The age of treated people was 9",
    ]
    number = ["42", "42", "42", "133", "133", "42", "42", "42", "133", "42", "3", "9"]
    rows = spark.createDataFrame([(i, n, "body", t, "x") for i, (n, t) in enumerate(zip(number, said))] + [(90, "42", "Heading", "The age was 42", "x"), (91, None, None, None, None), (92, "no", "", "The age was no", "")], "id long, number string, kind string, sentence string, file string")
    got = {r.id: (r.file, r.proof, r.label) if r.file else None for r in V.provenance(rows, cells).collect()}
    cell, total = lambda label: ("ages.csv", "cell", label), ("ages.csv", "sum", "")
    assert got == {
        0: cell("treated adult cohort"), 1: ("ages.csv", "max", ""), 2: cell("treated adult cohort"), 3: total, 4: None, 5: None, 6: None, 7: None, 8: total, 9: ("ages.csv", "max", ""),
        10: ("x.csv", "cell", ""), 11: cell("treated child cohort"), 90: None, 91: None, 92: None,
    }
    assert V.provenance(rows.limit(0), cells).count() == 0
    assert V.provenance(rows, cells.limit(0)).where("file IS NOT NULL").count() == 0


def test_denials_need_the_token_before_them(spark):
    runs = [("a.csv", i, "", c, p, v) for i in range(4) for c, p, v in (("caller", 1, "scyn"), ("panel", 2, ["ACT", "MCB"][i % 2]))]
    runs += [("b.csv", i, "", c, p, v) for i in range(4) for c, p, v in (("caller", 1, "SCYN"), ("panel", 2, ["germ", "soma"][i % 2]))]
    texts = [
        (1, 1, "On germ data SCYN could  not be run."), (1, 2, "Samples were excluded before the SCYN caller ran."), (1, 3, "Samples of ACT were excluded."), (1, 4, "ACT was not run."),
        (1, 5, "On germ data SCYN could not be run. It was late."), (2, 1, None), (2, 2, "scyn2 was not run"),
    ]
    rows = V.negative_claims(spark.createDataFrame(texts, "doc_id long, line long, raw string"), spark.createDataFrame(runs, CELLS))
    got = sorted((r.line, r.place, r.token, r.source[-5:]) for r in rows.collect())
    assert got == [(1, 1, "scyn", "b.csv"), (1, 2, "germ", "b.csv"), (1, 3, "scyn", "a.csv"), (4, 1, "act", "a.csv"), (5, 1, "scyn", "b.csv"), (5, 2, "germ", "b.csv"), (5, 3, "scyn", "a.csv")]


def test_equal_claims_of_a_document_stay_once(spark):
    rows = [(1, 5, 0, "c", 3, False), (1, 2, 1, "c", 3, False), (1, 2, 0, "c", 3, True), (2, 2**40, 7, "c", 3, False), (1, -4, 2, "d", 3, False), (1, 0, 0, "d", 3, False), (None, 1, 0, "c", 3, False)]
    got = V.first_copies(spark.createDataFrame(rows, "doc_id long, line long, nth int, claim string, at int, method_only boolean"))
    assert {tuple(r) for r in got.collect()} == {(1, 2, 1, "c", 3, False), (1, 2, 0, "c", 3, True), (2, 2**40, 7, "c", 3, False), (1, -4, 2, "d", 3, False), (None, 1, 0, "c", 3, False)}
    assert got.schema["line"].dataType.simpleString() == "bigint"


def test_sentences_are_read_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def said(text):
        calls.add(1)
        return text

    cells = spark.createDataFrame([("sizes.csv", i, n, "Size", 1, str(i)) for i, n in enumerate(("red bolt", "blue bolt", "old ring"))], CELLS)
    numbers = spark.createDataFrame([(i, str(i % 4), "body", f"The size of the {c} was {i % 4}") for i, c in enumerate(("red bolt", "blue bolt", "ring", "hat") * 3)], "id long, number string, kind string, sentence string")
    got = V.provenance(numbers.withColumn("sentence", F.udf(said, "string")("sentence")), cells).where("proof = 'cell'").select("id", "label").collect()
    assert {r.id: r.label for r in got} == {i: ("red bolt", "blue bolt", "old ring")[i % 4] for i in range(12) if i % 4 < 3}
    assert calls.value == 12
