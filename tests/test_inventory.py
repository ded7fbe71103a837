from inkmill.operators import claims as C
from inkmill.operators import reported as V


def test_keys_are_made_of_spellings(spark):
    from test_reported import TEXTS

    rows = [(d, i, t) for d in (None, 1, 2, 3) for i, t in enumerate(TEXTS * 3)] + [(2, 5, "n = 1,234 and n=1234"), (2, 5, "n = 1,234")]
    lines = spark.createDataFrame(rows, "doc_id long, line long, raw string")
    for shown in (1, 2, 12):
        want = sorted(map(tuple, V.value_inventory(V.reported_values(lines), shown).collect()))
        assert sorted(map(tuple, V.line_inventory(lines, shown).collect())) == want
    first = {}
    for r in V.reported_values(lines).collect():
        first.setdefault((r.label, r.key), set()).add((r.doc_id is not None, r.doc_id or 0, r.line))
    text = lambda p: f"{p[1]}:{p[2]}" if p[0] else str(p[2])
    assert {(x[0], x[1]): x[4] for x in want} == {k: " ".join(map(text, sorted(p)[:12])) for k, p in first.items()}


def test_few_documents_are_read_again(spark, monkeypatch):
    lines = spark.createDataFrame([(d, 1000 * d + i, f"n = {i % 3}") for d in range(40) for i in range(90)], "doc_id long, line long, raw string")
    read, find = [], V.spelled_values

    def watched(some):
        read.append({r.doc_id for r in some.select("doc_id").distinct().collect()})
        return find(some)

    monkeypatch.setattr(V, "spelled_values", watched)
    got = {r.key: (r.n, r.n_docs, r.places) for r in V.line_inventory(lines).collect()}
    assert got["1"] == (1200, 40, " ".join(f"0:{i}" for i in range(1, 36, 3)))
    assert read == [set(range(40)), {0}]
