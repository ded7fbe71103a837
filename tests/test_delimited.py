import csv
import random
import re

from inkmill.operators.delimited import table_cells, tables_of


def brute(text):
    raw = re.sub(r"\r\n?", "\n", text or "")
    lines = [x for x in raw.split("\n") if x.strip()]
    if len(lines) < 3:
        return None
    head = lines[0]
    delimiter = "\t" if "\t" in head else "|" if head.count("|") >= 2 else "," if "," in head else None
    if not delimiter:
        return None
    records = [[c.strip() for c in r] for r in csv.reader(raw.splitlines(keepends=True), delimiter=delimiter, skipinitialspace=True)]
    records = [r for r in records if r and r != [""]]
    if delimiter == "|":
        lead, trail = head.strip().startswith("|"), head.strip().endswith("|")
        records = [r[1:] if lead and not r[0] else r for r in records]
        records = [r[:-1] if trail and r and not r[-1] else r for r in records]
    header, body = records[0], records[1:]
    if delimiter == "|" and body and body[0] and all(re.fullmatch(":?-{2,}:?", c) for c in body[0]):
        body = body[1:]
    return (delimiter, header, body) if len(header) >= 2 and body else None


def test_tables(spark):
    rng = random.Random(6)
    texts = [
        "| a | b |\n|---|:--:|\n| 1 | 2 |\n\n| | x |\n", "a,b\r\n\"x, \"\"y\"\"\",2\r\n\"line\nend\" tail , 3\n", "a\tb\n1\t2\n3\t\"open", "a,b\n1,2", "no table\nat all\nhere", None, "", "a|b|c\n--|--|--\n1|2", " , \n,\n,\n", "a, b\n 5\" pipe, \"q\"\n\n\n,",
        "x" * 9 + ",y\n" + ",".join("z" * 3 for _ in range(3_000)) + "\nlast,",
    ]
    parts = ['"', '""', ",", "|", "\n", "a", " ", "b c", "\t", '"x"', "--"]
    texts += ["a,b\n" + "".join(rng.choice(parts) for _ in range(25)) for _ in range(150)] + ["|a|b|\n" + "".join(rng.choice(parts) for _ in range(25)) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, header string")
    found = tables_of(df)
    got = {r.doc_id: (r.delimiter, r.header, r.body) for r in found.collect()}
    want = {i: t for i, t in enumerate(map(brute, texts)) if t}
    assert got.keys() == want.keys()
    assert [i for i in got if got[i] != want[i]] == []
    cells = {(r.doc_id, r.row, r.place): (r.label, r.column, r.cell) for r in table_cells(found).collect()}
    assert cells[0, 1, 2] == ("1", "b", "2") and cells[1, 2, 1] == ("line\nend tail", "a", "line\nend tail")
