import random
import re

import pytest
from pyspark.sql import functions as F

from inkmill.operators import dictionary as D


def brute(rows, terms):
    out = []
    for doc, line, raw in rows:
        for family, variant in set(terms):
            if variant and variant.strip():
                for m in re.finditer(r"(?<![A-Za-z0-9])" + re.escape(variant.strip()) + r"(?![A-Za-z0-9])", raw or "", re.IGNORECASE):
                    out.append((doc, line, m.start() + 1, m.end() - m.start(), family, variant))
    return sorted(out, key=str)


def longest(hits):
    out, stop = [], {}
    for h in sorted(hits, key=lambda h: (h[0], h[1], h[2], -h[3], h[5])):
        if h[2] >= stop.get(h[:2], 0):
            stop[h[:2]] = h[2] + h[3]
            out.append(h)
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 24, 20])
def test_hits_are_those_of_each_pattern(spark, part_bytes):
    rng = random.Random(4)
    words = ["C++", "c", "a b", "a b c", "b c", "É", "aa aa", "AA", "N.B.", "b", "\\", "x-1"]
    terms = [(rng.choice("fg"), w) for w in words] + [("f", "aa aa"), ("f", " "), ("f", None), ("g", "A b "), (None, "b")]
    rows = [(d, n, " ".join(rng.choice([*words, "é", "z", "c1", "aa", "a  b", "İ"]) for _ in range(12))) for d in (1, 2) for n in range(20)]
    rows += [(3, 1, None), (3, 2, ""), (3, 3, "aa aa aa aa"), (3, 3 + 1, "a b" * 3)]
    lines = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, line long, raw string, family string")
    df = spark.createDataFrame([(*t, 1) for t in terms], "family string, variant string, start int")
    hits = D.dictionary_hits(lines, df, part_bytes=part_bytes)
    got = [tuple(r)[:6] for r in hits.collect()]
    assert sorted(got, key=str) == brute(rows, terms)
    one = [h for h in brute(rows, terms) if h[4] == "f"]
    assert sorted((tuple(r)[:6] for r in D.longest_hits(hits.where("family = 'f'")).collect()), key=str) == longest(one)
    assert D.dictionary_hits(lines, df.limit(0)).count() == 0 == D.dictionary_hits(lines.limit(0), df).count()


def test_residues(spark):
    raw = [
        "We count the copy number (CN) of cells.", "Copy-numbers rose; the copy  number fell.", 'It says "a copy number here" once.', "copy number (XY) is another's",
        "the copynumber and copy numbering", "copy number (CN) again, copy–number", None,
    ]
    lines = spark.createDataFrame([(1, "s", i, t) for i, t in enumerate(raw)] + [(1, "t", 9, "copy number")], "doc_id long, section string, line long, raw string")
    forms = spark.createDataFrame([("CN", "copy number"), ("CN", "number"), ("XY", "copy number")], "token string, variant string")
    got = D.long_form_residues(lines, forms).where("token = 'CN'").select("line", "written").orderBy("line", "start").collect()
    assert [tuple(r) for r in got] == [(1, "Copy-numbers"), (1, "copy  number"), (5, "copy–number")]


def test_long_form_candidates(spark):
    text = ["we measured copy-number", "The direct nuclear tagmentation, (see)", "number of cells", "", "one", "Blue blue rings blue rings"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = [[" ".join(w) for w in r[0]] for r in df.select(D.long_form_candidates(F.col("t"))).collect()]
    want = [["copy-number"], ["direct nuclear tagmentation see", "nuclear tagmentation see", "tagmentation see"], [], [], [], ["Blue blue rings blue rings", "blue rings blue rings", "rings blue rings", "blue rings"]]
    assert got == want


@pytest.mark.parametrize("part_bytes", [1 << 21, 3])
def test_phrases_in_texts(spark, part_bytes):
    texts, phrases = ["", "a b", "ab\nab c", "é€", None, "a b"], ["a", "ab", "ab\nab", "", None, "é", "zz", "a"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    sought = spark.createDataFrame(list(enumerate(phrases)), "key int, phrase string")
    got = sorted(map(tuple, D.phrases_in(df, sought, part_bytes).collect()))
    assert got == [(i, k) for i, t in enumerate(texts) for k, p in enumerate(phrases) if t is not None and p is not None and p in t]
    assert D.phrases_in(df, sought.limit(0)).count() == 0
