import re

from inkmill.operators import counts as N
from inkmill.operators import logic as A
from inkmill.operators.counts import spelled_counts
from inkmill.operators.logic import logic_rows
from inkmill.plans import argument_queries as Q
from inkmill.plans.text_queries import lines

SF = "/root/testdata/sf0.001"


def value(words):
    total = part = 0
    tokens = [w for w in re.split(r"[-\s]+", words.lower()) if w]
    for before, w in zip(["", *tokens], tokens):
        if w in N.UNITS:
            part += N.UNITS[w]
        elif w == "hundred":
            part = max(part, 1) * 100
        elif w in N.SCALES:
            total, part = total + max(part, 1) * N.SCALES[w], 0
        elif w != "and" or before not in N.SCALES:
            return None
    return total + part or None


def plural(w):
    return w in N.IRREGULAR_PLURALS or (len(w) >= 4 and w.endswith("s") and w not in N.NO_PLURALS)


def counts_something(text, at, written):
    left, right = text[:at], text[at + len(written) :]
    first = re.split(r"[-\s]+", written.lower())[0]
    follower = re.match(r"\s+([A-Za-z][A-Za-z'-]*)", right)
    number = "|".join([*N.UNITS, *N.SCALES])
    if re.search(rf"(?i)\b(?:{'|'.join(N.LABELS)}|cell\s+line)\s+$", left[-24:]):
        return False
    if first in N.SCALES and not re.search(r"(?i)\ba\s+$", left[-4:]):
        return False
    if re.match(rf"(?i)\s+of\s+((the|these|those|its|their)\s+)?({number}|\d+)\b", right):
        return written.lower() != "one"
    if first == "one" and ((follower and follower[1].lower() in N.AFTER_PRONOUN) or re.search(r"(?i)\b(no|for|at|in)\s+$", left[-12:])):
        return False
    if re.match(r"(?i)\s*(percent|%|fold\b|times\b|orders?\s+of\s+magnitude)", right) or re.match(r"\s+([A-Za-z][A-Za-z-]*\s+){0,2}per\s+", right):
        return True
    if written.lower() == "one" and not re.search(rf"(?i)\b({'|'.join(N.DETERMINERS)})\s+$", left[-16:]):
        near = re.match(r"\s+([A-Za-z][A-Za-z-]*)\b", right)
        if not (near and plural(near[1].lower().strip("-"))):
            return False
    return any(plural(w) for w in (x.lower().strip("-") for x in re.findall(r"[A-Za-z][A-Za-z-]*", right)[:4]) if not w.endswith("ly"))


def brute(text):
    out = []
    for m in re.finditer(N.RUN, text or ""):
        parts, at = ([m[0]] if value(m[0]) else re.split(r"\sand\s", m[0])), m.start()
        for p in parts:
            if value(p) and counts_something(text, at, p):
                out.append((at, p, value(p)))
            at += len(p) + 5
    return out


def test_counts_in_words(spark):
    texts = [
        "We saw twenty-one patients.", "Run two had one hundred and five cells; three and five donors", "Four of the five, one of the nine, one of them and two million reads", "one row per sample",
        "threefold, six percent, two orders of magnitude", "the one caller, a hundred analyses, at one point", "hundred men", "one currently requires files", "one files", "Two-fold, a thousand mice",
        "one thousand two hundred and thirty four new cells", "no one hand, one another", "seven newly made rings", "a three AND five donors", "five, six or seven  classes of news", "é two rings 😀 three rings", "", None, "two hundred thousand six genes",
    ]
    df = spark.createDataFrame([(1, i, t, "x") for i, t in enumerate(texts)], "doc_id long, line long, raw string, start string")
    got = sorted((r.line, r.start, r.written, r.number) for r in spelled_counts(df).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t))
    assert [x[3] for x in got if x[0] in (1, 10, 18)] == [105, 3, 5, 1234, 200006]
    rows = lines(spark, SF).selectExpr("doc_id", "line", f"{Q._COUNTED} AS raw").collect()
    want = sorted((r.doc_id, r.line, *x) for r in rows for x in brute(r.raw))
    assert sorted(map(tuple, Q.QUERIES["spelled_counts"](spark, SF).collect())) == want and len(want) > 100


def test_logic(spark):
    text = [
        "Intro words", "We therefore stop.", "It is short because.", "We therefore stop.", "", "We therefore go. The bold-claim described above holds.", "A claim-like thing. the claim described above", "the thing described above and the late described above, late",
        "It won't be that they will be flagged as one.", "They will be flagged as one. They will be flagged as two.", "Was the masked described above?", None, "the masked described above",
    ]
    df = spark.createDataFrame([(1, i, t, i == 10) for i, t in enumerate(text)], "doc_id long, line long, raw string, hide boolean")
    got = sorted((r.line, r.place, r.evidence[:24]) for r in logic_rows(df, df["hide"]).collect())
    assert got == [(1, 11, "We therefore stop."), (5, 11, "We therefore go. The bol"), (5, 12, "bold-claim"), (7, 12, "late"), (9, 4 - 1, "They will be flagged as ")]
    assert logic_rows(df.limit(0)).count() == 0


def test_words_that_no_mention_seeks_stay_where_they_are(spark):
    said = [(1, 1, "A well-known-lattice grew"), (1, 2, "the lattice described above, the gizmo described above"), (2, 1, "the gadget described above"), (2, 2, "Gadget"), (3, 1, "lattice")]
    lines = spark.createDataFrame(said, "doc_id long, line long, raw string")
    assert {(r.doc_id, r.line, r.nth, r.term) for r in A.described_above(lines).collect()} == {(1, 2, 7, "gizmo"), (2, 1, 2, "gadget")}
    words = [(1, 1, 0, f"word{i}") for i in range(640)] + [(1, 1, 700, "well-known-lattice"), (1, 1, 701, "the")]
    bit = A.term_bit("'lattice'")
    got = [r.term for r in A.terms_sought(spark.createDataFrame(words, "doc_id long, line long, at int, word string").withColumn("sought", bit)).collect()]
    assert "lattice" in got and len(got) < 40
