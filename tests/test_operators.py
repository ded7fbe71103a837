import io
import math
import zipfile
from fractions import Fraction

import pytest
from oracle import check
from pyspark.sql import functions as F

from inkmill.functions import sequential as Q
from inkmill.functions.scalars import binomial_tail, parse_score
from inkmill.operators import matching as M
from inkmill.operators import prose as P
from inkmill.operators import text as T
from inkmill.operators.scores import member_stats
from inkmill.plans import match_queries
from inkmill.plans.match_queries import contained
from inkmill.plans.score_queries import score_rows, sign_test
from inkmill.sources import corpus, tables
from inkmill.streaming.windows import tumbling_counts


def test_scores_parse(spark):
    rows = spark.createDataFrame([("−3",), (" 2 ",), ("inf",), ("x",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(parse_score(F.col("t"))).collect()] == [-3.0, 2.0, None, None, None, None]


def test_binomial(spark):
    row = spark.range(1).select(binomial_tail(F.lit(3), F.lit(4)), binomial_tail(F.lit(0), F.lit(0))).first()
    assert tuple(row) == (0.3125, 1.0)


def test_binomial_of_many_draws(spark):
    pairs = [(31, 63), (37, 69), (700, 1300), (2600, 5000), (4000, 5000), (0, 5000)]
    rows = spark.createDataFrame(pairs, "k int, n int")
    for r in rows.select("k", "n", binomial_tail(F.col("k"), F.col("n")).alias("p")).collect():
        assert r.p == pytest.approx(float(Fraction(sum(math.comb(r.n, i) for i in range(r.k, r.n + 1)), 1 << r.n)), rel=1e-9)


def test_sign_test_uses_all_votes(spark):
    sf = "/root/testdata/sf0.1"
    stats = {r.member: r for r in member_stats(score_rows(spark, sf), "v0").collect()}
    assert max(r.base_decided for r in stats.values()) > 40
    for r in sign_test(spark, sf).collect():
        n, k = stats[r.member].base_decided, stats[r.member].base_losses
        p = sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
        assert abs(r.p - p) < 1e-8 and r.passes == (None if r.member == "v0" else p >= 0.05)


def test_number_words():
    assert Q.number_of("two hundred and five".split()) == 205
    assert Q.number_of("three million two thousand one".split()) == 3002001
    assert Q.number_of("five six".split()) is None and Q.number_of("and".split()) is None


def test_sequential_functions(spark):
    row = spark.createDataFrame([("Dr. A. Bee saw it. Then (a (b) c) ended! See fig. 3 now.", "twenty one")], "t string, w string")
    spans, number, groups = row.select(Q.sentence_spans("t"), Q.word_number("w"), Q.paren_groups("t")).first()
    text = row.first()[0]
    assert [text[s.start : s.end] for s in spans] == ["Dr. A. Bee saw it.", "Then (a (b) c) ended!", "See fig. 3 now."]
    assert number == 21 and [g.depth for g in groups] == [2]
    ids = spark.createDataFrame([("see 10.1000/abc.d and example.org", "RNA", "ribo nucleic acid")], "t string, a string, p string")
    claimed, fits = ids.select(Q.claimed_identifiers("t"), Q.initials_fit("a", "p")).first()
    assert [(c["class"], c["value"]) for c in claimed] == [("doi", "10.1000/abc.d"), ("domain", "example.org")] and fits


def plain_matches(base, other, least=0.55):
    """Base units to others, by all similarities at once."""
    plain = {k: {u: " ".join(t.lower().split()) for u, t in rows} for k, rows in (("a", base), ("b", other))}
    found = {}
    for u in sorted(plain["a"]):
        same = [v for v in sorted(plain["b"]) if plain["b"][v] == plain["a"][u] and v not in found.values()]
        if same:
            found[u] = same[0]
    rest = [u for u in plain["a"] if u not in found]
    for u in sorted(rest, key=lambda x: (-len(set(M.TOKEN.findall(plain["a"][x]))), x)):
        scores = sorted((-M.unit_similarity(plain["a"][u], t), v) for v, t in plain["b"].items() if v not in found.values())
        if scores and -scores[0][0] >= least:
            found[u] = scores[0][1]
    return set(found.items())


def test_units_match_once(spark):
    base = [(1, "the cat sat on the mat"), (2, "same text here"), (3, "Same  TEXT here"), (4, "mat"), (5, "a longer base sentence that holds the cat sat on a mat")]
    other = [(7, "same text here"), (8, "the cat sat on a mat"), (9, "unrelated words"), (10, "same text here now")]
    tables_ = [spark.createDataFrame([("k", *r) for r in rows], "key string, unit long, text string") for rows in (base, other)]
    got = {(r.base_unit, r.unit) for r in M.match_units(*tables_).collect()}
    assert got == plain_matches(base, other) and {(2, 7), (3, 10)} <= got


def test_units_of_one_table(spark):
    rows = spark.createDataFrame([("k", 0, 1, "one two three"), ("k", 1, 1, "one two three")], "key string, turn int, unit long, text string")
    assert M.match_units(rows.where("turn = 0").drop("turn"), rows.where("turn = 1").drop("turn")).count() == 1
    assert match_queries.content_units(spark, "/root/testdata/sf0.01").count() > 0


def test_closure_of_a_dense_and_of_a_long_graph(spark):
    layers = [(f"{i}.{a}", f"{i + 1}.{b}") for i in range(10) for a in range(4) for b in range(4)] + [("9.0", "3.1"), (None, "x"), ("y", None)]
    got = {(r.root, r.node) for r in M.closure(spark.createDataFrame(layers, "src string, dst string")).collect()}
    assert ("0.0", "10.3") in got and ("9.0", "9.0") in got and ("3.1", "4.0") in got and ("y", "y") in got and ("10.0", "10.0") not in got
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "src long, dst long")
    assert M.closure(chain).count() == 150 + 150 * 151 // 2


def test_passages_with_line_breaks_and_short_ones_are_found(spark):
    passages = ["a b\nc d e f g h i", "one\ntwo three four five six seven", "b", "d e", "", "\n", " g h", "no such passage", None, "x  y\n\nz 1 2 3 4", "a b c d e f g h i"]
    texts = ["xa b\nc d e f g h ij", "a b c d e f g h i", "done\ntwo three four five six sevens", "x  y\n\nz 1 2 3 45", "", None, "x y z 1 2 3 4"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    want = {(i, j) for i, t in enumerate(texts) for j, p in enumerate(passages) if t is not None and p is not None and p in t}
    got = [tuple(r) for r in contained(docs, items).collect()]
    assert set(got) == want and len(got) == len(want)


def test_containment_equals_its_sql_where_passages_have_line_breaks(spark):
    found = check(spark, match_queries.QUERIES["benchmark_containment"], match_queries.ORACLE_SQL["benchmark_containment"], "/root/testdata/sf0.1")
    assert len(found) > 216


def test_location_merge_keeps_the_first(spark):
    words = "a b c d e f g h".split()
    rows = [(i, "v", "own", "M1", "minor", 3, words) for i in (1, 2)] + [(3, "v", "own", "M1", "minor", None, words)]
    df = spark.createDataFrame(rows, "id long, version string, source string, class string, severity string, line int, words array<string>")
    assert [(r.id, r.counted, r.merged_into) for r in M.merge_by_location(df).orderBy("id").collect()] == [(1, True, None), (2, False, 1), (3, True, None)]


def test_corpus_inventory(spark, tmp_path):
    doc = io.BytesIO()
    with zipfile.ZipFile(doc, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:rPr><w:vanish/></w:rPr><w:t>hidden</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "main.docx").write_bytes(doc.getvalue())
    (tmp_path / "notes.rtf").write_bytes(rb"{\rtf1{\fonttbl x}caf\'e9\par two}")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "supp_a.txt").write_bytes(b"a\xffb")
    got = {r.path.rsplit("/", 1)[1]: r for r in corpus.inventory(spark, str(tmp_path)).collect()}
    assert got["main.docx"].text == "Hello" and got["main.docx"].role == "manuscript"
    assert got["notes.rtf"].text == "café\ntwo" and got["empty.txt"].status == "empty"
    assert got["bad.docx"].status == "failed" and got["supp_a.txt"].notes and got["supp_a.txt"].role == "supplement"


def test_score_files(spark, tmp_path):
    (tmp_path / "round2_raw_scores.csv").write_text(",".join(tables.SCORES.names) + '\n,a1,a2,3,3,own,x,s,j,1,b,r,i,"two\nlines ""quoted"""\n')
    row = tables.read_scores(spark, str(tmp_path)).first()
    assert (row["round"], row["member"], row["opponent"], row["credited"]) == ("2", "a1", "a2", "3")


def test_dump_json_and_literals(spark):
    lines = spark.createDataFrame([(1, 1, "==> a.csv <=="), (1, 2, "x = 3"), (1, 3, "==> b.csv <=="), (1, 4, "y: 'z'")], "doc_id long, line int, raw string")
    assert {(r.path, r.raw) for r in tables.dump_blocks(lines).collect()} == {("a.csv", "x = 3"), ("b.csv", "y: 'z'")}
    assert {(r.name, r.literal) for r in tables.code_literals(lines).collect()} == {("x", "3"), ("y", "'z'")}
    prose = spark.createDataFrame([('Sure:\n```json\n{"a": 1}\n```',), ('so {"a": 2} it is',), ("none",)], "t string")
    assert [r[0] and r[0].a for r in prose.select(tables.lenient_json(F.col("t"), "a int")).collect()] == [1, 2, None]


def test_streaming_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = tumbling_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    batch = tumbling_counts(events)
    assert spark.table("windows").select("window_start", "event_type", "n").exceptAll(batch.select("window_start", "event_type", "n")).isEmpty()
    assert spark.table("windows").count() == batch.count()


def test_metric_numbers(spark):
    from inkmill.operators import claims as C

    same = [["0.05", ".05", "0.050", "= .05"], ["5 × 10^-8", "5 \\times 10^{-8}", "5 × 10⁻⁸", "5e-8"], ["1,200", "1200", "1\u00a0200"], ["−3", "-3.0"]]
    for i, group in enumerate(same):
        rows = spark.createDataFrame([(v,) for v in group], "v string").select(C.metric_number(F.col("v"))).distinct().collect()
        assert [r[0] for r in rows] == [[0.05, 5e-8, 1200.0, -3.0][i]]
    assert spark.createDataFrame([("<= 0.1",), ("x",)], "v string").select(C.metric_operator(F.col("v")), C.metric_number(F.col("v"))).collect() == [("<=", 0.1), ("", None)]


def test_similar_identifiers(spark):
    from inkmill.operators import claims as C

    rows = [("doi", "10.1/ab", "10.1/xy", True), ("doi", "10.1/abc", "10.1/xyz", False), ("id", "GSE123456", "GSE123457", True), ("id", "GSE1234", "GSE12345", True), ("id", "abc", "abcd", True), ("id", "abc", "xyz", False), ("id", "same", "same", False), ("id", None, "x", False)]
    df = spark.createDataFrame(rows, "kind string, a string, b string, want boolean")
    got = df.select(C.identifier_similar(F.col("kind"), F.col("a"), F.col("b")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_champion_by_defects_first(spark):
    from inkmill.operators import claims as C

    schema = "member string, n long, median double, mean double, iqr double, original_n long, original_median double, digest string"
    counts = spark.createDataFrame([(v, c, n) for v, cells in {"b": [5, 5], "x": [0, 9], "y": [1, 0], "z": [0, 9]}.items() for c, n in enumerate(cells + [0] * 46)], "version string, cell int, n long")
    one = lambda member, median=1.0, mean=1.0, iqr=1.0, n=9, against=3, vs=0.0, digest="d": (member, n, median, mean, iqr, against, vs, digest)
    base = one("b", against=0, vs=None)
    cases = [
        ([base], 5, "b"), ([base, one("x")], 5, "b"), ([base, one("x", iqr=0.5)], 5, "x"), ([base, one("x", 3.0, n=4)], 5, "b"), ([base, one("x", 3.0, vs=-1.0), one("y", 2.0)], 5, "y"), ([], 5, "b"),
        ([base, one("y", 3.0), one("x", 0.0)], 5, "x"),  # fewer defects in the first cell beat the median
        ([base, one("y", 3.0), one("x", 0.0)], 0, "y"),  # without a floor the median decides
        ([base, one("x", 2.0, digest="q"), one("z", 2.0, digest="p")], 5, "z"),  # a full tie goes by digest
        ([base, one("x", 3.0, against=2)], 5, "b"), ([one("x", 3.0)], 5, "x"), ([base, one("x", 3.0, vs=None)], 5, "b"),
    ]
    for rows, floor, want in cases:
        found = C.champion(spark.createDataFrame(rows, schema), counts, "b", 5, 3, floor).collect()
        assert [r.champion for r in found] == [want]


def test_pins_and_promises(spark):
    rows = [
        (1, 1, "https://GitHub.com/a/b/tree/1234567 and http://www.github.com/a/b/blob/ABCDEF0123"), (1, 2, "https://github.com/a/b/commit/abcdef01234567890"), (2, 1, "https://gitlab.com/a/b/-/tree/1234567 https://gitlab.com/a/b/-/blob/12345678"),
        (3, 1, "Data will be shared after acceptance."), (3, 2, "In the meantime ask for what is deposited"), (3, 3, "here"), (3, 4, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, line long, raw string")
    assert [tuple(r) for r in P.pin_conflicts(df).collect()] == [(1, "github.com/a/b", 1)]
    assert [(r.line, r.promise) for r in P.availability_promises(df).orderBy("line").collect()] == [(1, "promised ... before publication"), (2, "in the meantime")]


def test_sinks_replace_whole_folders(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_csv(spark.range(3).selectExpr("id", "'a,\"b' AS t"), path)
    assert spark.read.csv(path, header=True, escape='"').count() == 3
    tables.write_json(spark.range(2), path)
    assert spark.read.json(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        tables.write_json(spark.range(2).selectExpr("raise_error('DIVIDE_BY_ZERO') AS x"), path)
    assert spark.read.json(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_dumps(spark):
    texts = {1: "$ head\n==> a.csv <==\nx, Opponent_ID\n1,2", 2: "==> a.csv <==\nx,y\nopponent_id,1", 3: "x,opponent_id", 4: "==> a <==\nnone\n==> b <==\n\n\"opponent_label\",z"}
    rows = spark.createDataFrame([(k, i, x) for k, t in texts.items() for i, x in enumerate(t.split("\n"))], "doc_id int, line int, raw string")
    assert sorted(r.doc_id for r in tables.dumps(rows).collect()) == [1, 4]


def test_redline_weight(spark):
    rows = spark.createDataFrame([(1, "a b c", "a x c", 2), (2, "a b c", "a x c", 203), (3, None, "w " * 150, 451), (4, None, None, 0)], "id int, base string, revised string, n_marked long")
    assert [(r.id, r.n_needed, r.over_marked) for r in P.redline_weight(rows).orderBy("id").collect()] == [(1, 2, False), (2, 2, True), (3, 150, True), (4, 0, False)]


def test_masks_keep_positions(spark):
    rows = spark.createDataFrame([("",), ("$x$",), ("a $x$ b $y$",), (None,), ("none",)], "t string")
    assert [r[0] for r in rows.select(P.masked_in_place(F.col("t"), *P.TEX_EXEMPT)).collect()] == ["", "   ", "a     b    ", None, "none"]


def test_entry_years(spark):
    cases = {"A reply (2014). Nature 2016; 5": "2016", "X (2015) in 2016": "2015", "The 2015 accord. Nature, 2021.": "2021", "10.1/gb-2019-1": "2019", "none": "", "In 1999 x": "1999"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r[0] == r.want for r in rows.select(P.entry_year(F.col("t")), "want").collect())


def test_written_values(spark):
    lines = spark.createDataFrame([(1, 1, "0.05, .05 0.050 5e-2 x0.05 1.0.05 0.051 (0.05) 1,234 1234.0 12345 1,2345")], "doc_id int, line int, raw string")
    got = [(r.value, r.written) for r in P.value_occurrences(lines, [".05", "1234"]).orderBy("nth").collect()]
    assert got == [*((".05", x) for x in ("0.05", ".05", "0.050", "5e-2", "0.05")), ("1234", "1,234"), ("1234", "1234.0")]


def test_merge_by_location_walks_in_order(spark):
    import random

    rng = random.Random(9)
    words = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(220):
        own = words[:]
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(12)] = f"z{rng.randint(0, 5)}"
        own = own[: rng.choice([5, 9, 12])] + own[: rng.choice([0, 3])]
        rows.append((i, rng.choice("vw"), "own", rng.choice(["M1", "M1", None]), rng.choice(["x", None]), rng.choice([1, 1, 2, None]), rng.choice([own, own, None]) if i % 9 == 0 else own, rng.choice([None, "a.md", "b.md"])))
    kept, want = [], {}
    for r in rows:
        i, v, src, c, sev, line, w, doc = r
        target = None
        if c is not None and line is not None and w and len(w) >= 7:
            for j, key, seen, other in kept:
                if key == (v, src, c, sev, line) and (doc is None or other is None or doc == other) and len(seen & set(w)) / len(seen | set(w)) >= 0.8:
                    target = j
                    break
            if target is None:
                kept.append((i, (v, src, c, sev, line), set(w), doc))
        want[i] = target
    df = spark.createDataFrame(rows, "id long, version string, source string, class string, severity string, line int, words array<string>, document string")
    got = {r.id: r.merged_into for r in M.merge_by_location(df).collect()}
    assert got == want and sum(x is not None for x in want.values()) > 10
    assert M.merge_by_location(df.limit(0)).count() == 0


def test_near_pairs_stand_for_their_copies(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(160):
        own = [f"w{j}" for j in range(rng.choice([7, 10, 40]))]
        for _ in range(rng.randint(0, 2)):
            own[rng.randrange(len(own))] = f"z{rng.randint(0, 4)}"
        rows.append((i, rng.choice(["a", "b", None]), rng.choice(["x", None]), rng.choice([1, 2, None]), sorted(set(own)), rng.choice([None, "d", "e"])))
    rows += [(i % 3 + 200, "a", None, i, [f"w{j}" for j in range(9)], None) for i in range(9)]
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {
        (a[0], b[0], a[3], round(alike(a[4], b[4]), 9)) for a in rows for b in rows
        if a[0] < b[0] and a[1] is not None and a[3] is not None and a[1:4] == b[1:4] and (a[5] is None or b[5] is None or a[5] == b[5]) and min(len(a[4]), len(b[4])) >= 7 and alike(a[4], b[4]) >= 0.8
    }
    df = spark.createDataFrame(rows, "id long, class string, severity string, line int, words array<string>, document string")
    got = [(r.id_a, r.id_b, r.line, round(r.similarity, 9)) for r in M.near_defects(df).collect()]
    assert set(got) == want and len(got) == len(want) > 30
    copies, pairs = M.near_pairs(df.dropna(subset=["class", "line"]), 0.8)
    groups = {(r.stands, r.line) for r in copies.collect()}
    assert len(groups) < copies.count() and {(i, r.line) for r in pairs.collect() for i in (r.id_a, r.id_b)} <= groups
    assert M.near_defects(df.limit(0)).count() == 0


def test_columns_are_sought_once_for_a_set_of_tokens(spark):
    said = spark.createDataFrame([(i, [["b", "a", "b"], ["a", "b"], ["c"], ["x"], []][i % 5]) for i in range(40)], "sid long, tokens array<string>")
    columns = spark.createDataFrame([("t", "one", ["a"]), ("t", "two", ["a", "b"]), ("s", "c", ["c"]), ("r", "a", ["a", "c"]), ("u", "b", ["b"])], "file string, column string, tokens array<string>")
    found = M.top_producers(said, columns)
    got = sorted((r.sid, r.place, r.file, r.column, r.score) for r in found.collect())
    both, one = [(1, "t", "two", 2), (2, "r", "a", 1), (3, "t", "one", 1)], [(1, "r", "a", 1), (2, "s", "c", 1)]
    assert got == [(i, *x) for i in range(40) for x in (both, both, one, [], [])[i % 5]]
    assert "hashpartitioning(sid" not in found._jdf.queryExecution().toString()


def test_closure_makes_a_pair_once_on_a_chain(spark, monkeypatch):
    made = []

    def watched(df):
        made.append(df.count())
        return settled(df)

    settled = M.settled
    monkeypatch.setattr(M, "settled", watched)
    assert M.closure(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")).count() == 40 + 40 * 41 // 2
    assert sum(made) == 40 * 41 // 2  # what is written is each pair once


def test_repeated_grams_are_counted_in_their_line(spark):
    raw = ["a b c a b c a b c x", "a b", "", None, "q w e r", "x x x x x", "B b b, b z y z y z y z"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(raw)], "doc_id long, line int, raw string")
    found = T.term_repetition(df)
    got = sorted((r.doc_id, r.place, r.gram, r.n) for r in found.collect())
    assert got == [(0, 1, "a b c", 3), (0, 2, "b c a", 2), (0, 3, "c a b", 2), (5, 1, "x x x", 3), (6, 1, "z y z", 3), (6, 2, "b b b", 2), (6, 3, "y z y", 2)]
    assert "Exchange" not in found._jdf.queryExecution().toString()


def test_first_places_are_found_in_a_hash_table(spark):
    top = 2**63 - 1
    rows = [(top, 3, 2, "b"), (top, 3, 1, "c"), (-top, 2**31 - 1, 9, "d"), (-top, 2**31 - 1, 10**9 - 1, "e"), (None, 7, 1, "f"), (0, 10, 1, "g"), (0, 9, 5, "h")]
    df = spark.createDataFrame(rows, "doc_id long, line int, nth int, match string")
    got = [r.match for r in df.orderBy(T.place_of(df)).collect()]
    assert got == ["f", "d", "e", "h", "g", "c", "b"]
    assert df.where(T.place_of(df).isNull()).count() == 0
    least = df.groupBy("match").agg(F.min(T.place_of(df)))
    assert "SortAggregate" not in least._jdf.queryExecution().executedPlan().toString()
