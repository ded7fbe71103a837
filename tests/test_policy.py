import json
import re

from inkmill.operators import bundle as U
from inkmill.operators import policy as Y


def test_bundle_finds_what_each_pattern_does(spark):
    texts = ["a  b ,c!! () x,y end.Next :me@x '\" ### 1,234 123456 5mg TODO", "", None, "é  😀  x", "todo todo", "plain"]
    df = spark.createDataFrame([(1, i, t, i == 4) for i, t in enumerate(texts)], "doc_id long, line long, raw string, hide boolean")
    got = sorted((r.line, r.rule, r.start, r.match) for r in U.bundle(df).collect())
    assert got == sorted((i, r.name, m.start(), m[0]) for i, t in enumerate(texts) for r in U.TEXT_RULES for m in re.finditer(r.pattern, t or "", re.ASCII))
    assert U.bundle(df, masked=df["hide"]).where("line = 4").count() == 0 == U.bundle(df, ()).count()


def test_artifacts_are_written_by_artifact(spark, tmp_path):
    df = spark.createDataFrame([(1, i, "a  b | c,d" if i % 2 else "TODO") for i in range(40)], "doc_id long, line long, raw string")
    for _ in range(2):
        U.write_artifacts(U.bundle(df), str(tmp_path / "out"), ["doc_id", "line", "rule", "match"], parts=3)
    rows = spark.read.json(str(tmp_path / "out/json"))
    assert rows.groupBy("artifact").count().collect() and rows.count() == U.bundle(df).count()
    assert {p.name for p in (tmp_path / "out/json").iterdir() if p.is_dir()} == {"artifact=hygiene", "artifact=leftovers"}
    text = [p.read_text().splitlines() for p in (tmp_path / "out/markdown/artifact=hygiene").glob("part=*/*.txt")]
    assert all(t[:2] == ["| doc_id | line | rule | match |", "|---|---|---|---|"] and t[2:] == sorted(t[2:], key=lambda x: int(x.split(" | ")[1])) for t in text if t)
    assert sum(len(t) - 2 for t in text if t) == rows.where("artifact = 'hygiene'").count()
    assert [p.name for p in (tmp_path / "out").iterdir() if "-" in p.name] == []


def test_profiles_take_over(spark, tmp_path):
    files = {
        "a.json": {"id": "A", "extends": "b", "style_limits": {"sentence_words": {"body": 10, "front": None}, "tolerance": 0.2}, "article_types": [{"id": "brief", "style_limits": {"sentence_words": {"body": 5}}}]},
        "b.json": {"id": "b", "extends": "c", "style_limits": {"sentence_words": {"front": 7, "methods": 8}}}, "c.json": {"id": "c", "extends": "b", "style_limits": {"paragraph_words": {"body": 9}}}, "d.json": {"note": 1},
    }
    for name, body in files.items():
        (tmp_path / name).write_text(json.dumps(body))
    profiles, settings = Y.read_profiles(spark, str(tmp_path))
    got = {(r.profile, r.article_type, r.section, r.unit): (r.cap, r.source) for r in Y.resolved(profiles, settings).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "a"} == {
        (t, *k): v
        for t in (None, "brief")
        for k, v in {("body", "sentence"): (5.0 if t else 10.0, "a"), ("front", "sentence"): (None, "a"), ("methods", "sentence"): (8.0, "b"), ("body", "paragraph"): (9.0, "c")}.items()
    }
    words = lambda n: "w " * n
    lines = spark.createDataFrame(
        [(1, 1, words(13), "body", "a", None), (1, 2, words(12), "body", "a", "other"), (1, 3, words(6) + "x. " + words(5), "body", "a", "brief"), (1, 4, words(41), "front", "a", None), (1, 5, words(40), "front", "a", None), (1, 6, None, "body", "a", None), (1, 7, words(300), "x", "none", None)],
        "doc_id long, line long, raw string, kind string, profile string, article_type string",
    )
    rows = Y.long_text(lines, Y.resolved(profiles, settings)).collect()
    got = sorted((r.line, r.unit, r.nth, r.n_words, r.cap, r.tier) for r in rows)
    assert got == [
        (1, "paragraph", 0, 13, 9, "finding"), (1, "sentence", 1, 13, 12, "finding"), (2, "paragraph", 0, 12, 9, "finding"), (3, "paragraph", 0, 12, 9, "finding"), (3, "sentence", 1, 7, 5, "finding"),
        (4, "sentence", 1, 41, None, "advisory"), (7, "paragraph", 0, 300, None, "advisory"),
    ]
