import collections
import random
import re

import brute
import pytest

from inkmill.llm import collocations as module
from inkmill.llm.collocations import _END, _FOLD, _suffixes, collocations, count_prefixes, lower_bound, packed, stretches, unpacked


def brute_collocations(rows, least, max_n=5, share=100, most=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, max_n + 1):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * a >= share * f[lang, w[i : i + k]]:
                    gone.add((lang, w[i : i + k]))
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:most]))


def awkward():
    rng = random.Random(11)
    words = ["a", "b", "c", "é", "A", "\x01", "ab", "a\x01", "c'", "日本"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(150)]
    rows += [("the same old passage of words again", "en")] * 40 + [(None, "en"), ("", "fr"), (" . ", None), ("a a a a a a a a", "fr"), ("x", "und")]
    return rows + [("hot pair " + rng.choice("abc") + " " + rng.choice("abc"), "en") for _ in range(200)]


@pytest.mark.parametrize(("least", "share", "most", "size"), [(3, 100, 2000, 1 << 22), (7, 80, 9, 40), (1, 100, 2000, 200)])
def test_collocations(spark, monkeypatch, least, share, most, size):
    monkeypatch.setattr(module, "stretches", lambda texts, more, size=size: stretches(texts, more, size))
    df = spark.createDataFrame([(t, x, 1, "p") for t, x in awkward()], "text string, lang string, n int, phrase string").repartition(3)
    got = sorted(map(tuple, collocations(df, least=least, share=share, most=most).collect()))
    assert got == brute_collocations(awkward(), least, 5, share, most)


def test_collocations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations(df).count() == 0
    assert collocations(spark.createDataFrame([("a", "en"), (None, None)], "text string, lang string")).count() == 0


def test_stretches_lose_no_phrase():
    text = (" word" * 50 + ". " + "x" * 100 + " y z, w" * 40).encode()
    whole = [w for words, own in stretches([text], 4) for w in words[:own]]
    for size in (1, 7, 64):
        parts = list(stretches([text], 4, size))
        assert [w for words, own in parts for w in words[:own]] == whole
        at = 0
        for words, own in parts:
            assert words[: own + 4] == whole[at : at + own + 4]
            at += own


def test_prefixes_are_summed_over_ranges():
    rng = random.Random(2)
    words = [rng.choice([b"a", b"b", b"c", _END]) for _ in range(3000)]
    values, rows, counts = _suffixes(words, len(words), lambda w: w != _END, 4)
    want = collections.Counter()
    for i in range(len(words)):
        for k in range(2, 5):
            if len(p := words[i : i + k]) == k and _END not in p:
                want[b" ".join(p).decode()] += 1
    bounds = [(b"a", b"b", b"", b""), (b"a", b"c", b"a", b"zz"), (b"b", b"", b"", b""), (b"bb", b"a", b"", b""), (b"c", b"c", b"c", b"a")]
    cuts = [lower_bound(values, rows, b) for b in bounds]
    decoded = [tuple(values[x] if x >= 0 else b"" for x in r) for r in rows]
    assert cuts == [sum(r < b for r in decoded) for b in bounds]
    found = collections.Counter()
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        if lo == hi:
            continue
        own, again, times = unpacked(*packed(values, rows[lo:hi], counts[lo:hi]), 4)
        assert [[own[x] for x in r if x >= 0] for r in again.tolist()] == [[values[x] for x in r if x >= 0] for r in rows[lo:hi].tolist()]
        assert times.tolist() == counts[lo:hi].tolist()
        down = rows[lo:hi][::-1], counts[lo:hi][::-1]
        for k, at, total in count_prefixes(*down, 1):
            for i, n in zip(at, total):
                found[b" ".join(values[x] for x in down[0][i, :k]).decode()] += int(n)
        assert sum(len(at) for _, at, _ in count_prefixes(*down, 10**9)) <= 6  # only what meets an end leaves with too few
    assert found == want


def test_fold_table():
    assert b"Ab.C\td\x0be".translate(_FOLD) == b"ab\xffc d\xffe"
