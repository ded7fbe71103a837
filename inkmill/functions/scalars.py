"""Scalar expressions: parsing, canonical forms, statistics of small samples."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS_SIGNS = "−–—"

#: The ordered suffix rewrites that bring spelling variants to one key.
SPELLING_REWRITES = (
    (r"isation\b", "ization"),
    (r"ises\b", "izes"),
    (r"ised\b", "ized"),
    (r"ising\b", "izing"),
    (r"ise\b", "ize"),
    (r"ysed\b", "yzed"),
    (r"yses\b", "yzes"),
    (r"ysing\b", "yzing"),
    (r"yse\b", "yze"),
    (r"our(s|al|able|ed|ing|ite|ism|ist)?\b", "or$1"),
    (r"logue\b", "log"),
    (r"ement\b", "ment"),
    (r"ll(ed|ing|er)\b", "l$1"),
)


def parse_score(text: Column) -> Column:
    """A score written with any minus sign; empty, malformed and non-finite values are null."""
    clean = F.trim(F.translate(text, MINUS_SIGNS, "---"))
    number = clean.try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def spelling_key(token: Column) -> Column:
    for pattern, to in SPELLING_REWRITES:
        token = F.regexp_replace(token, pattern, to)
    return token


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than (Unicode) white space; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S+")), F.lit(0))


def lenient_cap(base: Column, factor: float) -> Column:
    return F.floor(base * F.lit(factor) + F.lit(1e-9))


def iqr(values: Column) -> Column:
    """Inclusive Q3 - Q1 over a group; 0 for fewer than two values."""
    spread = F.percentile(values, F.lit(0.75)) - F.percentile(values, F.lit(0.25))
    return F.when(F.count(values) < 2, F.lit(0.0)).otherwise(spread)


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X >= k) of a fair binomial over n draws, exactly, from the running binomial coefficient.

    Coefficient and total are scaled down by 2^500 together whenever the coefficient passes it.
    """
    large, part = F.lit(2.0**500), F.lit(2.0**-500)
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("total"), F.lit(0).alias("e"))

    def step(acc: Column, i: Column) -> Column:
        total = acc["total"] + F.when(i >= k, acc["c"]).otherwise(0.0)
        c, over = acc["c"] * (n - i) / (i + 1), acc["c"] > large
        return F.struct(
            F.when(over, c * part).otherwise(c).alias("c"), F.when(over, total * part).otherwise(total).alias("total"), F.when(over, acc["e"] + 500).otherwise(acc["e"]).alias("e"),
        )

    tail = F.aggregate(F.sequence(F.lit(0), n), start, step, lambda a: a["total"] * F.pow(F.lit(2.0), (a["e"] - n).cast("double")))
    return F.when(n <= 0, F.lit(1.0)).otherwise(tail)


def version_key(label: Column) -> Column:
    """Sort key of version ids: the original first, digits as numbers, letters as text.

    A comparable struct (rank, padded text): digit runs are padded, so that v2 comes before v10.
    """
    low = F.lower(F.trim(label))
    chunks = F.regexp_extract_all(low, F.lit(r"[0-9]+|[a-z]+"), F.lit(0))
    padded = F.transform(chunks, lambda c: F.when(c.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(c, 20, "0"))).otherwise(F.concat(F.lit("1"), c)))
    original = low.isin("orig", "original", "target")
    return F.struct(F.when(original, 0).otherwise(1).alias("rank"), F.when(original, F.array().cast("array<string>")).otherwise(padded).alias("chunks"), low.alias("label"))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity, 0 where either side is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def slug(text: Column, width: int = 40) -> Column:
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", ""), F.lit(width))


def column_index(letters: Column) -> Column:
    """Spreadsheet column letters to a number counted from 1."""
    each = F.split(F.upper(letters), "")
    return F.aggregate(F.filter(each, lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def defect_class(check: Column) -> Column:
    """M01 and M1 are one class, FMT-* is M20, Q* is J3; other ids are classes of their own."""
    clean = F.upper(F.trim(check))
    number = F.regexp_extract(clean, r"^M0*([0-9]+)$", 1)
    return (
        F.when(clean.rlike("^FMT-"), "M20")
        .when(clean.rlike("^Q[0-9]+$"), "J3")
        .when(number != "", F.concat(F.lit("M"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)))
        .otherwise(clean)
    )


def header_tokens(column: Column) -> Column:
    """Words of a table header: camelCase and separators split, lower-cased, distinct."""
    split = F.regexp_replace(column, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(split, r"[^A-Za-z0-9]+", " ")), " "), lambda t: t != ""))


def plural_stem(token: Column) -> Column:
    return F.when(token.rlike("ies$") & (F.length(token) > 4), F.regexp_replace(token, "ies$", "y")).when(
        token.rlike("[^s]s$") & (F.length(token) > 3), F.regexp_replace(token, "s$", "")
    ).otherwise(token)


def cell_number(cell: Column) -> Column:
    """A table cell as a number: currency, percent and grouping removed; ambiguous decimals are null."""
    clean = F.regexp_replace(F.trim(cell), r"[$€£%]", "")
    grouped = clean.rlike(r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$")
    plain = clean.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(grouped, F.regexp_replace(clean, ",", "").try_cast("double")).when(plain, clean.try_cast("double"))


def citation_numbers(inner: Column) -> Column:
    """`1,3-5` as [1, 3, 4, 5]: ranges of up to 80 filled, longer or reversed ones keep their ends,
    and ranges of years go."""
    parts = F.filter(F.transform(F.split(inner, "[,;]"), lambda p: F.trim(p)), lambda p: p.rlike(r"^[0-9]+(\s*[–—-]\s*[0-9]+)?$"))

    def numbers(p: Column) -> Column:
        a = F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(p, r"[–—-]\s*([0-9]+)$", 1), F.lit("")).cast("int"), a)
        ranged = p.rlike(r"[–—-]")
        years = ranged & a.between(1900, 2099) & b.between(1900, 2099)
        fill = (b >= a) & (b - a <= 80)
        ends = F.array_sort(F.array_distinct(F.array(a, b)))
        return F.when(years, F.array().cast("array<int>")).when(fill, F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(ends)

    return F.flatten(F.transform(parts, numbers))


#: Space separators (Unicode's Zs), which DuckDB's trim() takes from both ends; Spark's takes blanks only.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_BLANK, _EDGE = r"\t\n\f\r ", r"(?:(?=\w)(?<!\w)|(?!\w)(?<=\w))"


def trimmed(text: Column) -> Column:
    odd = lambda t: F.left(t, F.lit(1)).isin(*SPACES[1:]) | F.right(t, F.lit(1)).isin(*SPACES[1:])
    return let(F.trim(text), lambda t: F.when(odd(t), F.btrim(t, F.lit(SPACES))).otherwise(t))


def re2(pattern: str) -> str:
    """The pattern by which Java finds what RE2, DuckDB's engine, finds with the one given.

    To Java, accented letters are word characters at `\\b`, `\\s` holds the vertical tab, `$` also stands
    before a last line end, `.` leaves out all line ends, and `(?i)` only ASCII letters: RE2's `s` and `k`
    then match the long s and the Kelvin sign, too.
    """
    out, at, fold, opened = [], 0, False, -1  # opened: where the class at hand has its first member
    folds = {"s": "\u017f", "k": "\u212a"}
    while at < len(pattern):
        c, size = pattern[at], 1
        if c == "\\":
            named = re.match(r"\\[pPx]\{\w+\}", pattern[at:])
            size = named.end() if named else 2
            c = pattern[at : at + size]
            if c == "\\s" or c == "\\S" and opened < 0:
                c = _BLANK if opened >= 0 else f"[{'^' * (c == '\\S')}{_BLANK}]"
            elif c in ("\\S", "\\W", "\\B"):
                raise ValueError(f"not translated: {pattern}")
            elif c == "\\b":  # beside a letter or digit one side is known
                word = "[a-zA-Z0-9]" if not fold else "[a-jl-rt-zA-JL-RT-Z0-9]"
                c = r"(?<!\w)" if re.match(word + r"(?![?*{])", pattern[at + 2 :]) else r"(?!\w)" if re.search(rf"(?<!\\){word}$", pattern[:at]) else _EDGE
            elif c == "\\w" and fold:
                c = r"\w\u017f\u212a" if opened >= 0 else r"[\w\u017f\u212a]"
        elif opened >= 0:
            if c == "]" and at > opened:
                opened = -1
            elif fold and (span := re.match(r"([a-zA-Z])-([a-zA-Z])", pattern[at:])):
                size, c = 3, span[0] + "".join(f for x, f in folds.items() if span[1].lower() <= x <= span[2].lower())
            elif c == "[":
                c = "\\["
            elif fold:
                c += folds.get(c.lower(), "")
        elif c == "[":
            size = 1 + pattern.startswith("[^", at)
            c, opened = pattern[at : at + size], at + size
        elif c == "(" and (flag := re.match(r"\(\?(i\)|<?[:=!])", pattern[at:])):
            size, c, fold = flag.end(), flag[0], fold or flag[1] == "i)"
        elif c in "$.":
            c = r"\z" if c == "$" else r"[^\n]"
        elif fold and c.lower() in folds:
            c = f"[{c}{folds[c.lower()]}]"
        out.append(c)
        at += size
    return "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: an expression named inside a lambda is computed anew for
    each element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str) -> Column:
    """Every match of a pattern from left to right: an array of (start, text), start counted from 0."""
    said = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kept = F.slice(F.split(text, pattern, -1), 1, F.size(said))
    each = F.zip_with(said, kept, lambda s, k: F.struct(F.length(k).alias("gap"), s.alias("text")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(held: Column, m: Column) -> Column:
        start = held["at"] + m["gap"]
        one = F.array(F.struct(start.alias("start"), m["text"].alias("text")))
        return F.struct((start + F.length(m["text"])).alias("at"), F.concat(held["out"], one).alias("out"))

    return F.aggregate(each, none, step)["out"]
