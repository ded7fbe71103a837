"""Files to text: an inventory of a folder with role, status and converted text.

Conversion failures are rows with a status; no file is dropped.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (pattern of the lower-cased path, role): the first that matches decides.
ROLES = (
    (r"cover[_ -]?letter", "cover_letter"),
    (r"supp|appendix", "supplement"),
    (r"fig(ure)?s?[_ /-]", "figure"),
    (r"table", "table"),
    (r"referee|reviewer|response", "response"),
    (r"data[/_]|\.csv$|\.tsv$|\.json$", "data"),
    (r"manuscript|main|paper|article", "manuscript"),
)
TEXT = (".txt", ".md", ".tex", ".csv", ".tsv", ".json", ".py", ".r", ".bib", ".log")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def role_of(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit("other")
    for pattern, role in reversed(ROLES):
        out = F.when(low.rlike(pattern), role).otherwise(out)
    return out


def docx_text(content: bytes) -> str:
    """Paragraphs of body, headers, footers and notes, in that order; hidden runs left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if re.match(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml$", n)]
        for name in sorted(names, key=lambda n: (n != "word/document.xml", n)):
            for p in ElementTree.fromstring(z.read(name)).iter(_W + "p"):
                text = ""
                for run in p.iter(_W + "r"):
                    if run.find(f"{_W}rPr/{_W}vanish") is None:
                        text += "".join("\t" if t.tag == _W + "tab" else "\n" if t.tag == _W + "br" else t.text or "" for t in run if t.tag in (_W + "t", _W + "tab", _W + "br"))
                out.append(text)
    return "\n".join(out)


def xlsx_text(content: bytes) -> str:
    """Sheets in workbook order as tab-separated rows; gaps between cells keep their columns."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")]
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        out = []
        for sheet in book.iter(_S + "sheet"):
            out.append(f"# {sheet.get('name')}")
            part = links[sheet.get(rel)].lstrip("/")
            for row in ElementTree.fromstring(z.read(part if part.startswith("xl/") else "xl/" + part)).iter(_S + "row"):
                cells: list[str] = []
                for c in row.iter(_S + "c"):
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    at = 0
                    for ch in letters:
                        at = at * 26 + ord(ch) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = c.findtext(_S + "v") or "".join(t.text or "" for t in c.iter(_S + "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                out.append("\t".join(cells))
    return "\n".join(out)


def rtf_text(content: bytes) -> str:
    """Text of an RTF file: escapes decoded, destinations such as font tables left out."""
    raw = content.decode("latin-1")
    out, stack, skip, drop = [], [], False, 0
    skipped = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"}
    for m in re.finditer(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|\r?\n|(.)", raw, re.S):
        word, number, code, symbol, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif symbol == "*" or word in skipped:
            skip = True
        elif not skip:
            if word in ("par", "line"):
                out.append("\n")
            elif word == "tab":
                out.append("\t")
            elif word == "u" and number:
                out.append(chr(int(number) % 65536))
                drop = 1
            elif code or plain or (symbol and symbol in "\\{}"):
                if drop:
                    drop = 0
                else:
                    out.append(bytes.fromhex(code).decode("cp1252", "replace") if code else plain or symbol)
    return "".join(out)


def convert(path: str, content: bytes | None) -> tuple[str, str, list[str]]:
    """(text, status, notes) of one file by its extension."""
    ext = re.search(r"\.[^./]*$", path.lower())
    ext = ext[0] if ext else ""
    content = bytes(content or b"")
    if not content:
        return "", "empty", ["no content"]
    try:
        if ext == ".docx":
            return docx_text(content), "ok", []
        if ext == ".xlsx":
            return xlsx_text(content), "ok", []
        if ext == ".rtf":
            return rtf_text(content), "ok", []
        if ext in TEXT:
            text = content.decode("utf-8-sig", "replace")
            gaps = text.count("�")
            return text, "ok", [f"{gaps} undecodable characters"] if gaps else []
    except Exception as e:  # noqa: BLE001  any fault of a foreign file is its status
        return "", "failed", [f"{type(e).__name__}: {e}"[:200]]
    return "", "unsupported", [f"no reader for {ext or 'this file'}"]


def _empty_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files without content, which the binary reader leaves out."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found, it = [], path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    while it.hasNext():
        status = it.next()
        if status.getLen() == 0:
            found.append((status.getPath().toString(), 0, None))
    return spark.createDataFrame(found, "path string, size_bytes long, content binary")


def inventory(spark: SparkSession, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """path, role, ext, size_bytes, sha256, status, notes, text of every file under a folder.

    Files over most_bytes keep their row with status `too large` and are not read into memory.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    small = F.when(F.col("length") <= most_bytes, F.col("content"))
    files = files.select("path", F.col("length").alias("size_bytes"), small.alias("content")).unionByName(_empty_files(spark, folder))
    schema = "path string, size_bytes long, sha256 string, status string, notes array<string>, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                big = r.size_bytes > most_bytes
                text, status, notes = ("", "too large", []) if big else convert(r.path, r.content)
                rows.append((r.path, r.size_bytes, None if big else hashlib.sha256(r.content or b"").hexdigest(), status, notes, text))
            yield pd.DataFrame(rows, columns=["path", "size_bytes", "sha256", "status", "notes", "text"])

    out = files.mapInPandas(run, schema)
    return out.withColumn("role", role_of(F.col("path"))).withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)))


def evidence_only(path: Column) -> Column:
    """Whether a file is evidence and no manuscript: reviewer, response, data or log areas."""
    return F.lower(path).rlike(r"/(data|logs|reviews?|responses?)/|reviewer|response_to|\.log$")
