"""Text from files, by format. Each extractor takes bytes and gives blocks (text, source_type, location_ref); errors become
a column, never an exception of the job. Office formats are read with the standard library."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Block = tuple[str, str, str]
MOST_BYTES, CSV_ROWS, LIST_ITEMS, SHEET_ROWS, SHEET_COLUMNS = 256 << 20, 5, 20, 3, 20


def _decode(data: bytes) -> str:
    for name in ("utf-8-sig", "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("cp1252", "replace")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def plain(data: bytes) -> list[Block]:
    text = _decode(data)
    return [(text, "text", "document")] if text.strip() else []


def table_summary(data: bytes) -> list[Block]:
    rows = [r for _, r in zip(range(CSV_ROWS + 1), csv.reader(io.StringIO(_decode(data))), strict=False)]
    if not rows:
        return []
    lines = ["columns: " + ", ".join(rows[0]), *(f"row {k}: " + ", ".join(r) for k, r in enumerate(rows[1:], 2))]
    return [("\n".join(lines), "table", f"rows 1-{len(rows)}")]


def flatten(value, path: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, v in value.items():
            yield from flatten(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for k, v in enumerate(value[:LIST_ITEMS]):
            yield from flatten(v, f"{path}[{k}]")
    else:
        yield f"{path}: {value}" if path else str(value)


def json_lines(data: bytes) -> list[Block]:
    return [("\n".join(flatten(json.loads(_decode(data)))), "text", "document")]


def xml_lines(data: bytes) -> list[Block]:
    def walk(node, depth: int) -> Iterator[str]:
        if node.text and node.text.strip():
            yield "  " * depth + f"{_local(node.tag)}: {node.text.strip()}"
        for child in node:
            yield from walk(child, depth + 1)

    return [("\n".join(walk(ElementTree.fromstring(data), 0)), "text", "document")]


def mail(data: bytes) -> list[Block]:
    m = email.message_from_bytes(data, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    lines = [f"{k}: {m[k]}" for k in ("From", "To", "Subject", "Date") if m[k]]
    names = [a.get_filename() for a in m.iter_attachments() if a.get_filename()]
    return [("\n".join([*lines, "", body.get_content().strip() if body else "", *([f"Attachments: {', '.join(names)}"] if names else [])]), "text", "document")]


def _member(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def docx(data: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(iter(_member(z, "word/document.xml")))
    text = lambda node: "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t")
    paragraphs = [t for p in body if _local(p.tag) == "p" and (t := text(p).strip())]
    out: list[Block] = [("\n\n".join(paragraphs), "text", "document")] if paragraphs else []
    for n, grid in enumerate((x for x in body if _local(x.tag) == "tbl"), 1):
        rows = []
        for r in (x for x in grid.iter() if _local(x.tag) == "tr"):
            cells = [text(c).strip() for c in r if _local(c.tag) == "tc"]
            rows.append(" | ".join(c for k, c in enumerate(cells) if not k or c != cells[k - 1]))
        out.append(("\n".join(rows), "table", f"table {n}"))
    return out


def pptx(data: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for k, name in names:
            parts = [t.text for t in _member(z, name).iter() if _local(t.tag) == "t" and t.text]
            notes = f"ppt/notesSlides/notesSlide{k}.xml"
            if notes in z.namelist():
                parts += ["[Notes]", *(t.text for t in _member(z, notes).iter() if _local(t.tag) == "t" and t.text)]
            if parts:
                out.append(("\n".join(parts), "text", f"slide {k}"))
    return out


def xlsx(data: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter() if _local(t.tag) == "t") for s in _member(z, "xl/sharedStrings.xml")]
        titles = [s.get("name") for s in _member(z, "xl/workbook.xml").iter() if _local(s.tag) == "sheet"]
        for title, name in zip(titles, sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0])), strict=False):
            rows = []
            for r in (x for x in _member(z, name).iter() if _local(x.tag) == "row"):
                cells = []
                for c in list(r)[:SHEET_COLUMNS]:
                    v = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                rows.append(", ".join(cells))
                if len(rows) > SHEET_ROWS:
                    break
            if rows:
                out.append(("\n".join([f"sheet {title}", "columns: " + rows[0], *rows[1:]]), "table", f"sheet {title}"))
    return out


EXTRACTORS: dict[str, Callable[[bytes], list[Block]]] = {
    **dict.fromkeys(("txt", "md"), plain), **dict.fromkeys(("csv", "tsv"), table_summary), "json": json_lines, "xml": xml_lines, "eml": mail, "docx": docx, "pptx": pptx, "xlsx": xlsx,
    **dict.fromkeys(("jpg", "jpeg", "png"), lambda data: []),
}


def sniff(data: bytes) -> str | None:
    if data[:4] == b"PK\x03\x04":
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
        return next((k for k, n in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")) if n in names), None)
    return next((k for m, k in ((b"%PDF", "pdf"), (b"{\\rtf", "rtf"), (b"\xff\xd8\xff", "jpg"), (b"\x89PNG", "png")) if data.startswith(m)), None)


def route(name: str, data: bytes) -> tuple[list[Block], str | None]:
    """Blocks and an error. What the bytes say goes before the suffix, if there is an extractor for it."""
    try:
        if len(data) > MOST_BYTES:
            return [], "TooLarge: skipped"
        kind = sniff(data)
        suffix = name.rsplit(".", 1)[-1].lower()
        f = EXTRACTORS.get(kind or "") or EXTRACTORS.get(suffix)
        return (f(data), None) if f else ([], f"Unsupported: {kind or suffix}")
    except Exception as e:  # noqa: BLE001  one bad file must not end the job
        return [], f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]


def extract(binary: DataFrame) -> DataFrame:
    """Blocks of files as spark.read.format('binaryFile') gives them: path, source_type, location_ref, text, error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"], strict=True):
                blocks, error = route(path, bytes(data))
                rows += [(path, b[1], b[2], b[0], None) for b in blocks] or [(path, None, None, None, error)]
            yield pd.DataFrame(rows, columns=["path", "source_type", "location_ref", "text", "error"])

    return binary.select("path", "content").mapInPandas(run, "path string, source_type string, location_ref string, text string, error string")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, content_hash, size_bytes, modified_at of the files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
