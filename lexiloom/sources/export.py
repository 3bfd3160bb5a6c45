"""Notes as plain text, Markdown, Word and PDF documents.

Text and Markdown are column expressions. Word and PDF files are put together by small writers of
our own, in Arrow batches; each document is made on its own and never gathered.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.session import ship

# ---- fixed values -------------------------------------------------------------------------
PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 210.0, 297.0, 20.0  # mm
BODY_SIZE, TITLE_SIZE, LINE_HEIGHT, CHAR_WIDTH = 11.0, 20.0, 6.0, 0.50
POINT = 0.3528  # mm
TITLE_GAP = 1.8
LINE_CHARS = max(20, int((PAGE_WIDTH - 2 * MARGIN) / (BODY_SIZE * CHAR_WIDTH * POINT)))
FORMATS = {"md": "md", "markdown": "md", "docx": "docx", "word": "docx", "txt": "txt", "pdf": "pdf"}
# ---- end of fixed values ------------------------------------------------------------------
#: Bytes of files that a Python worker holds at once.
PART_BYTES = 1 << 22


def parse_format(name: str) -> str:
    try:
        return FORMATS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no such format: {name}") from None


def as_txt(title: Column, body: Column) -> Column:
    """Pages between form feeds, under the title unless the text begins with it."""
    pages = F.array_join(T.split_pages(body), "\f\n")
    return F.when(T.body_starts_with_title(title, body), pages).otherwise(F.concat(title, F.lit("\n\n"), pages))


def as_markdown(title: Column, body: Column) -> Column:
    """Pages under numbered banners, if there are several."""
    pages = T.split_pages(body)
    several = F.array_join(F.transform(pages, lambda p, i: F.concat(T.page_banner(i + 1), F.lit("\n\n"), p)), "\n\n")
    text = F.when(F.size(pages) > 1, several).otherwise(F.regexp_replace(body, r"\A\n+|\n+\z", ""))
    return F.when(T.body_starts_with_title(title, body), text).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), text))


_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _xml(s: str) -> str:
    return escape("".join(c for c in s if c in "\t\n" or (c >= " " and c not in "￾￿" and not "\ud800" <= c <= "\udfff")))


def docx_bytes(title: str, pages: list[str]) -> bytes:
    run = lambda t: f'<w:p><w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>'
    out = [f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:rPr><w:b/><w:sz w:val="36"/></w:rPr><w:t xml:space="preserve">{_xml(title)}</w:t></w:r></w:p><w:p/>']
    for i, page in enumerate(pages):
        if i:
            out.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        out += [run(line) if line.strip() else "<w:p/>" for line in (page.split("\n") if page else [])]
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{_NS}"><w:body>{"".join(out)}</w:body></w:document>'
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", document)):
            z.writestr(zipfile.ZipInfo(name), content)  # no clock in it: equal notes give equal files
    return made.getvalue()


def pdf_bytes(title: str, pages: list[list[str]]) -> bytes:
    """A4 pages of lines in Helvetica; the lines are Latin-1 and wrapped already."""
    mm = 1 / POINT
    string = lambda s: "(" + s.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") + ")"
    sheets: list[list[str]] = [[]]
    y = PAGE_HEIGHT - MARGIN
    put = lambda font, size, s: sheets[-1].append(f"BT /{font} {size:g} Tf {MARGIN * mm:.2f} {y * mm:.2f} Td {string(s)} Tj ET")
    put("F2", TITLE_SIZE, title)
    y -= LINE_HEIGHT * TITLE_GAP
    for i, lines in enumerate(pages):
        if i:
            sheets.append([])
            y = PAGE_HEIGHT - MARGIN
        for line in lines:
            if y < MARGIN:
                sheets.append([])
                y = PAGE_HEIGHT - MARGIN
            put("F1", BODY_SIZE, line)
            y -= LINE_HEIGHT
    n = len(sheets)
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(n))
    font = lambda name: f"<< /Type /Font /Subtype /Type1 /BaseFont /{name} /Encoding /WinAnsiEncoding >>".encode()
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {n} >>".encode(), font("Helvetica"), font("Helvetica-Bold")]
    for k, sheet in enumerate(sheets):
        stream = "\n".join(sheet).encode("latin-1", "replace")
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {PAGE_WIDTH * mm:.2f} {PAGE_HEIGHT * mm:.2f}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents {6 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
    out, places = io.BytesIO(), []
    out.write(b"%PDF-1.4\n")
    for k, o in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n" % k + o + b"\nendobj\n")
    at = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))
    return out.getvalue()


_SPACES = " \t\n\x0b\x0c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def wrapped(line: str, width: int) -> list[str]:
    """T.wrap_line() of one line, in time that grows with the line."""
    if not line.strip(_SPACES):
        return [""]
    cut = lambda s: [s[i : i + width] for i in range(0, max(len(s), 1), width)]
    out = [""]
    for word in line.split(" "):
        last = out[-1]
        if last == "" or len(last) + 1 + len(word) <= width:
            out[-1:] = cut(f"{last} {word}" if last else word)
        else:
            out += cut(word)
    return out[:-1] if out[-1] == "" and len(out) > 1 else out


def _pdf(title: str, pages: list[str], twice: bool) -> bytes:
    """Wrapped pages; a line of the first page that repeats the title is left out."""
    sheets = []
    for i, page in enumerate(pages):
        kept = (x for x in page.split("\n") if not (twice and i == 0 and x.strip(_SPACES) == title.strip(_SPACES)))
        sheets.append([part for x in kept for part in wrapped(x, LINE_CHARS)])
    return pdf_bytes(title, sheets)


def _writer(write: Callable):
    """Files, put out as soon as there are PART_BYTES of them."""

    def made(paths: list, files: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            paths, files, size = [], [], 0
            for row in zip(*(batch.column(i) for i in range(4)), strict=True):
                path, title, pages, twice = (x.as_py() for x in row)
                paths.append(path)
                files.append(write(title or "", pages or [], bool(twice)))
                size += len(files[-1])
                if size >= PART_BYTES:
                    yield made(paths, files)
                    paths, files, size = [], [], 0
            if files:
                yield made(paths, files)

    return run


def named(notes: DataFrame, ending: str) -> DataFrame:
    """notes with `path`: the title's safe name and, where several notes would have it (in any case), the note's id."""
    rows = notes.withColumn("_name", T.safe_file_name(F.col("title"))).withColumn("_low", F.lower("_name"))
    if "id" not in notes.columns:
        return rows.withColumn("path", F.concat("_name", F.lit(f".{ending}"))).drop("_name", "_low")
    several = rows.groupBy("_low").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_low", F.lit(True).alias("_several"))
    rows = rows.join(several, "_low", "left")
    return rows.withColumn("path", F.concat("_name", F.when(F.col("_several"), F.concat(F.lit("-"), T.safe_file_name(F.col("id")))).otherwise(""), F.lit(f".{ending}"))).drop("_name", "_low", "_several")


def exported(notes: DataFrame, format_name: str) -> DataFrame:
    """(path, content) of notes with title and body, for sources.notes.write_files."""
    ship(notes.sparkSession)
    kind = parse_format(format_name)
    title, body = F.col("title"), F.col("body")
    rows = named(notes, kind)
    if kind in ("txt", "md"):
        made = as_txt(title, body) if kind == "txt" else as_markdown(title, body)
        return rows.select("path", made.cast("binary").alias("content"))
    pages, twice = T.split_pages(body), T.body_starts_with_title(title, body)
    if kind == "docx":
        rows = rows.select("path", title.alias("title"), pages.alias("pages"), twice.alias("twice"))
    else:
        rows = rows.select("path", T.sanitize_for_pdf(title).alias("title"), T.split_pages(T.sanitize_for_pdf(body)).alias("pages"), twice.alias("twice"))
    write = (lambda t, p, _: docx_bytes(t, p)) if kind == "docx" else _pdf
    return rows.mapInArrow(_writer(write), "path string, content binary")
