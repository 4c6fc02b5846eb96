"""Files and pasted notes as documents; paged and word-processor texts."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: What can be read.
PLAIN, HTML, PDF, DOCX = ("txt", "md", "markdown", "json", "csv"), ("html", "htm"), ("pdf",), ("docx",)
MAX_BYTES, MAX_FILES, MIN_NOTE = 50 << 20, 20, 20
OLD_WORD = "The .doc format of old word processors cannot be read; add the file as .docx or .pdf instead."
NO_TITLE, SHORT_NOTE = "Give the note a title.", f"A note has {MIN_NOTE} characters at least."
PAGES = "array<struct<page:int,start:bigint,end:bigint>>"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]*)\z", 1))


def kind(name: Column) -> Column:
    """plain, html, pdf, docx, or unsupported."""
    ext = extension(name)
    return F.when(ext.isin(*PLAIN), "plain").when(ext.isin(*HTML), "html").when(ext.isin(*PDF), "pdf").when(ext.isin(*DOCX), "docx").otherwise("unsupported")


def refusal(name: Column) -> Column:
    """Why a file is not read, or null."""
    ext = extension(name)
    listed = ", ".join("." + x for x in (*PDF, *DOCX, "txt", "md", "markdown", *HTML, "json", "csv"))
    told = F.concat(F.lit('Files of type "'), F.when(ext == "", "unknown").otherwise(F.concat(F.lit("."), ext)), F.lit(f'" cannot be read. These can: {listed}.'))
    return F.when(ext == "doc", OLD_WORD).when(kind(name) == "unsupported", told)


def title_of(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"\.[^./\\]+\z", ""), 1, 300)


_READ = pa.schema([("key", pa.string()), ("marked", pa.string()), ("error", pa.string())])


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_paragraph(p: ElementTree.Element) -> tuple[str, str]:
    """A paragraph's tag and safe text."""
    text = "".join(t.text or "" if t.tag == f"{_W}t" else "\n" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}br"))
    style = next((s.get(f"{_W}val", "") for s in p.iter(f"{_W}pStyle")), "")
    heading = re.fullmatch(r"(?i)heading\s*([1-6])", style)
    listed = p.find(f"{_W}pPr/{_W}numPr") is not None or re.match(r"(?i)list", style)
    return f"h{heading[1]}" if heading else "li" if listed else "p", escape(text, quote=False).replace("\n", "<br/>")


def docx_html(content: bytes) -> str:
    """A word-processor file as HTML: headings, list items and tables kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for block in body if body is not None else ():
        if block.tag == f"{_W}tbl":
            for row in block.iter(f"{_W}tr"):
                cells = (" ".join(_docx_paragraph(p)[1] for p in cell.iter(f"{_W}p")) for cell in row.findall(f"{_W}tc"))
                out.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
            continue
        for p in block.iter(f"{_W}p"):
            tag, text = _docx_paragraph(p)
            out.append(f"<{tag}>{text}</{tag}>")
    return "".join(out)


def pdf_text(content: bytes) -> str:
    """A PDF's text with a line ``-- n of m --`` after each page, by whatever reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("Reading PDF files needs the pypdf package.") from e
    pages = PdfReader(io.BytesIO(content)).pages
    return "".join(f"{p.extract_text()}\n-- {i} of {len(pages)} --\n" for i, p in enumerate(pages, 1))


def _binary(batches):
    for batch in batches:
        rows = {"key": [], "marked": [], "error": []}
        for key, kind_, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
            marked = error = None
            try:
                marked = docx_html(content) if kind_ == "docx" else pdf_text(content)
            except Exception as e:  # a broken file is a failed document, not a failed job
                error = f"{type(e).__name__}: {e}"[:500]
            for c, v in zip(rows, (key, marked, error)):
                rows[c].append(v)
        yield pa.RecordBatch.from_pydict(rows, schema=_READ)


def decoded(content: Column) -> Column:
    """Bytes as text; what is not UTF-8 becomes U+FFFD, so that one file in
    another encoding does not end a job."""
    return F.make_valid_utf8(content.cast("string"))


def extracted(files: DataFrame, key: str = "path") -> DataFrame:
    """Text of files (path, content): path, text, pages, page_count, byte_size,
    error, and ``key``, which names a file and is the path unless paths repeat."""
    named = [key] if key == "path" else [key, "path"]
    read = files.select(*named, kind(F.col("path")).alias("kind"), refusal(F.col("path")).alias("error"), F.length("content").cast("long").alias("byte_size"), "content")
    read = read.withColumn("error", F.coalesce("error", F.when(F.col("byte_size") > MAX_BYTES, f"Files of over {MAX_BYTES >> 20} MB are not read.")))
    none = [F.lit(None).cast(PAGES).alias("pages"), F.lit(None).cast("int").alias("page_count")]
    # Plain and marked-up files become texts where they are; the others go through a reader first.
    raw = decoded(F.col("content"))
    text = F.when(F.col("error").isNotNull(), None).when(F.col("kind") == "plain", T.clean(raw)).when(F.col("kind") == "html", T.html_text(raw))
    packed = F.col("error").isNull() & F.col("kind").isin("docx", "pdf")
    direct = read.filter(~packed).select(*named, text.alias("text"), *none, "byte_size", "error")
    opened = read.filter(packed).select(F.col(key).alias("key"), "kind", "content").mapInArrow(_binary, "key string, marked string, error string")
    about = read.filter(packed).select(F.col(key).alias("key"), *([] if key == "path" else ["path"]), "kind", "byte_size")
    opened = opened.join(about, "key")
    path = [F.col("key").alias("path")] if key == "path" else [F.col("key").alias(key), "path"]
    docx = opened.filter("kind = 'docx'").select(*path, F.when(F.col("marked").isNotNull(), T.html_text(F.col("marked"))).alias("text"), *none, "byte_size", "error")
    paged_ = opened.filter("kind = 'pdf'")
    pdf = paged_.join(paged(paged_.select("key", "marked"), "key"), "key", "left").select(*path, "text", "pages", "page_count", "byte_size", "error")
    return direct.unionByName(docx).unionByName(pdf)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


#: Fixed values. Kinds of a page's lines, the first that fits: what the line looks like, its greatest length and number of words, endings that rule it out.
_LINES = (
    ("blank", re.compile(r"\Z"), 0, 0, ""),
    ("item", re.compile(r"(?:[-–—*•]|[0-9]+[.)])\s+"), None, None, ""),
    ("marked", re.compile(r"#{1,6}\s"), 90, None, ""),
    ("heading", re.compile(r"[0-9]+(?:\.[0-9]+)*[.)]\s+\S"), 90, None, ".!?"),
    ("heading", re.compile(f"[{T.CAPITALS}0-9]"), 90, 8, ".!?,;:"),
    ("text", re.compile(""), None, None, ""),
)
#: Fixed patterns: what ends a line for good, and what goes on from the line before.
_STOPPED = re.compile(r"""[.!?:;]["')\]]?\Z""")
_GOES_ON = re.compile(r"[a-zăâîșț(]")
#: Fixed value: a paragraph shorter than this goes on in any text line.
_WRAPPED = 90


def line_kind(line: str) -> str:
    return next(
        kind for kind, looks, longest, words, ends in _LINES
        if looks.match(line) and (longest is None or len(line) <= longest) and (words is None or len(line.split()) <= words) and (not ends or line[-1] not in ends)
    )


def reflowed(text: str) -> str:
    """Lines of a page put together as paragraphs. Items and headings stand
    alone; a text line goes on with the text line before it, unless that ended a
    sentence, or was long and this one starts anew."""
    out: list[str] = []
    before = "blank"
    for line in map(str.strip, text.split("\n")):
        kind_ = line_kind(line)
        wraps = kind_ == before == "text" and not _STOPPED.search(out[-1]) and (_GOES_ON.match(line) or len(out[-1]) < _WRAPPED)
        before = kind_
        if wraps:
            out[-1] += f" {line}"
        elif kind_ != "blank":
            out.append(f"## {line}" if kind_ == "heading" else line)
    return "\n\n".join(out)


def _reflow(batches):
    for batch in batches:
        i = batch.schema.get_field_index("body")
        yield batch.set_column(i, "body", pa.array([None if x is None else reflowed(x) for x in batch.column(i).to_pylist()], pa.string()))


def paged(marked: DataFrame, key: str) -> DataFrame:
    """Page texts put together, with the map of pages: key, text, pages,
    page_count. Pages end at lines ``-- n of m --``; without any, there is no
    map. Pages without text are not in the map, but are counted. Offsets are
    running lengths, by a window."""
    cut = marked.select(key, F.posexplode(F.split("marked", r"(?m)(?<=^-- \d{1,9} of \d{1,9} --$)")).alias("i", "part"))
    number = F.regexp_extract("part", r"(?m)^-- (\d+) of \d+ --\z", 1)
    body = T.clean(F.regexp_replace("part", r"(?m)^-- \d+ of \d+ --\z", ""))
    total = F.regexp_extract("part", r"(?m)^-- \d+ of (\d+) --\z", 1)
    cut = cut.select(key, "i", F.nullif(number, F.lit("")).cast("int").alias("number"), F.nullif(total, F.lit("")).cast("int").alias("total"), body.alias("body"))
    cut = cut.mapInArrow(_reflow, cut.schema).filter("body <> '' OR number IS NOT NULL")
    order = Window.partitionBy(key).orderBy("i")
    full = cut.filter("body <> ''")
    place = full.withColumn("_nth", F.row_number().over(order)).withColumn("size", F.length("body") + F.when(F.col("_nth") > 1, 2).otherwise(0))
    place = place.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct(F.coalesce("number", "_nth").cast("int").alias("page"), (F.col("end") - F.col("size")).cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    rows = F.array_sort(F.collect_list(F.struct("i", "body", entry.alias("p"))))
    marks = cut.groupBy(key).agg(F.max("total").alias("total"))
    whole = marks.join(place.groupBy(key).agg(rows.alias("rows")), key, "left")
    pages = F.when(F.col("total").isNotNull(), F.transform("rows", lambda r: r["p"]))
    text = F.coalesce(F.array_join(F.transform("rows", lambda r: r["body"]), "\n\n"), F.lit(""))
    return whole.select(key, text.alias("text"), pages.alias("pages"), F.col("total").alias("page_count"))


def notes(rows: DataFrame) -> DataFrame:
    """Pasted notes (title, text) as files: path, content, error."""
    text, title = T.trimmed(F.coalesce("text", F.lit(""))), T.trimmed(F.coalesce("title", F.lit("")))
    error = F.when(title == "", NO_TITLE).when(F.length(text) < MIN_NOTE, SHORT_NOTE)
    return rows.select(F.concat(title, F.lit(".md")).alias("path"), F.encode(text, "UTF-8").alias("content"), error.alias("error"))


def checked_upload(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The files of one upload, refused if there are too many; one that is too
    large fails alone, when it is read."""
    if files.limit(most + 1).count() > most:
        raise ValueError(f"At most {most} files can be uploaded together.")
    return files
