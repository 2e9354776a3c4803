"""File listings, documents and office files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import portions, text_batches

# Extensions by kind, and folders that are never entered.
EXTENSIONS = {
    "video": ("mp4", "mov", "m4v", "mkv", "webm", "avi"),
    "audio": ("mp3", "m4a", "wav", "flac", "aac", "ogg", "opus"),
    "image": ("jpg", "jpeg", "png", "webp", "gif", "bmp", "tiff", "heic"),
    "document": ("pdf", "md", "markdown", "txt", "docx", "pptx"),
}
IGNORED = (".git", "node_modules", ".cache", "target", "dist", "build", "__pycache__", ".venv", "venv")
BUDGET = 3200  # characters of a document chunk
PART_LIMIT = 20 << 20  # bytes of one part of an office file
LISTING = "path string, modificationTime timestamp, length long, content binary"


def listed(files: DataFrame, kind: str, root: str = "") -> DataFrame:
    """The columns of a discovered item from a binaryFile listing (without its content): only the kind's extensions, no ignored folder below the root."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    below = F.substring_index("path", root, -1) if root else F.col("path")
    folders = "|".join(re.escape(x) for x in IGNORED)
    kept = files.select("path", "length", F.col("modificationTime").cast("long").alias("modified")).where(ext.isin(*EXTENSIONS[kind])).where(~below.rlike(rf"/({folders})/"))
    external = F.left(F.sha2(F.concat_ws(":", "path", F.col("length").cast("string"), F.col("modified").cast("string")), 256), F.lit(16))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return kept.select(external.alias("external_id"), title.alias("title"), F.col("path").alias("raw_path"), F.lit(kind).alias("content_type"), "length", "modified")


def scan_files(spark: SparkSession, roots: list[str], kind: str) -> DataFrame:
    """A1: recursive listing of the roots; contents are never read."""
    found = None
    for root in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        part = listed(files, kind, root.rstrip("/"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("raw_path")


def watch_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """A2: A1 as a stream; hand each batch to the discovery merge with foreachBatch."""
    return listed(spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True).load(root), kind, root.rstrip("/"))


def _pieces(block: str) -> Iterator[str]:
    """Parts of a paragraph within the budget: cut at words, and words that are longer at characters."""
    line = ""
    for word in block.split(" "):
        while len(word) > BUDGET:
            if line:
                yield line
                line = ""
            yield word[:BUDGET]
            word = word[BUDGET:]
        if line and len(line) + 1 + len(word) > BUDGET:
            yield line
            line = word
        else:
            line = f"{line} {word}" if line else word
    if line:
        yield line


def split_text(text: str | None) -> list[tuple[str, str | None]]:
    """(text, section) chunks of one document: headings begin a chunk, paragraphs are packed up to the budget."""
    out: list[tuple[str, str | None]] = []
    section, held = None, ""

    def close() -> None:
        nonlocal held
        if held.strip():
            out.append((held.strip(), section))
        held = ""

    for raw in re.split(r"\n[ \t]*\n|\n(?=#{1,6}\s)|(?<=\n)(?=#{1,6}\s)", (text or "").replace("\r\n", "\n").replace("\r", "\n")):
        lines = [" ".join(x.split()) for x in raw.split("\n")]
        lines = [x for x in lines if x]
        if not lines:
            continue
        if re.match(r"#{1,6}\s", lines[0]):
            close()
            section = lines[0].lstrip("#").strip() or None
        paragraph = "\n".join(lines)
        if held and len(held) + 2 + len(paragraph) > BUDGET:
            close()
        if len(paragraph) > BUDGET:
            for piece in _pieces(paragraph):
                held = piece
                close()
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
    close()
    return out


def split_documents(docs: DataFrame) -> DataFrame:
    """(item_id, ord, page, text, section) of docs (item_id, page, text); one Arrow pass in portions of a bounded size, nothing is shuffled."""
    schema = pa.schema([("item_id", pa.string()), ("ord", pa.int32()), ("page", pa.int64()), ("text", pa.string()), ("section", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "text"):
            rows = [(i, k, p, t, s) for i, p, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (t, s) in enumerate(split_text(x))]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 5, schema.types, strict=True)], schema=schema)

    return text_batches(docs).select(F.col("item_id").cast("string").alias("item_id"), F.col("page").cast("long").alias("page"), "text").mapInArrow(run, "item_id string, ord int, page long, text string, section string")


def _named(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes) -> str:
    """Text of an office part: runs of a paragraph together, a break after each."""
    out: list[str] = []
    for paragraph in (e for e in ElementTree.fromstring(xml).iter() if _named(e.tag) == "p"):
        text = "".join("\t" if _named(e.tag) == "tab" else "\n" if _named(e.tag) == "br" else (e.text or "") if _named(e.tag) == "t" else "" for e in paragraph.iter())
        if text.strip():
            out.append(text.strip())
    return "\n\n".join(out)


def office_pages(name: str, content: bytes) -> list[tuple[int, str]]:
    """(page, text): the body of a docx, or the slides of a pptx in the order of their numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if name.lower().endswith(".docx"):
            parts = [(1, "word/document.xml")]
        else:
            parts = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        out = []
        for page, part in parts:
            if z.getinfo(part).file_size > PART_LIMIT:
                raise ValueError(f"{part} is larger than {PART_LIMIT} bytes")
            out.append((page, _paragraphs(z.read(part))))
        return out


def extract_office_text(files: DataFrame) -> DataFrame:
    """A10: (path, page, text, error) of a binaryFile table, a batch a file; a bad or oversized file is one row with its error."""
    schema = pa.schema([("path", pa.string()), ("page", pa.int64()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "content"):
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                name = path.as_py()
                try:
                    rows = [(name, page, text, None) for page, text in office_pages(name, content.as_py())]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    rows = [(name, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), schema.types, strict=True)], schema=schema)

    office = F.lower("path").rlike(r"\.(docx|pptx)$")
    return text_batches(files).where(office).select("path", "content").mapInArrow(run, "path string, page long, text string, error string")


def rejects(df: DataFrame, error: Column | str = "error") -> tuple[DataFrame, DataFrame]:
    """(good, rejects)."""
    e = F.col(error) if isinstance(error, str) else error
    return df.where(e.isNull()), df.where(e.isNotNull())
