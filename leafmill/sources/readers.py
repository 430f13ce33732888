"""Readers of files: texts, HTML, archives, word documents, JSON books, logs and tables of words.

Listing reads no contents (the column is pruned); contents are read only for files that go on to an
extractor. Extractors that need programs or services (PDF, OCR, office formats) are functions that
the caller passes in: ``bytes -> list of page texts``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions import text as tx

#: File names that are read; those a flat listing leaves out.
READABLE = tuple(tx.SOURCE_TYPES)
SKIPPED = (".json", ".py", ".md", ".log", ".lock", ".tmp")
PAGES = "array<string>"
BOOK = T.StructType([
    *[T.StructField(c, T.StringType()) for c in ("book_id", "filename", "language", "title", "json_path", "source_root", "source_path", "source_relpath", "source_ext", "source_type", "document_type", "source_hash", "content_hash", "text_hash", "extractor", "quality_status", "conversion_status", "review_status")],
    T.StructField("size_bytes", T.LongType()), T.StructField("total_pages", T.IntegerType()), T.StructField("text_simhash", T.DecimalType(20, 0)), T.StructField("intake_ready", T.BooleanType()),
    T.StructField("pages", T.ArrayType(T.StructType([T.StructField("page", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("page_quality_status", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType()),
])
QUERY = "query string, must_have array<string>, expected_titles array<string>, language string"


def scan_files(spark: SparkSession, folder: str, recursive: bool = True, contents: bool = False) -> DataFrame:
    """path, relpath, ext, length, modified (and content) of readable files, in no order.

    Spark's file sources don't list files of no bytes; such a file would have no page anyway.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    root = re.sub(r"/+$", "", folder)
    rows = files.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).withColumn("ext", tx.extension(F.col("path")))
    rows = rows.where(F.col("ext").isin(*READABLE) & ~F.element_at(F.split("path", "/"), -1).startswith(".~lock."))
    rel = F.when(F.startswith("path", F.lit(root + "/")), F.substr("path", F.lit(len(root) + 2))).otherwise(F.col("path"))
    return rows.select("path", rel.alias("relpath"), "ext", "length", F.col("modificationTime").alias("modified"), *(["content"] if contents else []))


def list_flat(spark: SparkSession, folder: str) -> DataFrame:
    """path of the files directly in a folder that are no byproducts, in no order."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    return files.where(~tx.extension(F.col("path")).isin(*SKIPPED))


def with_contents(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The files of ``scan_files`` with their bytes and SHA-256, in the same one scan."""
    return scan_files(spark, folder, recursive, contents=True).withColumn("source_hash", F.sha2("content", 256))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.piece: list[str] = []  # the parser cuts one stretch of text at a "<" that opens no tag
        self.hidden = 0

    def end_piece(self) -> None:
        piece = "".join(self.piece)
        if piece.strip():
            self.parts.append(piece)
        self.piece.clear()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_piece()
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        self.end_piece()
        if tag in ("script", "style", "noscript") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.piece.append(data)

    def handle_comment(self, data: str) -> None:
        self.end_piece()

    def handle_decl(self, decl: str) -> None:
        self.end_piece()

    def handle_pi(self, data: str) -> None:
        self.end_piece()

    def unknown_decl(self, data: str) -> None:
        self.end_piece()


def _split(text: str) -> list[str]:
    return [p for p in (x.strip() for x in re.split("\f+", text)) if p]


def html_text(markup: str) -> str:
    """The visible text of a page, one line a piece."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    parser.end_piece()
    return "\n".join(parser.parts)


def text_pages(data: bytes) -> list[str]:
    text = data.decode("utf-8", "replace")
    return _split(text) or [text.strip()]


def html_pages(data: bytes) -> list[str]:
    return _split(html_text(data.decode("utf-8", "replace")))


def archive_pages(data: bytes) -> list[str]:
    """Pages of the XHTML members of an archive, by member name."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if n.lower().endswith((".xhtml", ".html", ".htm")))
        return [p for n in names for p in html_pages(z.read(n))]


def word_pages(data: bytes) -> list[str]:
    """Pages of a word document: paragraphs between page breaks."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    pages, lines = [], []
    for p in root.iter(f"{w}p"):
        parts: list[str] = []
        for x in p.iter():
            if x.tag == f"{w}lastRenderedPageBreak" or (x.tag == f"{w}br" and x.get(f"{w}type") == "page"):
                lines.append("".join(parts))
                pages.append("\n".join(lines).strip())
                parts, lines = [], []
            elif x.tag == f"{w}t":
                parts.append(x.text or "")
        lines.append("".join(parts))
    pages.append("\n".join(lines).strip())
    return [p for p in pages if p]


EXTRACTORS: dict[str, tuple[str, Callable[[bytes], list[str]]]] = {
    ".txt": ("txt", text_pages), ".htm": ("html", html_pages), ".html": ("html", html_pages), ".docx": ("docx", word_pages), ".epub": ("zip-xhtml", archive_pages), ".ibooks": ("zip-xhtml", archive_pages),
}


def extract(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """path, extractor, pages, problem of files with contents; unknown kinds and failures have no pages."""
    table = EXTRACTORS | (extractors or {})
    rest = [c for c in files.columns if c != "content"]
    schema = T.StructType([files.schema[c] for c in rest] + [T.StructField("extractor", T.StringType()), T.StructField("pages", T.ArrayType(T.StringType())), T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ext, data in zip(pdf["ext"], pdf["content"]):
                name, function = table.get(ext, ("", None))
                try:
                    out.append((name, function(data) if function else [], None if function else "no extractor"))
                except Exception as e:  # noqa: BLE001 - a broken file is a row, not a failed job
                    out.append((name, [], f"{type(e).__name__}: {e}"[:200]))
            yield pdf[rest].assign(extractor=[x[0] for x in out], pages=[x[1] for x in out], problem=[x[2] for x in out])

    return files.mapInPandas(run, schema)


#: The suffix whose extractor reads files of a source type.
SUFFIXES = {"txt": ".txt", "html": ".html", "docx": ".docx", "pdf": ".pdf", "epub": ".epub", "ibooks": ".epub", "doc": ".doc"}


def preview(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """``extract`` for files of records: by ``source_type``, else by the suffix, else as plain text; blank pages are dropped.

    ``files``: path, source_type, content. Failures have no pages.
    """
    kinds = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    suffix = tx.extension(F.col("path"))
    ext = F.coalesce(kinds[F.lower(F.trim(F.coalesce("source_type", F.lit(""))))], F.when(suffix.isin(*READABLE), suffix), F.lit(".txt"))
    return extract(files.withColumn("ext", ext), extractors).withColumn("pages", F.filter("pages", lambda p: F.trim(p) != ""))


def longest(*candidates: Callable[[bytes], list[str]]) -> Callable[[bytes], list[str]]:
    """An extractor that takes the longest text of several; one that fails counts as empty."""

    def run(data: bytes) -> list[str]:
        found: list[list[str]] = []
        for one in candidates:
            try:
                found.append(one(data))
            except Exception:  # noqa: BLE001 - another extractor may do
                continue
        return max(found, key=lambda pages: sum(map(len, pages)), default=[])

    return run


def numbered_pages(extracted: DataFrame, key: str = "path") -> DataFrame:
    return extracted.select(key, F.posexplode("pages").alias("pos", "content")).select(key, (F.col("pos") + 1).alias("page_num"), "content")


@F.pandas_udf(T.StringType())
def visible_text(markup: pd.Series) -> pd.Series:
    """Column function: the visible text of HTML."""
    return markup.map(lambda t: None if t is None else html_text(t))


def visible_text_native(markup):
    """The same with regular expressions only: scripts and tags dropped, the common entities resolved."""
    bare = F.regexp_replace(F.regexp_replace(markup, "(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>", ""), "<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return tx.strip(F.regexp_replace(bare, "\\s*\\n\\s*", "\n"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Book documents (one JSON file each) with a fixed schema; broken files keep only _corrupt_record."""
    return spark.read.schema(BOOK).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def book_pages(books: DataFrame) -> DataFrame:
    return books.where("_corrupt_record IS NULL AND pages IS NOT NULL").select("book_id", F.explode("pages").alias("p")).select("book_id", F.col("p.page").alias("page_num"), F.coalesce("p.content", F.lit("")).alias("content"), "p.page_quality_status")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """The query set of a JSONL file or a folder of them; blank lines and comments are skipped."""
    lines = spark.read.option("pathGlobFilter", "*.jsonl").text(path).select(F.trim("value").alias("v"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("source_file"))
    rows = lines.where("v <> '' AND NOT startswith(v, '#')").select(F.from_json("v", QUERY).alias("q"), "source_file")
    return rows.where("q.query IS NOT NULL").select("q.*", "source_file").withColumn("language", F.coalesce("language", F.lit("id")))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only JSONL log without its broken lines."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of that schema where there is none yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Recognised words from TSV with a header; short rows are dropped."""
    rows = spark.read.option("sep", "\t").option("header", "true").option("quote", "").option("mode", "DROPMALFORMED").csv(path)
    numbers = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height")
    return rows.withColumns({c: F.expr(f"try_cast({c} as int)") for c in numbers if c in rows.columns} | {"conf": F.expr("try_cast(conf as double)")})


def nested_items(spark: SparkSession, path: str, needed: tuple[str, ...] = ("id", "chapterId", "bookId", "arabic")) -> DataFrame:
    """file, item (JSON): every object, at any depth of JSON files, that has the needed keys."""
    import json

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path).select("path", "content")

    def descend(x):
        if isinstance(x, dict):
            if all(k in x for k in needed):
                yield x
            for v in x.values():
                yield from descend(v)
        elif isinstance(x, list):
            for v in x:
                yield from descend(v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, data in zip(pdf["path"], pdf["content"]):
                try:
                    out += [(name, json.dumps(x, ensure_ascii=False)) for x in descend(json.loads(data))]
                except ValueError:
                    continue
            yield pd.DataFrame(out, columns=["file", "item"])

    return files.mapInPandas(run, "file string, item string")


def read_collection(spark: SparkSession, folder: str, name: str, listed: tuple[str, ...] = ()) -> DataFrame:
    """key, item (JSON) of a collection: from the first file that exists of ``listed`` and four usual places below ``folder``.

    A JSON object is keyed already; items of a list, and of JSON lines, are keyed by id, key or number, the last of
    equal ones counts; broken files have no items. A collection is one file, read as one row.
    """
    import json

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    places = [p for p in (*listed, f"{folder}/{name}.json", f"{folder}/{name}.jsonl", f"{folder}/by_book/{name}.json", f"{folder}/by_book/{name}.jsonl") if p]
    found = next((p for p in places if (h := hadoop(p)).getFileSystem(conf).exists(h)), None)
    if found is None:
        return spark.createDataFrame([], "key string, item string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, str] = {}
            for path, data in zip(pdf["path"], pdf["content"]):
                try:
                    text = data.decode("utf-8", "replace")
                    whole = [json.loads(x) for x in text.splitlines() if x.strip()] if path.endswith(".jsonl") else json.loads(text)
                except ValueError:
                    continue
                pairs = whole.items() if isinstance(whole, dict) else [(x.get("id") or x.get("key") or x.get("number"), x) for x in whole if isinstance(x, dict)]
                out |= {str(k): json.dumps(v, ensure_ascii=False) for k, v in pairs if k is not None}
            yield pd.DataFrame(list(out.items()), columns=["key", "item"])

    return spark.read.format("binaryFile").load(found).select("path", "content").mapInPandas(run, "key string, item string")


def jsonp(text):
    """The JSON inside a callback."""
    return F.coalesce(F.nullif(F.regexp_extract(text, "(?s)^\\s*[\\w.$]+\\((.*)\\)\\s*;?\\s*$", 1), F.lit("")), text)


def inventory(paths: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """full_path, content_hash of hashed files below ``prefix``: a join of two tables with filters pushed down."""
    done = files.where("hash_status = 'done' AND content_hash IS NOT NULL").select(F.col("id").alias("file_id"), "content_hash", "size_bytes")
    return paths.where(F.startswith("full_path", F.lit(prefix))).select("file_id", "full_path").join(done, "file_id").select("full_path", "content_hash", "size_bytes")

