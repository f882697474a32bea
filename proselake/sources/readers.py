"""Sources: text folders with manifests, HTML, EPUB and CoNLL-U files, chapters of a manuscript."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proselake.functions.text import unify_line_ends

#: Encodings tried in order when bytes are decoded.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
#: Limits of an archive: entries, bytes of one, bytes of all, ratio of unpacked to packed.
MAX_FILES, MAX_ENTRY, MAX_TOTAL, MAX_RATIO = 10_000, 20 << 20, 100 << 20, 200


def _ids(df: DataFrame) -> DataFrame:
    """doc_id from the path, so that the same file has the same id in every run and no global order is needed."""
    return df.withColumn("doc_id", F.xxhash64("path"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text): a row for each .txt or .md file below a folder, or for one file. Text must be UTF-8."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return _ids(d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))).select("doc_id", "path", "text")


def with_manifest(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Texts with the fields of a manifest (a table with a column file: the end of a path); texts without an entry keep nulls."""
    name = F.element_at(F.split("path", "/"), -1)
    fields = [c for c in manifest.columns if c != "file"]
    m = manifest.select(F.element_at(F.split("file", "/"), -1).alias("__name"), *(F.col(c).alias(c if c not in texts.columns else f"manifest_{c}") for c in fields)).dropDuplicates(["__name"])
    return texts.withColumn("__name", name).join(m, "__name", "left").drop("__name")


def decoded(binary: DataFrame) -> DataFrame:
    """(doc_id, path, text, encoding) of binary files (path, content): the first encoding that fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, used = [], []
            for raw in b.column(1).to_pylist():
                text = name = None
                for name in ENCODINGS if raw is not None else ():
                    try:
                        text = raw.decode(name)
                        break
                    except UnicodeDecodeError:
                        continue
                texts.append(text), used.append(name if raw is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(used, pa.string())], ["path", "text", "encoding"])

    return _ids(binary.select("path", "content").mapInArrow(run, "path string, text string, encoding string"))


def html_text(html: Column) -> Column:
    """Readable text of HTML: scripts, styles and navigation gone, line ends at blocks, common entities resolved. JVM only."""
    t = F.regexp_replace(html, r"(?is)<(script|style|nav|template|noscript)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(?:p|div|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|blockquote|pre|title|body)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[A-Za-z/!][^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


def _epub(raw: bytes | None) -> tuple[str | None, str | None]:
    """(text of an EPUB's spine in order, None), or (None, why it was refused): it isn't one or breaks the limits that keep archives from bursting."""
    if raw is None:
        return None, "no content"
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        infos = z.infolist()
        if len(infos) > MAX_FILES or sum(i.file_size for i in infos) > MAX_TOTAL or any(i.file_size > MAX_ENTRY or i.file_size > MAX_RATIO * max(1, i.compress_size) for i in infos):
            return None, "beyond the limits of files, sizes or compression"
        ns = {"c": "urn:oasis:names:tc:opendocument:xmlns:container", "o": "http://www.idpf.org/2007/opf"}
        opf = ElementTree.fromstring(z.read("META-INF/container.xml")).find(".//c:rootfile", ns).get("full-path")
        root = ElementTree.fromstring(z.read(opf))
        items = {i.get("id"): i.get("href") for i in root.findall(".//o:manifest/o:item", ns)}
        pages = [items[r.get("idref")] for r in root.findall(".//o:spine/o:itemref", ns) if r.get("idref") in items]
        out = []
        for page in pages:
            html = z.read(posixpath.normpath(posixpath.join(posixpath.dirname(opf), page))).decode("utf-8", "replace")
            html = re.sub(r"(?is)<(script|style|nav|head)\b.*?</\1>", " ", html)
            html = re.sub(r"(?i)</?(?:p|div|li|h[1-6]|br|tr|section)\b[^>]*>", "\n", html)
            out.append("".join(ElementTree.fromstring(f"<x>{re.sub(r'<[^>]*>', '', html)}</x>").itertext()) if "&" not in html else re.sub(r"<[^>]*>", "", html))
        return re.sub(r"\s*\n\s*\n\s*", "\n\n", "\n\n".join(out)).strip(), None
    except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError, ValueError) as e:
        return None, f"not an EPUB: {type(e).__name__}"


def epub_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text, refused): a row for each .epub file below a folder; files that can't be read have null texts and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, reasons = zip(*map(_epub, b.column(1).to_pylist())) if b.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(reasons, pa.string())], ["path", "text", "refused"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.epub").load(path)
    return _ids(raw.select("path", "content").mapInArrow(run, "path string, text string, refused string"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, sent_idx, tok_i, text, lemma, pos, dep, head_i): the tokens of CoNLL-U files.

    Sentences are blocks between blank lines; a file is one row at first, so its lines keep their order.
    """
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.conllu").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), unify_line_ends(F.col("value")).alias("v"))
    s = _ids(f).select("doc_id", "path", F.posexplode(F.filter(F.split("v", r"\n[ \t]*\n"), lambda x: F.trim(x) != "")).alias("sent_idx", "block"))
    t = s.select("doc_id", "path", "sent_idx", F.explode(F.filter(F.split("block", "\n"), lambda x: x.rlike(r"^\d+\t"))).alias("line")).withColumn("c", F.split("line", "\t"))
    at = lambda i: F.get(F.col("c"), i)
    return t.select("doc_id", "path", "sent_idx", at(0).cast("int").alias("tok_i"), at(1).alias("text"), at(2).alias("lemma"), at(3).alias("pos"), at(7).alias("dep"), at(6).cast("int").alias("head_i"))


def conllu_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc, text): documents of CoNLL-U files, from their "# newdoc" and "# text" comments."""
    f = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.conllu").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), unify_line_ends(F.col("value")).alias("v"))
    lines = f.select("path", F.posexplode(F.split("v", "\n")).alias("i", "line"))
    w = Window.partitionBy("path").orderBy("i")
    d = lines.withColumn("new", F.col("line").rlike("^# newdoc").cast("int")).withColumn("d", F.sum("new").over(w)).where(F.col("line").rlike(r"^# text\s*="))
    d = d.withColumn("text", F.regexp_extract("line", r"^# text\s*=\s*(.*)$", 1))
    parts = d.groupBy("path", "d").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("a"))
    return parts.select(F.concat_ws("#", "path", F.col("d").cast("string")).alias("doc"), F.array_join(F.transform("a", lambda x: x["text"]), " ").alias("text"))


def manuscript(chapters: DataFrame) -> DataFrame:
    """(number, text, gap, repeated): numbered chapters in order, with a mark where a number is left out or stands twice. The
    chapters of one folder are a manuscript."""
    c = chapters.withColumn("n", F.regexp_extract("path", r"(\d+)[^/\d]*$", 1)).where("n <> ''").select(F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.col("n").cast("int").alias("number"), "text")
    w = Window.partitionBy("folder").orderBy("number")
    step = F.col("number") - F.lag("number").over(w)
    return c.select("number", "text", (step > 1).alias("gap"), (step == 0).alias("repeated"))
