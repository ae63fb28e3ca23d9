"""Files of several formats as ``path, ext, text, status``.

A folder is one ``binaryFile`` scan; a file's suffix picks how its bytes become text. HTML, Markdown and
subtitles are built-in expressions on the decoded text; archives (docx, epub) are unpacked in Arrow batches.
What can't be read has a null text and an ``error``; no file ends the job. Empty files give no row.
"""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.cleaning import strip

SUFFIXES = {"txt": "text", "text": "text", "html": "html", "htm": "html", "xml": "html", "md": "markdown", "markdown": "markdown", "srt": "subtitles", "csv": "csv", "docx": "archive", "epub": "archive"}
UNSUPPORTED = ("pdf",)
TIMECODE = r"(?m)^[ \t]*[0-9]{1,2}:[0-9]{2}:[0-9]{2}[,.][0-9]{1,3}[ \t]*-->.*$"


def html_text(c: Column) -> Column:
    """Scripts, styles and comments go with what they hold, then tags; usual entities become characters; blanks collapse."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for k, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        c = F.replace(c, F.lit(k), F.lit(v))
    return strip(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def markdown_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[#*_`\[\]()]", ""))


def subtitle_text(c: Column) -> Column:
    """Spoken lines: without time codes, numbers of entries, and tags; null if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), TIMECODE, ""), r"(?m)^[ \t]*[0-9]+[ \t]*$", "")
    c = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>|\{[^}]*\}", ""), r"(?m)^[ \t]+$", ""), r"\n{3,}", "\n\n"))
    return F.when(c != "", c)


def csv_text(c: Column) -> Column:
    """Cells that aren't numbers, row by row, a line each. Quoted line ends aren't looked for; ``csv_columns`` reads a table."""
    rows = F.filter(F.split(F.replace(c, F.lit("\r"), F.lit("")), "\n"), lambda r: F.trim(r) != "")
    cells = lambda r: F.filter(F.transform(F.split(r, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(F.trim(x), '^"|"$', "")), lambda x: (x != "") & ~x.rlike(r"^-?[0-9.]+$"))
    return F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), " ")), "\n")


def csv_columns(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of CSV files with a header: text columns one after the other, each value a line, nulls left out."""
    table = spark.read.option("header", True).csv(path)
    name, names = F.input_file_name(), [c for c in table.columns]
    cells = table.select(name.alias("path"), F.monotonically_increasing_id().alias("row"), *(F.col(f"`{c}`") for c in names))
    long = cells.select("path", "row", F.explode(F.array(*(F.struct(F.lit(i).alias("col"), F.col(f"`{c}`").alias("value")) for i, c in enumerate(names)))).alias("x")).select("path", "row", "x.*").filter("value is not null and not value rlike '^-?[0-9.]+$'")
    return long.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "row", "value"))), lambda s: s["value"]), "\n").alias("text"))


class _Text(HTMLParser):
    """Text of a page without scripts and styles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.depth -= tag in ("script", "style") and self.depth > 0

    def handle_data(self, data):
        if not self.depth:
            self.parts.append(data)


def page_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    return "".join(p.parts).strip()


def unpacked(content: bytes, ext: str) -> str:
    """Paragraphs of a docx, pages of an epub."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if ext == "docx":
            root = ElementTree.fromstring(z.read("word/document.xml"))
            w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
            return "\n".join("".join(t.text or "" for t in p.iter(w + "t")) for p in root.iter(w + "p"))
        return "\n".join(page_text(z.read(n).decode("utf-8", "replace")) for n in _spine(z))


def _spine(z: zipfile.ZipFile) -> list[str]:
    """Pages of an epub in reading order; by name where the book doesn't tell it."""
    names = [n for n in z.namelist() if re.search(r"\.x?html?$", n)]
    book = next((n for n in z.namelist() if n.endswith(".opf")), None)
    if book is None:
        return sorted(names)
    root, folder = ElementTree.fromstring(z.read(book)), book.rpartition("/")[0]
    local = lambda name: [x for x in root.iter() if x.tag.rpartition("}")[2] == name]
    of = {x.get("id"): "/".join(filter(None, (folder, x.get("href", "")))) for x in local("item")}
    order = [of.get(x.get("idref")) for x in local("itemref")]
    order = [n for n in dict.fromkeys(order) if n in names]
    return order + sorted(set(names) - set(order))


def decoded(content: bytes) -> str:
    """By its byte order mark, else UTF-8, else Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def _decode(content: pa.Array, ext: pa.Array) -> pa.Array:
    out = []
    for c, e in zip(content.to_pylist(), ext.to_pylist()):
        try:
            out.append({"text": None if c is None else unpacked(c, e) if SUFFIXES.get(e) == "archive" else decoded(c), "error": None})
        except Exception as error:  # an archive can be damaged in any way; the row says how
            out.append({"text": None, "error": f"{type(error).__name__}: {error}"})
    return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def dispatch(ext: Column, text: Column) -> Column:
    """Text by format."""
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv)), ext)
    return F.when(kind == "html", html_text(text)).when(kind == "markdown", markdown_text(text)).when(kind == "subtitles", subtitle_text(text)).when(kind == "csv", csv_text(text)).otherwise(text)


def extracted(files: DataFrame) -> DataFrame:
    """``path, ext, text, error`` of ``path, content`` rows (batch or streaming) with a known suffix."""
    rows = files.select("path", extension(F.col("path")).alias("ext"), "content").filter(F.col("ext").isin(*SUFFIXES, *UNSUPPORTED))
    raw = rows.withColumn("raw", F.when(F.col("ext").isin(*UNSUPPORTED), None).otherwise(_decode("content", "ext")))
    error = F.when(F.col("ext").isin(*UNSUPPORTED), F.concat(F.lit("unsupported: "), "ext")).otherwise(F.col("raw.error"))
    return raw.select("path", "ext", dispatch(F.col("ext"), F.col("raw.text")).alias("text"), error.alias("error"))


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return extracted(files)


# sentences


def sentences_txt(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, lang, text, source``: a sentence for each line that isn't blank, numbered by physical line."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("t"))
    lines = files.select("path", F.posexplode(F.split("t", "\r?\n")).alias("n", "text"))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return lines.filter(F.trim("text") != "").select(F.concat(stem, F.lit("-"), F.lpad((F.col("n") + 1).cast("string"), 6, "0")).alias("sent_id"), F.lit(None).cast("string").alias("lang"), strip(F.col("text")).alias("text"), "path")


SENTENCE = "sent_id string, id string, text string, lang_iso string, _type string"


def sentences_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of sentences, or an object with ``language_iso`` (``lang_iso``) and ``sentences``, as objects or plain strings."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("t"))
    array = F.col("t").rlike(r"^\s*\[")
    items = F.when(array, F.col("t")).otherwise(F.get_json_object("t", "$.sentences"))
    lang = F.coalesce(F.get_json_object("t", "$.language_iso"), F.get_json_object("t", "$.lang_iso"))
    rows = files.select("path", F.when(~array, lang).alias("lang"), F.posexplode(F.from_json(items, "array<string>")).alias("n", "s"))
    x = F.from_json("s", SENTENCE)
    text = F.coalesce(x["text"], F.when(~F.col("s").rlike(r"^\s*[{\[]"), F.col("s")))
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    made = F.concat(stem, F.lit("-"), F.lpad((F.col("n") + 1).cast("string"), 6, "0"))
    return rows.select(F.coalesce(x["sent_id"], x["id"], made).alias("sent_id"), F.coalesce(x["lang_iso"], "lang").alias("lang"), text.alias("text"), "path").filter(F.trim("text") != "")


def sentences_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are objects with a text; blank lines, comments, headers and broken lines are left out."""
    x = F.from_json("value", SENTENCE)
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|$)")).select(x.alias("x"), F.input_file_name().alias("path")).filter("x is not null and coalesce(x._type, '') <> 'corpus_header'")
    return rows.select(F.coalesce("x.sent_id", "x.id").alias("sent_id"), F.col("x.lang_iso").alias("lang"), F.col("x.text").alias("text"), "path").filter(F.trim("text") != "")


READERS = {"txt": sentences_txt, "json": sentences_json, "jsonl": sentences_jsonl}


def sentences_of(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, lang, text, path`` of all ``.txt``, ``.json`` and ``.jsonl`` files under a folder, or of one such file."""
    from pyspark.errors import AnalysisException

    out = None
    for ext, reader in READERS.items():
        if re.search(r"\.[A-Za-z0-9]+$", path.rstrip("/")) and not path.lower().endswith(f".{ext}"):
            continue
        try:
            files = reader(_Only(spark, ext), path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = files if out is None else out.unionByName(files)
    if out is None:
        raise ValueError(f"no .txt, .json or .jsonl file: {path}")
    return out


class _Only:
    """A session whose reads take the files of one suffix, in all folders below."""

    def __init__(self, spark: SparkSession, ext: str):
        self.spark, self.ext = spark, ext

    @property
    def read(self):
        return self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{self.ext}")


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, pos, form, lemma, upos, xpos, feats, head, deprel, deps, misc``; ``_`` is null."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.explode(F.split("value", r"\r\n[ \t]*\r\n")).alias("value")).filter(F.trim("value") != "")
    lines = blocks.select(F.regexp_extract("value", r"(?m)^# sent_id = ([^\r\n]+)", 1).alias("sent_id"), F.explode(F.split("value", "\r?\n")).alias("line")).filter("line <> '' and not startswith(line, '#')")
    names = ("pos", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")
    cells = F.split("line", "\t")
    value = lambda i: F.try_element_at(cells, F.lit(i + 1))
    return lines.select("sent_id", value(0).cast("int").alias("pos"), *(F.when(value(i) != "_", value(i)).alias(n) for i, n in enumerate(names) if i))


def language(own: Column, given: str = "und") -> Column:
    """A row's own language unless it is unknown, then the one given."""
    return F.coalesce(F.nullif(own, F.lit("und")), F.lit(given))


