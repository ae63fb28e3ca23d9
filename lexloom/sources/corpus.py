"""Corpus builder: a folder of files to cleaned text, sentences, outputs, a manifest and a report.

Extraction, cleaning and segmentation are columns over one scan of the files. Results are written once as a table; outputs, manifest and
report follow from it. Each output file mirrors its source's place with another suffix and is written by the task that holds its
row, under a name that depends on the source alone, so that a task that runs again replaces its own files.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import segment as S
from ..functions.profiles import Profile, Toggles, profiles, universal
from ..operators import stats
from ..session import ship
from .files import read_files

FORMATS = {"txt": ".txt", "json": ".json", "cleaned": ".cleaned.txt"}


def detected(path: Column, known: dict[str, Profile]) -> Column:
    """First profile one of whose keywords is in the path, in the order of the profiles; else ``und``."""
    low = F.lower(path)
    found = [F.when(F.greatest(F.lit(False), *(F.contains(low, F.lit(k)) for k in p.keywords)), iso) for iso, p in known.items()]
    return F.coalesce(*found, F.lit("und"))


def by_language(lang: Column, known: dict[str, Profile], shared: Profile, make) -> Column:
    """``make(profile)`` of a row's own language, of ``shared`` for any other; languages with like settings share a branch."""
    settings = lambda p: (p.chapter_words, p.abbreviations, p.single_chars, p.strip_patterns, p.ocr, p.punctuation)
    groups: dict[tuple, list[str]] = {}
    for iso, p in known.items():
        groups.setdefault(settings(p), []).append(iso)
    out = make(shared)
    for own, isos in groups.items():
        if own != settings(shared):
            out = F.when(lang.isin(*isos), make(known[isos[0]])).otherwise(out)
    return out


def processed(files: DataFrame, known: dict[str, Profile] | None = None, shared: Profile | None = None, on: Toggles = Toggles(), least: int = S.LEAST, most: int = S.MOST, lang: str | None = None) -> DataFrame:
    """``path, lang, success, stage, error, chars_before, chars_after, words, cleaned, sentences`` and counters of files (``path, text, error``).

    A file without text, and one of which cleaning or segmentation leaves nothing, isn't a success; ``stage`` tells where it ended.
    """
    known, shared = known or profiles(), shared or universal()
    rows = files.select("path", (F.lit(lang) if lang else detected(F.col("path"), known)).alias("lang"), "text", "error")
    t = F.col("text")
    counted = C.counters(t, shared)
    rows = rows.select("*", by_language(F.col("lang"), known, shared, lambda p: C.chain(t, p, on)).alias("cleaned"), *(F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{k}") for k, c in counted.items()))
    rows = rows.withColumn("sentences", by_language(F.col("lang"), known, shared, lambda p: S.sentences(F.col("cleaned"), p.abbreviations, least, most)))
    stage = F.when(F.col("text").isNull(), "extract").when(F.coalesce("cleaned", F.lit("")) == "", "clean").when(F.size("sentences") < 1, "segment")
    total = F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + F.size(S.words(s)))
    return rows.select(
        "path", "lang", stage.isNull().alias("success"), stage.alias("stage"), F.coalesce("error", F.when(stage.isNotNull(), F.lit("no text"))).alias("error"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars_before"), F.coalesce(F.length("cleaned"), F.lit(0)).cast("long").alias("chars_after"),
        F.coalesce(total, F.lit(0)).alias("words"), "cleaned", "sentences", *(f"n_{k}" for k in counted),
    )


def metadata(path: str, lang: str, cleaned: str, sentences: list[str]) -> dict:
    words = sum(len(s.split()) for s in sentences)
    n = len(sentences)
    return {"source": path, "language": lang, "sentences": sentences, "statistics": {"sentence_count": n, "word_count": words, "char_count": len(cleaned), "words_per_sentence": round(words / n, 2) if n else 0, "chars_per_sentence": round(sum(map(len, sentences)) / n, 2) if n else 0}}


def _write(batches: Iterable[pa.RecordBatch], root: str, target: str, formats: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(target if "://" in target else "file://" + target)
    for b in batches:
        outputs = []
        for row in b.to_pylist():
            inside = posixpath.relpath(_plain(row["path"]), _plain(root)) if _plain(row["path"]).startswith(_plain(root)) else posixpath.basename(row["path"])
            stem, own = posixpath.splitext(inside)[0], {}
            for kind in formats:
                text = "\n".join(row["sentences"]) + "\n" if kind == "txt" else row["cleaned"] if kind == "cleaned" else json.dumps(metadata(row["path"], row["lang"], row["cleaned"], row["sentences"]), ensure_ascii=False, indent=1)
                own[kind] = f"{at}/{kind}/{row['lang']}/{stem}{posixpath.splitext(inside)[1].replace('.', '_')}{FORMATS[kind]}"
                store.create_dir(posixpath.dirname(own[kind]), recursive=True)
                with store.open_output_stream(own[kind], compression=None) as f:
                    f.write(text.encode())
            outputs.append([own[k] for k in formats])
        yield pa.record_batch([b.column(0), b.column(1), pa.array(outputs, pa.list_(pa.string()))], names=["path", "lang", "outputs"])


def _plain(path: str) -> str:
    return path.split("://", 1)[-1].removeprefix("file:").replace("//", "/").rstrip("/")


def outputs(results: DataFrame, root: str, target: str, formats: tuple[str, ...] = ("cleaned",)) -> DataFrame:
    """``path, lang, outputs``; running it writes the files of ``formats`` for each success."""
    wrong = set(formats) - set(FORMATS)
    if wrong:
        raise ValueError(f"unknown formats: {', '.join(sorted(wrong))}")
    ship(results.sparkSession)
    rows = results.filter("success").select("path", "lang", "cleaned", "sentences")
    return rows.mapInArrow(lambda it: _write(it, root, target, formats), "path string, lang string, outputs array<string>")


def build(spark: SparkSession, source: str, target: str, formats: tuple[str, ...] = ("txt", "json", "cleaned"), recursive: bool = True, **settings) -> DataFrame:
    """The whole run. Under ``target``: ``results`` (the table), a folder for each format, ``manifest`` (a JSON line for each output, by language) and ``report``; returns the report."""
    processed(read_files(spark, source, recursive), **settings).write.mode("overwrite").parquet(f"{target}/results")
    results = spark.read.parquet(f"{target}/results")
    written = outputs(results, source, target, formats)
    written.select("lang", F.explode("outputs").alias("path")).write.mode("overwrite").partitionBy("lang").json(f"{target}/manifest")
    rows = results.withColumn("sentences", F.greatest(F.size("sentences"), F.lit(0)))
    report = stats.run_report(rows).crossJoin(results.agg(*(F.sum(c).alias(c) for c in results.columns if c.startswith("n_"))))
    report.coalesce(1).write.mode("overwrite").json(f"{target}/report")
    return spark.read.schema(report.schema).json(f"{target}/report")

