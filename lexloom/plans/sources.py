"""Queries of the readers' text extraction and of the writers' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import segment as SEG
from ..operators import annotate as A
from ..operators import stats
from ..sources import files as S
from ..sources import sinks
from ..streaming import incremental
from . import morph as MORPH
from .clean import strip, sub
from .registry import query, quoted, table

Q = quoted


def html_sql(x: str) -> str:
    x = sub(sub(sub(x, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for k, v in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {Q(k)}, {Q(v)})"
    return strip(sub(x, r"[ \t\r\n]+", " "))


@query(f"SELECT page_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (SELECT page_id, {html_sql('html')} AS t FROM pages)")
def html_extract(spark, sf_dir):
    t = S.html_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("chars"), F.md5(t).alias("digest"))


_MARKED = "'# ' || text || chr(10) || '* [link](x) `code` _it_'"


@query(f"SELECT doc_id, md5({strip(sub(_MARKED, r'[#*_`\[\]()]', ''))}) AS digest FROM documents")
def md_strip(spark, sf_dir):
    marked = F.concat(F.lit("# "), "text", F.lit("\n* [link](x) `code` _it_"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(S.markdown_text(marked)).alias("digest"))


_SRT = "'1' || chr(10) || '0:00:07,000 --> 0:00:08,500' || chr(10) || '<i>' || text || '</i>' || chr(10) || chr(10) || chr(10) || '2' || chr(10) || '00:00:03,000 --> 00:00:04,000' || chr(10) || '{\\an8}end'"
_SRT_TEXT = strip(sub(sub(sub(sub(sub(_SRT, S.TIMECODE, ""), r"(?m)^[ \t]*[0-9]+[ \t]*$", ""), r"<[^>]*>|\{[^}]*\}", ""), r"(?m)^[ \t]+$", ""), r"\n{3,}", "\n\n"))


@query(f"SELECT conv_id, turn, md5({_SRT_TEXT}) AS digest FROM conversations")
def srt_extract(spark, sf_dir):
    subtitles = F.concat(F.lit("1\n0:00:07,000 --> 0:00:08,500\n<i>"), "text", F.lit("</i>\n\n\n2\n00:00:03,000 --> 00:00:04,000\n{\\an8}end"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(S.subtitle_text(subtitles)).alias("digest"))


_EXT = "CASE WHEN doc_id % 4 = 0 THEN 'html' WHEN doc_id % 4 = 1 THEN 'md' WHEN doc_id % 4 = 2 THEN 'TXT' ELSE 'xyz' END"


@query(f"SELECT doc_id, ext, md5(CASE WHEN ext = 'html' THEN {html_sql('text')} WHEN ext = 'md' THEN {strip(sub('text', r'[#*_`\[\]()]', ''))} ELSE text END) AS digest FROM (SELECT doc_id, text, lower({_EXT}) AS ext FROM documents WHERE doc_id IS NOT NULL)")
def format_dispatch(spark, sf_dir):
    """Every text as if it came from files of four kinds."""
    path = F.concat(F.lit("/in/f."), F.expr("element_at(array('html', 'md', 'TXT', 'xyz'), cast(doc_id % 4 as int) + 1)"))
    d = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", "text", S.extension(path).alias("ext"))
    return d.select("doc_id", "ext", F.md5(S.dispatch(F.col("ext"), F.col("text"))).alias("digest"))


@query("SELECT doc_id, 'name n' || chr(10) || coalesce(lang, '') || CASE WHEN coalesce(lang, '') <> '' THEN ' ' ELSE '' END || 'a, b' AS csv FROM documents WHERE lang IS NULL OR NOT contains(lang, ',')")
def csv_extract(spark, sf_dir):
    """Cells of CSV text that aren't numbers."""
    d = table(spark, sf_dir, "documents").filter("lang is null or not contains(lang, ',')")
    text = F.concat(F.lit("name,n\n"), F.coalesce("lang", F.lit("")), F.lit(",12,\"a, b\",-1.5\n\n"))
    return d.select("doc_id", S.csv_text(text).alias("csv"))


_MORPHS = " + ".join(f"CASE WHEN length({c}) > 0 THEN 1 ELSE 0 END" for c in ("neg", "sm", "tam", "om", "root", "ext", "fv"))


@query(
    f"WITH {MORPH._WITH} SELECT doc_id, sent, count(*)::INT AS n_tokens, count(CASE WHEN type = 'word' AND NOT lex THEN 1 END)::BIGINT AS oov, md5(string_agg(concat_ws('/', form, lemma, upos, coalesce(nc, '-'), CASE WHEN feats = '' THEN 0 ELSE len(string_split(feats, '|')) END, CASE WHEN score IS NOT NULL THEN {_MORPHS} WHEN nc IS NOT NULL THEN 2 - CASE WHEN length(stem) = length(low) THEN 1 ELSE 0 END ELSE 0 END), ' ' ORDER BY pos)) AS digest FROM t GROUP BY doc_id, sent"
)
def jsonl_rows(spark, sf_dir):
    """Annotated sentences as JSON objects, read again."""
    d = table(spark, sf_dir, "documents")
    s = SEG.exploded(d, SEG.app_sentences(F.col("text")), ("doc_id", "lang", "source"), "text").withColumnRenamed("n", "sent")
    rows = sinks.annotated_lines(s.withColumn("forms", SEG.punct_tokens(F.col("text"))), A.Annotator(*MORPH.tables()), ["doc_id", "sent"])
    x = F.from_json("value", "sent_id string, stats struct<oov:long>, tokens array<struct<form:string,lemma:string,upos:string,noun_class:string,feats:map<string,string>,morphemes:array<struct<form:string>>>>")
    token = lambda t: F.concat_ws("/", t["form"], t["lemma"], t["upos"], F.coalesce(t["noun_class"], F.lit("-")), F.size(t["feats"]).cast("string"), F.size(t["morphemes"]).cast("string"))
    back = rows.select("doc_id", "sent", x.alias("x"))
    return back.select("doc_id", "sent", F.size("x.tokens").alias("n_tokens"), F.col("x.stats.oov").alias("oov"), F.md5(F.array_join(F.transform("x.tokens", token), " ")).alias("digest"))


_KNOWN_DE = "CASE WHEN lang = 'de' THEN {0} ELSE {1} END"


def _report_sql() -> str:
    from ..functions.profiles import Profile, profiles
    from . import clean as K
    from . import segment as P

    own = profiles()["de"]
    clean = lambda p: K.chain("text", p)
    parts = lambda p: P.sentences("cleaned", p)
    base = Profile()
    return f"""WITH c AS (SELECT doc_id, lang, text, {_KNOWN_DE.format(clean(own), clean(base))} AS cleaned FROM documents), s AS (SELECT *, {_KNOWN_DE.format(parts(own), parts(base))} AS p FROM c),
    r AS (SELECT text IS NOT NULL AND cleaned <> '' AND len(p) > 0 AS success, coalesce(length(text), 0) AS a, coalesce(length(cleaned), 0) AS z, coalesce(len(p), 0) AS n, coalesce(list_sum(list_transform(p, lambda x: len({P.words('x')}))), 0) AS w FROM s)
    SELECT count(*) AS files, count(CASE WHEN success THEN 1 END) AS done, count(CASE WHEN success THEN NULL ELSE 1 END) AS failed, sum(n)::BIGINT AS sentences, sum(w)::BIGINT AS words, round(done * 100 / files, 2)::DOUBLE AS success_pct, round((sum(a) - sum(z)) * 100 / sum(a), 2)::DOUBLE AS reduction_pct, round(sum(n) / done, 2)::DOUBLE AS per_file, round(sum(w) / sum(n), 2)::DOUBLE AS words_per_sentence FROM r"""


@query(_report_sql())
def run_report(spark, sf_dir):
    """The corpus builder's counters and ratios, each document as a file of its language."""
    from ..functions.profiles import Profile, profiles
    from ..sources import corpus

    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("/in"), F.coalesce("lang", F.lit("x")), F.coalesce(F.col("doc_id").cast("string"), F.lit("x"))).alias("path"), "text", F.lit(None).cast("string").alias("error"))
    known = {"de": profiles()["de"]}
    rows = corpus.processed(d, known, Profile()).withColumn("sentences", F.greatest(F.size("sentences"), F.lit(0)))
    return stats.run_report(rows)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    """Extension: the streaming count over a table that has ended."""
    return incremental.event_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
