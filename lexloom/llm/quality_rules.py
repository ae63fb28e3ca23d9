"""Quality rules whose thresholds adapt to each language and source by mergeable quantile sketches.

Six measures of a text are taken by built-in functions in one pass and written as a narrow table.
KLL sketches of each measure, by language and source, give the quartiles from which a lower and an
upper fence follow: ``quartile -/+ FENCE * max(interquartile range, least spread)``. A group's quartiles are drawn
toward its language's, and those toward the quartiles of all, with the weight of ``PULL`` documents: the fewer documents a
group has, the less it goes by its own, and no size switches the way of judging. The sketches of languages and of all are merged
from the group sketches without another look at the documents. Then each row is joined with
its group's fences and kept if all measures are within them.

Shares are taken over the length plus ``SMOOTH``, so that one full stop doesn't condemn a text of two
words; distinct and all words are counted with ``SMOOTH_WORDS`` more, for the same reason. A sketch of more rows than ``SKETCH`` is
approximate and draws random bits: a rank errs by about 0.2 % (1 % at most in the test of 20,000 rows),
and a row at a fence may go either way from run to run, but one run uses one written table of fences.

Defined results: null texts and texts without a word are dropped; null languages and sources form
groups like any other value; every repeated row is judged and kept or dropped alike and counts in the
sketches; an empty table gives an empty result. No join is on ``doc_id``, which may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from .common import need

SMOOTH, SMOOTH_WORDS, PULL, FENCE, SKETCH = 40, 2, 200, 3.0, 2000
#: Least spread of each measure, for groups in which most texts have the same value.
SPREAD = {"symbols": 0.015, "digits": 0.05, "capitals": 0.03, "word_length": 0.6, "distinct_words": 0.03, "repeated_lines": 0.07}


def measures(text: str = "text") -> dict[str, Column]:
    """The measures of a text column, and ``n_words``; all null for a null text."""
    t = F.col(text)
    left = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    share = lambda n: n / (F.length(t) + SMOOTH)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.split(t, "\n")
    n = F.size(words)
    return {
        "n_words": F.when(t.isNotNull(), n),
        "symbols": share(left(r"[\p{L}\p{N}\s]+")),
        "digits": share(left(r"[^\p{N}]+")),
        "capitals": share(left(r"[^\p{Lu}]+")),
        "word_length": (left(r"\s+") + 100) / (F.when(t.isNotNull(), n) + 20),
        "distinct_words": F.when(t.isNotNull(), F.log(F.size(F.array_distinct(words)) + SMOOTH_WORDS) / F.log(n + SMOOTH_WORDS)),
        "repeated_lines": F.when(t.isNotNull(), (F.size(lines) - F.size(F.array_distinct(lines))) / (F.size(lines) + 5.0)),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source`` and the measures of every row that has a word, written once."""
    rows = need(docs, "doc_id", "lang", "source", "text")
    return written(rows.select("doc_id", "lang", "source", *(c.alias(k) for k, c in measures().items())).filter("n_words > 0"), "measures")


def quartiles(rows: DataFrame, sketch: int = SKETCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n`` and the quartiles ``K_25, K_75`` of each measure K by ``lang, source``, by ``lang`` and of all rows.

    The sketches are combined map-side, so a source that holds most of the corpus sends no more than a small one.
    """
    own = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(k, sketch).alias(k) for k in SPREAD))
    own = written(own, "sketches")
    merge = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(k).alias(k) for k in SPREAD)]
    values = [F.kll_sketch_get_quantile_double(k, F.lit(q / 100)).alias(f"{k}_{q}") for k in SPREAD for q in (25, 75)]
    return own.select("lang", "source", "n", *values), own.groupBy("lang").agg(*merge).select("lang", "n", *values), own.agg(*merge).filter("n > 0").select("n", *values)


def pulled(own: Column, n: Column, wider: Column, pull: float) -> Column:
    return (n * own + pull * wider) / (n + pull)


def fences(rows: DataFrame, pull: float = PULL, fence: float = FENCE, sketch: int = SKETCH) -> DataFrame:
    """``lang, source``, and ``lo_``/``hi_`` of each measure: one row for each group of ``rows``."""
    own, of_lang, of_all = quartiles(rows, sketch)
    whole = of_all.first()  # one row of numbers
    of_lang = of_lang.select(F.col("lang").alias("l"), *(F.col(c).alias(f"l_{c}") for c in of_lang.columns if c != "lang"))
    both = own.join(of_lang, own["lang"].eqNullSafe(F.col("l")))
    level = lambda c: pulled(F.col(c), F.col("n"), pulled(F.col(f"l_{c}"), F.col("l_n"), F.lit(whole[c] if whole else None).cast("double"), pull), pull)
    both = both.select("lang", "source", *(level(f"{k}_{q}").alias(f"{k}_{q}") for k in SPREAD for q in (25, 75)))
    out: list[Column] = []
    for k, spread in SPREAD.items():
        wide = fence * F.greatest(F.col(f"{k}_75") - F.col(f"{k}_25"), F.lit(spread))
        out += [(F.col(f"{k}_25") - wide).alias(f"lo_{k}"), (F.col(f"{k}_75") + wide).alias(f"hi_{k}")]
    return written(both.select("lang", "source", *out), "fences")


def within(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows of ``rows`` (as ``measured`` gives them) whose measures are all within their group's fences."""
    f = limits.withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    ok = F.lit(True)
    for k in SPREAD:
        ok &= F.coalesce(F.col(k).between(F.col(f"lo_{k}"), F.col(f"hi_{k}")), F.lit(True))
    return rows.join(f, rows["lang"].eqNullSafe(f["f_lang"]) & rows["source"].eqNullSafe(f["f_source"])).filter(ok).select(rows.columns)


def passing(docs: DataFrame, pull: float = PULL, fence: float = FENCE, sketch: int = SKETCH) -> DataFrame:
    """``doc_id, lang, source, n_words`` and the measures, to six places, of the rows of ``docs`` that pass all rules."""
    rows = measured(docs)
    kept = within(rows, fences(rows, pull, fence, sketch))
    return kept.select("doc_id", "lang", "source", "n_words", *(F.round(k, 6).alias(k) for k in SPREAD))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passing(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same in DuckDB with exact quartiles, which the sketches have too while a group has at most ``SKETCH`` rows."""
    share = lambda x: f"{x} / (length(text) + {SMOOTH})"
    left = lambda p: f"length(regexp_replace(text, '{p}', '', 'g'))"
    word, ends = "list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')", "string_split(text, chr(10))"
    m = {
        "symbols": share(left(r"[\p{L}\p{N} \t\n\x0B\f\r]+")), "digits": share(left(r"[^\p{N}]+")), "capitals": share(left(r"[^\p{Lu}]+")), "word_length": f"({left(r'[ \t\n\x0B\f\r]+')} + 100) / (n_words + 20)",
        "distinct_words": f"ln((len(list_distinct(w)) + {SMOOTH_WORDS})::DOUBLE) / ln((n_words + {SMOOTH_WORDS})::DOUBLE)", "repeated_lines": "(len(l) - len(list_distinct(l))) / (len(l) + 5.0)::DOUBLE",
    }
    group, lang = ("OVER (PARTITION BY lang, source)", "OVER (PARTITION BY lang)")
    level = {"g": group, "l": lang, "a": "OVER ()"}
    every = ", ".join(f"quantile_disc({k}, {q}) {o} AS {a}_{k}_{int(q * 100)}" for a, o in level.items() for k in m for q in (0.25, 0.75))
    drawn = lambda k, q: f"((n_g * g_{k}_{q} + {PULL}::DOUBLE * ((n_l * l_{k}_{q} + {PULL}::DOUBLE * a_{k}_{q}) / (n_l + {PULL}::DOUBLE))) / (n_g + {PULL}::DOUBLE)) AS {k}_{q}"
    fenced = ", ".join(drawn(k, q) for k in SPREAD for q in (25, 75))
    wide = lambda k, s: f"{FENCE}::DOUBLE * greatest({k}_75 - {k}_25, {s}::DOUBLE)"
    ok = " AND ".join(f"coalesce({k} BETWEEN {k}_25 - {wide(k, s)} AND {k}_75 + {wide(k, s)}, true)" for k, s in SPREAD.items())
    return f"""WITH w AS (SELECT *, len(w)::INT AS n_words FROM (SELECT doc_id, lang, source, text, {word} AS w, {ends} AS l FROM documents)),
    m AS (SELECT doc_id, lang, source, n_words, {", ".join(f"{x} AS {k}" for k, x in m.items())} FROM w WHERE n_words > 0),
    q AS (SELECT *, count(*) {group} AS n_g, count(*) {lang} AS n_l, {every} FROM m)
    SELECT doc_id, lang, source, n_words, {", ".join(f"round({k}, 6) AS {k}" for k in m)} FROM (SELECT *, {fenced} FROM q) WHERE {ok}"""


SQL = _sql()
