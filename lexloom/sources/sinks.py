"""Outputs: sentences, JSON Lines, CoNLL-U, statistics and manifests, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import annotate


def write_sentences(sentences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``lang, text`` as text files, one sentence a line, a folder for each language."""
    sentences.select("lang", F.col("text").alias("value")).write.mode(mode).partitionBy("lang").text(path)


def write_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Documents with counts and averages (``doc_id, lang, sentences`` as an array)."""
    n = F.size("sentences")
    words = F.aggregate("sentences", F.lit(0), lambda a, s: a + F.size(F.split(s, r"\s+")))
    documents.select("doc_id", "lang", n.alias("sentence_count"), words.alias("word_count"), F.when(n > 0, F.round(words / n, 2)).otherwise(0.0).alias("words_per_sentence"), "sentences").write.mode(mode).partitionBy("lang").json(path)


def jsonl_line(sentence: Column, tokens: Column) -> Column:
    return F.to_json(F.struct(sentence.alias("sentence"), tokens.alias("tokens")))


def jsonl_rows(tokens: DataFrame, sent: list[str], slim: bool = False) -> DataFrame:
    """One JSON object for each sentence: its keys and its tokens in order; ``slim`` leaves out offsets."""
    drop = {"start", "stop", "original"} if slim else set()
    own = [c for c in tokens.columns if c not in sent and c not in drop]
    grouped = tokens.groupBy(*sent).agg(F.array_sort(F.collect_list(F.struct("pos", *(c for c in own if c != "pos")))).alias("tokens"))
    return grouped.select(*sent, F.to_json(F.struct(*sent, F.size("tokens").alias("n_tokens"), "tokens")).alias("value"))


def sentence_token(tokens: DataFrame) -> Column:
    """The 21 keys of an annotated token (``annotate.tokens``) as a struct; columns that the table hasn't are null."""
    have = {*tokens.columns}
    own = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    slots = [("NEG", "neg", None), ("SM", "sm", "sm_class"), ("TAM", "tam", "tam_id"), ("OM", "om", "om_class"), ("ROOT", "root", "gloss"), ("EXT", "ext", "ext_id"), ("FV", "fv", "fv_id")]
    length, morphs = F.lit(0), []
    for slot, form, gloss in slots:
        n = F.coalesce(F.length(form), F.lit(0))
        morphs.append(F.when(n > 0, F.struct(length.alias("start"), (length + n).alias("end"), F.col(form).alias("form"), F.lit(slot).alias("label"), (F.col(gloss) if gloss else F.lit(None).cast("string")).alias("gloss"), F.lit(slot).alias("slot"))))
        length = length + n
    n = F.coalesce(F.length("nc_prefix"), F.lit(0))
    nominal = [F.when(F.col("nc").isNotNull(), F.struct(a.alias("start"), z.alias("end"), f.alias("form"), F.lit(label).alias("label"), g.alias("gloss"), F.lit(None).cast("string").alias("slot"))) for a, z, f, label, g in ((F.lit(0), n, F.col("nc_prefix"), "NC_PREFIX", F.col("nc")), (n, n + F.length("stem"), F.col("stem"), "STEM", F.col("stem")))]
    nominal = [F.when(x["end"] > x["start"], x) for x in nominal]
    compact = lambda xs: F.array_compact(F.array(*xs))
    parse = F.struct(F.round("score", 4).alias("score"), F.col("root").alias("root"), F.concat_ws("-", "sm_class", "tam_id", "om_class", "gloss", "ext_id", "fv_id").alias("gloss"), F.array().cast("array<string>").alias("flags"))
    match = F.struct(F.coalesce("root", "stem").alias("root"), F.col("gloss").alias("gloss"), F.when(F.col("nc").isNull(), "verb").otherwise("noun").alias("cat"), F.col("nc").alias("nc"))
    known, pairs = F.coalesce(F.col("known"), F.lit(False)), F.when(F.coalesce("feats", F.lit("")) != "", F.str_to_map("feats", F.lit(r"\|"), F.lit("="))).otherwise(F.create_map().cast("map<string,string>"))
    agree = own("agree", "array<string>")
    return F.struct(
        F.col("pos").alias("token_id"), F.col("form").alias("form"), own("original_form").alias("original_form"), F.col("type").alias("token_type"), own("char_start", "int").alias("char_start"), own("char_end", "int").alias("char_end"), F.col("lemma").alias("lemma"), F.col("upos").alias("upos"), F.col("xpos").alias("xpos"), pairs.alias("feats"), own("head", "int").alias("head"), own("deprel").alias("deprel"), F.col("nc").alias("noun_class"), ((F.col("type") == "word") & ~known).alias("is_oov"),
        F.col("form").rlike(r"^(..+)\1").alias("is_reduplicated"), own("clitic_of", "int").alias("clitic_of"), F.array("flag").alias("flags"), F.concat(compact(morphs), compact(nominal)).alias("morphemes"), compact([F.when(F.col("score").isNotNull(), parse)]).alias("slot_parses"), compact([F.when(known, match)]).alias("lexicon_matches"),
        F.map_from_entries(F.transform(F.coalesce(agree, F.array().cast("array<string>")), lambda x: F.struct(F.split(x, "=")[0].alias("key"), F.split(x, "=")[1].alias("value")))).alias("misc"),
    )


def sentence_lines(tokens: DataFrame, sentences: DataFrame, sent: list[str], pipeline: tuple[str, ...] = ("lexloom",), slim: bool = False) -> DataFrame:
    """``sent.., value``: a JSON object of 9 keys for each sentence, its tokens with 21 keys each in order.

    ``tokens``: as ``annotate.tokens`` gives them; ``sentences``: the keys with ``text, lang, source``. ``slim`` leaves out original forms and
    offsets. One exchange of the tokens by sentence, one join with the sentences.
    """
    own = sentence_token(tokens)
    t = tokens.select(*sent, own.dropFields("original_form", "char_start", "char_end").alias("t") if slim else own.alias("t"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    word = F.col("t.token_type") == "word"
    stats = F.struct(F.count("*").alias("total"), n(word & F.col("t.is_oov")).alias("oov"), n(F.size("t.lexicon_matches") > 0).alias("lexicon"), n(F.size("t.slot_parses") > 0).alias("analysed"), n(F.col("t.token_type") == "punct").alias("punct"), n(F.col("t.token_type") == "special").alias("special"))
    grouped = t.groupBy(*sent).agg(stats.alias("stats"), F.max(F.col("t.token_type") == "code_switch").alias("has_cs"), F.collect_list("t").alias("tokens"))
    ordered = F.array_sort("tokens", lambda a, b: a["token_id"] - b["token_id"])
    both = grouped.join(sentences, sent)
    line = F.struct(F.concat_ws("-", *sent).alias("sent_id"), F.col("text").alias("text"), F.col("lang").alias("lang_iso"), F.col("source").alias("source"), F.array(*map(F.lit, pipeline)).alias("pipeline"), "has_cs", F.array().cast("array<string>").alias("comments"), "stats", ordered.alias("tokens"))
    return both.select(*sent, F.to_json(line, {"ignoreNullFields": "false"}).alias("value"))


def annotated_lines(sentences: DataFrame, annotator: annotate.Annotator, sent: list[str], pipeline: tuple[str, ...] = ("lexloom",), slim: bool = False) -> DataFrame:
    """``sentence_lines`` of sentences that aren't annotated yet (the keys, ``text, lang, source, forms``), in one pass and without an exchange."""
    x = annotate.json_lines(sentences.select(*sent, "text", "lang", "source", "forms"), annotator, slim=slim)
    stats = F.struct("total", "oov", "lexicon", "analysed", "punct", "special")
    head = F.struct(F.concat_ws("-", *sent).alias("sent_id"), "text", F.col("lang").alias("lang_iso"), "source", F.array(*map(F.lit, pipeline)).alias("pipeline"), "has_cs", F.array().cast("array<string>").alias("comments"), stats.alias("stats"))
    own = F.to_json(head, {"ignoreNullFields": "false"})
    return x.select(*sent, F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"tokens":'), "tokens", F.lit("}")).alias("value"))


def write_both(tokens: DataFrame, blocks: DataFrame, sent: list[str], path: str, mode: str = "append") -> None:
    """JSON Lines and CoNLL-U from one table of tokens and its blocks (``block``), so that they can't differ."""
    jsonl_rows(tokens, sent).select("value").write.mode(mode).text(f"{path}/jsonl")
    blocks.select(F.col("block").alias("value")).write.mode(mode).text(f"{path}/conllu")


def header(lang: str, sentences: int) -> str:
    import json

    return json.dumps({"_type": "corpus_header", "language_iso": lang, "sentences": sentences}, sort_keys=True)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small table of statistics as one JSON file beside the output."""
    report.coalesce(1).write.mode(mode).json(path)


def remaining(sentences: DataFrame, done: DataFrame, key: str = "sent_id") -> DataFrame:
    """What isn't among the ids already written."""
    return sentences.join(done.select(key).distinct(), key, "left_anti")


def annotated_conllu(blocks: DataFrame, sentences: DataFrame, sent: list[str]) -> DataFrame:
    """Blocks with comment lines for source, language and text (``sentences``: the keys, ``source, lang, text``)."""
    line = lambda k, c: F.concat(F.lit(f"# {k} = "), F.coalesce(F.regexp_replace(c, r"[\r\n]+", " "), F.lit("_")), F.lit("\n"))
    return blocks.join(sentences, sent).select(*sent, F.concat(line("source", F.col("source")), line("lang", F.col("lang")), line("text", F.col("text")), "block").alias("block"))


def read_manifest(path: str) -> dict[str, list[str]]:
    """Language to files, of an object under ``languages`` or a bare one; values are lists or objects with ``files``."""
    import json

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    return {k: list(v.get("files", [])) if isinstance(v, dict) else list(v) for k, v in data.get("languages", data).items()}
