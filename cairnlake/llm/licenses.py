"""License scans: an exact set-similarity join of text blocks with license templates, with DataFrame operations only.

Texts are lower-cased (A-Z) and split into words (`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`). Blocks are windows of BLOCK words, one
every BLOCK / 2, wherever lines end, so any BLOCK / 2 words in a row (a template's statement is no longer) stand in one block
together. A block meets a template if it holds at least ceil(threshold x |T|) = need of the template's |T| distinct words. The words
of all templates have one global order, by how often they occur in the whole corpus, rarest first; blocks and templates are lists of
such words in this order. The join takes

- of each template only its prefix, the |T| - need + 1 first words: a block without any of them can't meet it;
- blocks with at least need words of the order (length filter);
- pairs whose common word has enough words behind it on either side: 1 + min(|T| - i - 1, |block| - j - 1) >= need, with i and j
  its places in both lists (positional filter).

What is left is verified on full sets. Of the templates that a block meets, those count as its labels whose MARKS it holds, as
statements of different licenses share most of their words. Besides, phrases (PHRASES) are found wherever their words stand
consecutively. Each text is split twice: for the words' counts, and for all else.

Templates are a parameter on the driver; prefixes are broadcast after a check of their number, and joined by word beyond it.

Cases: null texts are empty; each row has its own result, whatever it repeats; an empty table gives an empty result; a text with no
license has empty labels and score 0; texts of any length are scanned whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, in_memory, written

THRESHOLD = 0.8
#: Words of a block; a statement has half as many at most.
BLOCK = 64
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Statements by which texts are put under a license.
TEMPLATES = [
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2.0"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-4", "this work is licensed under the creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1.0 universal"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0"),
]
#: Words that a block must hold, and mustn't, to have a label, besides enough of its template.
MARKS = {
    "agpl-3": ("affero", ""), "apache-2": ("apache", ""), "bsd-3": ("redistribution", ""), "cc-by-4": ("attribution", ""), "cc-by-nc": ("nc", ""),
    "cc0": ("cc0", ""), "gpl-3": ("gnu", "affero"), "isc": ("fee", ""), "mit": ("mit", ""), "mpl-2": ("mozilla", ""),
}


def lowered(text: Column) -> Column:
    """A-Z lower-cased, as far as words of ASCII are concerned: of other letters only the Kelvin sign has one of these as lower case."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.contains("\u212a"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), _BETWEEN, -1), "")


def statement_words(statement: str) -> list[str]:
    """Distinct words in order of first place."""
    return list(dict.fromkeys(re.findall(WORD, statement.lower())))


def needed(statement_words: int, threshold: float = THRESHOLD) -> int:
    return math.ceil(threshold * statement_words - 1e-9)


def global_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The words of templates, rarest in the corpus first, equal ones by word; a row per word and task is shuffled."""
    words = docs.select(F.explode(word_list(F.col("text"))).alias("word")).where(F.col("word").isin(vocabulary))
    seen = {r.word: r.n for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the templates' words
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def prefixes(spark, order: list[str], templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(word, i, label, template, need): the prefix of each template, its words in the global order."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for label, statement in templates:
        words = sorted(statement_words(statement), key=rank.__getitem__)
        need = needed(len(words), threshold)
        rows += [(words[i], i, label, words, need) for i in range(len(words) - need + 1)]
    return spark.createDataFrame(rows, "word string, i int, label string, template array<string>, need int")


def scanned_words(docs: DataFrame, order: list[str], rare: list[str], least: int, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base (labels) by consecutive phrases, and blocks
    (number, words: those of the order, in it) that hold one of the rare words and at least `least` of all."""
    df = docs.select("doc_id", word_list(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    places, labels = [], []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        here = " and ".join(f"element_at(w, i + {k + 1}) = '{x}'" for k, x in enumerate(words))
        at = F.expr(f"filter(sequence(0, int(n_words) - {len(words)}), i -> {here})").cast("array<bigint>")
        places.append(F.when(F.array_contains("w", max(words, key=len)) & (F.col("n_words") >= len(words)), at).otherwise(F.array().cast("array<bigint>")))
        labels.append(label)
    step = block // 2
    known = "array(" + ", ".join(f"'{x}'" for x in order) + ")"
    cut = f"transform(sequence(0, int((n_words - 1) div {step})), b -> struct(b as block, array_intersect({known}, slice(w, b * {step} + 1, {block})) as words))"
    some = "array(" + ", ".join(f"'{x}'" for x in rare) + ")"
    blocks = F.when(F.expr(f"arrays_overlap(w, {some})"), F.expr(f"filter({cut}, x -> size(x.words) >= {least} and arrays_overlap(x.words, {some}))"))
    df = df.select("doc_id", "n_words", *[p.alias(f"at{k}") for k, p in enumerate(places)], blocks.alias("blocks"))
    every = F.concat(*[f"at{k}" for k in range(len(places))])
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(x)) for k, x in enumerate(labels)]))))
    return df.select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).alias("first_word"), F.array_max(every).alias("last_word"), base.alias("base"), "blocks")


def candidates(blocks: DataFrame, prefix: DataFrame, positional: bool = True) -> DataFrame:
    """Pairs of a block (its columns, with words in the global order) and a template that share a prefix word and pass the filters."""
    pairs = blocks.select("*", F.posexplode("words").alias("j", "word")).join(prefix, "word").where("size(words) >= need")
    return pairs.where("1 + least(size(template) - i - 1, size(words) - j - 1) >= need") if positional else pairs


def containment_join(blocks: DataFrame, prefix: DataFrame) -> DataFrame:
    """(rid, block, label, containment) of every block (rid, block, words) and template that meet."""
    found = candidates(blocks, prefix).withColumn("both", F.size(F.array_intersect("template", "words"))).where("both >= need")
    return found.groupBy("rid", "block", "label").agg(F.max(F.col("both") / F.size("template")).alias("containment"), F.first("words").alias("words"))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, marks: dict[str, tuple[str, str]] = MARKS, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base (labels), labels (of both), blocks (number, label, containment), score."""
    docs = id_text(docs)
    sets = [statement_words(s) for _, s in templates]
    if any(len(re.findall(WORD, s.lower())) > block // 2 for _, s in templates):
        raise ValueError(f"a statement of more than {block // 2} words needs larger blocks")
    order = global_order(docs, sorted({w for s in sets for w in s}))
    prefix = prefixes(docs.sparkSession, order, templates, threshold)
    rare = sorted({w for (_, s), d in zip(templates, sets, strict=True) for w in sorted(d, key=order.index)[: len(d) - needed(len(d), threshold) + 1]})
    # a number of each row that stays, as the table is written
    rows = written(scanned_words(docs, order, rare, min(needed(len(s), threshold) for s in sets), block).withColumn("rid", F.monotonically_increasing_id()))
    blocks = rows.where(F.size("blocks") > 0).select("rid", F.explode("blocks").alias("x")).select("rid", "x.block", "x.words")
    met = containment_join(blocks, F.broadcast(prefix) if in_memory(sum(map(len, sets))) else prefix)
    own = F.lit(False)
    for label, (must, mustnt) in marks.items():
        own = own | ((F.col("label") == label) & F.array_contains("words", must) & (~F.array_contains("words", mustnt) if mustnt else F.lit(True)))
    met = met.where(own | ~F.col("label").isin(list(marks))).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("block", "label", "containment"))).alias("met"))
    return rows.drop("blocks").join(met, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base",
        F.array_sort(F.array_distinct(F.concat("base", F.coalesce(F.col("met.label"), F.array().cast("array<string>"))))).alias("labels"),
        F.coalesce("met", F.array().cast("array<struct<block:int,label:string,containment:double>>")).alias("blocks"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("met.containment"), F.lit(0.0))).alias("score"),
    )
