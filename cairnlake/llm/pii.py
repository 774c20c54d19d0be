"""Personal data: exact patterns, and information-theoretic sanitisation around them, with DataFrame operations only.

Base spans are leftmost and non-overlapping for each kind: email, ip (parts at most 255), card (12 to 19 digits passing Luhn),
phone (9 to 15 digits). Every distinct base value is a protected entity e. A term t (a word of at least 4 letters or digits,
lower-cased) within WINDOW code points of an entity discloses it as far as the corpus shows: with N documents, df(t) and df(e)
of which hold them and co(t, e) hold t near e,

    disclosure = log(N co / (df(t) df(e))) / log(N / df(e))

is 1 if t stands in no document without e near. Terms seen near e in at least SUPPORT documents are generalised where disclosure
reaches GENERALISE, and removed where it reaches REMOVE: every occurrence in every text, near an entity or not, but for words that
touch a base span. Counts are taken over all documents; near is what stands within the window, as a long text's far parts say
little about an entity. The added spans have kind `term`.

Work is linear in a text's length and spans: places are sums over blocks of pieces, an entity's surroundings are cut from the pieces
beside it, and what touches a base span is found by a join on cells of 64 code points. All texts are read twice (patterns with
their surroundings; words that are wanted), those that hold a disclosing term once more; texts are not shuffled unless these are
too many to be named in a broadcast.

Cases: null texts are empty; equal rows share their spans and count as documents each; an empty table gives an empty result;
overlapping spans of different kinds all stay in the lists and are merged in the sanitised text; with one document, or an entity in
all, nothing is disclosed; texts of any length are read whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, in_memory, written

WINDOW = 64
SUPPORT = 2
GENERALISE = 0.85
REMOVE = 0.999
#: Pieces whose lengths are added up one by one.
_RUN = 512
#: Matches beside a match that can stand in its window: each has 3 code points at least.
_BESIDE = WINDOW // 3 + 1
#: What tells a row: two hashes of id and text, 128 bits.
_KEY = ["h", "g"]
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
#: Each starts where a run starts or the last match ended, which finds the same matches in linear time; possessive repeats keep Java's stack flat.
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9]){11,}+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_GUARD = {"email": "%@%.%", "ip": "%.%.%.%", "card": None, "phone": "%+%"}
TERM = "[\\p{L}\\p{N}]{4,}"
_NO_SPANS = "cast(array() as array<struct<s:int,e:int,v:string>>)"


def located(matches: str, pieces: str, more: str = "") -> str:
    """SQL for the spans of matches between pieces (both array columns): struct(s, e, v) and `more`, SQL of x (start x.s, number x.i).

    Starts are added up in blocks of pieces, so that no list is copied for each of its members."""
    step = f"named_struct('at', a.at + length({pieces}[i]) + length({matches}[i]), 'out', concat(a.out, array(named_struct('s', a.at + length({pieces}[i]), 'i', i))))"
    none = "cast(array() as array<struct<s:int,i:int>>)"
    block = f"aggregate(sequence(b * {_RUN}, least(size({matches}), (b + 1) * {_RUN}) - 1), named_struct('at', 0, 'out', {none}), (a, i) -> {step})"
    blocks = f"transform(sequence(0, int((size({matches}) - 1) div {_RUN})), b -> {block})"
    moved = "transform(c.out, x -> named_struct('s', a.at + x.s, 'i', x.i))"
    starts = f"flatten(aggregate({blocks}, named_struct('at', 0, 'out', cast(array() as array<array<struct<s:int,i:int>>>)), (a, c) -> named_struct('at', a.at + c.at, 'out', concat(a.out, array({moved})))).out)"
    return f"transform({starts}, x -> named_struct('s', x.s, 'e', x.s + length({matches}[x.i]), 'v', {matches}[x.i]{', ' + more if more else ''}))"


def _located_few(matches: str, pieces: str, shift: str) -> str:
    """The same for a short text, whose matches are few."""
    step = f"named_struct('at', a.at + length({pieces}[i]) + length({matches}[i]), 'out', concat(a.out, array(named_struct('s', a.at + length({pieces}[i]), 'e', a.at + length({pieces}[i]) + length({matches}[i]), 'v', {matches}[i]))))"
    return f"aggregate(sequence(0, size({matches}) - 1), named_struct('at', {shift}, 'out', {_NO_SPANS}), (a, i) -> {step}).out"


def _beside(kind: str) -> str:
    """SQL for the last WINDOW code points before match x.i and the first after it, with a blank beside the text's ends, as l and r.

    Words whose other end can't be seen don't count, so whole pieces need not be looked at."""
    m, t, h = f"m_{kind}", f"tails_{kind}", f"heads_{kind}"
    first = f"greatest(0, x.i - {_BESIDE})"
    last = f"least(size({m}) - 1, x.i + {_BESIDE})"
    before = f"if(x.i = 0 or length({t}[x.i]) >= {WINDOW}, {t}[x.i], array_join(transform(sequence({first}, x.i), j -> concat(if(j > {first}, {m}[j - 1], ''), {t}[j])), ''))"
    after = f"if(x.i = size({m}) - 1 or length({h}[x.i + 1]) >= {WINDOW}, {h}[x.i + 1], array_join(transform(sequence(x.i, {last}), j -> concat(if(j > x.i, {m}[j], ''), {h}[j + 1])), ''))"
    return f"'l', right(concat(' ', {before}), {WINDOW}), 'r', left(concat({after}, ' '), {WINDOW})"


def _holds(kind: str) -> str:
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    n = f"length({digits})"
    if kind == "email":
        return "true"
    if kind == "ip":
        return "forall(transform(split(x.v, '[.]'), y -> ltrim('0', y)), y -> length(y) < 3 or (length(y) = 3 and y <= '255'))"
    if kind == "phone":
        return f"{n} between 9 and 15"
    digit = f"int(substring({digits}, {n} - i, 1))"
    luhn = f"aggregate(sequence(0, {n} - 1), 0, (u, i) -> u + if(i % 2 = 0, {digit}, if({digit} > 4, 2 * {digit} - 9, 2 * {digit})))"
    return f"{n} between 12 and 19 and {luhn} % 10 = 0"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), h and g."""
    return id_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(7), "text", "doc_id").alias("g"))


def with_base(docs: DataFrame) -> DataFrame:
    """doc_id, h, g and base: the spans (s, k, e, v, and the text l and r beside them), by start, then kind."""
    df, t = keyed(docs), F.col("text")
    for kind, pattern in PATTERNS.items():
        guard = t.like(_GUARD[kind]) if _GUARD[kind] else t.rlike("[0-9]")
        df = df.withColumn(f"m_{kind}", F.when(guard, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split(t, pattern, -1)))
    df = df.select("doc_id", *_KEY, *[f"{x}_{kind}" for kind in PATTERNS for x in ("m", "p")])
    for kind in PATTERNS:
        df = df.withColumn(f"tails_{kind}", F.expr(f"transform(p_{kind}, y -> right(y, {WINDOW}))")).withColumn(f"heads_{kind}", F.expr(f"transform(p_{kind}, y -> left(y, {WINDOW}))"))
    spans = []
    for i, kind in enumerate(PATTERNS):
        own = f"filter({located(f'm_{kind}', f'p_{kind}', more=_beside(kind))}, x -> {_holds(kind)})"
        spans.append(F.expr(f"if(size(m_{kind}) > 0, transform({own}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v, 'l', x.l, 'r', x.r)), cast(array() as array<struct<s:int,k:int,e:int,v:string,l:string,r:string>>))"))
    return df.select("doc_id", *_KEY, F.array_sort(F.concat(*spans)).alias("base"))


def _near(base: DataFrame) -> DataFrame:
    """(rid, entity, s, e, t) of the terms beside base spans; base: rid, base."""
    one = base.where(F.size("base") > 0).select("rid", F.explode("base").alias("b"))
    one = one.select("rid", F.concat_ws(":", "b.k", "b.v").alias("entity"), "b.l", "b.r", (F.col("b.s") - F.length("b.l")).alias("from"), F.col("b.e").alias("to"))
    sides = []
    for side, pattern, at in (("l", "(?<=[^\\p{L}\\p{N}])" + TERM, "`from`"), ("r", "(?<![\\p{L}\\p{N}])" + TERM + "(?=[^\\p{L}\\p{N}])", "`to`")):
        one = one.withColumn(f"m_{side}", F.regexp_extract_all(side, F.lit(pattern), F.lit(0))).withColumn(f"p_{side}", F.split(side, pattern, -1))
        sides.append(f"if(size(m_{side}) > 0, {_located_few(f'm_{side}', f'p_{side}', at)}, {_NO_SPANS})")
    terms = one.withColumn("terms", F.expr(f"concat({', '.join(sides)})"))
    return terms.select("rid", "entity", F.explode("terms").alias("x")).select("rid", "entity", "x.s", "x.e", F.lower("x.v").alias("t"))


def _apart(words: DataFrame, base: DataFrame, key: list[str]) -> DataFrame:
    """words (key, s, e and more) that touch no base span (key, base) of their text."""
    cells = lambda s, e: F.expr(f"explode(sequence(int({s} div {WINDOW}), int(({e} - 1) div {WINDOW})))")
    spans = base.select(*key, F.explode("base").alias("b")).select(*key, F.col("b.s").alias("bs"), F.col("b.e").alias("be")).select(*key, "bs", "be", cells("bs", "be").alias("cell"))
    places = words.select(*key, "s", "e").distinct().select(*key, "s", "e", cells("s", "e").alias("cell"))
    touched = places.join(spans, [*key, "cell"]).where("s < be and bs < e").select(*key, "s", "e").distinct()
    return words.join(touched, [*key, "s", "e"], "left_anti")


def _held(df: DataFrame, most: int = 2_000_000) -> DataFrame:
    return F.broadcast(df) if in_memory(df.count(), most) else df


def holders(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, g, t): which rows hold which of the wanted terms; all texts are read, a row per term and text is made."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![\\p{L}\\p{N}])" + TERM), F.lit(0)))
    return keyed(docs).select(*_KEY, F.explode(words).alias("t")).join(_held(wanted, 200_000), "t", "left_semi")


def found(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """(base, added): base has doc_id, h, g and base spans of every row; added has h, g and spans (s, e, action) of disclosing terms."""
    spark = docs.sparkSession
    base = written(with_base(docs).withColumn("rid", F.monotonically_increasing_id()))
    total = base.count()
    near = written(_apart(_near(base.select("rid", "base")), base.select("rid", "base"), ["rid"]))
    entity = base.select("rid", F.explode("base").alias("b")).select("rid", F.concat_ws(":", "b.k", "b.v").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    together = near.select("rid", "entity", "t").distinct().groupBy("entity", "t").agg(F.count("*").alias("co")).where(F.col("co") >= support)
    together = written(together.join(entity, "entity"))
    held = written(holders(docs, written(together.select("t").distinct())))
    counts = held.groupBy("t").agg(F.count("*").alias("df"))
    told = together.join(counts, "t").withColumn("disclosure", F.when(F.col("df_e") < total, F.log(F.lit(total) * F.col("co") / (F.col("df") * F.col("df_e"))) / F.log(F.lit(total) / F.col("df_e"))).otherwise(0.0))
    told = written(told.where(F.col("disclosure") >= generalise).groupBy("t").agg(F.max(F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")).alias("action")))
    marked = written(held.join(_held(told, 200_000), "t").select(*_KEY).distinct())
    # every occurrence, in the texts that hold one
    texts = keyed(docs).join(_held(marked), _KEY, "left_semi").select(*_KEY, "text")
    texts = texts.withColumn("m", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("p", F.split("text", TERM, -1)).where("size(m) > 0")
    words = texts.select(*_KEY, F.expr(f"explode({located('m', 'p')})").alias("x")).select(*_KEY, "x.s", "x.e", F.lower("x.v").alias("t"))
    words = written(words.join(_held(told, 200_000), "t").groupBy(*_KEY, "s", "e").agg(F.max("action").alias("action")))
    own = base.select(*_KEY, "base").join(_held(marked), _KEY, "left_semi")
    added = written(_apart(words, own, _KEY).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e", "action"))).alias("added")))
    discard(spark, near, together, held, told, marked, words)
    return base.select("doc_id", *_KEY, F.expr("transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))").alias("base")), added


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"], x["e"])), ",")


def report(docs: DataFrame, **levels) -> DataFrame:
    """One row per row of docs: doc_id, base and spans (`kind:start:end`, comma-joined, by start, then kind), n_email, n_ip, n_card, n_phone, n_term."""
    base, added = found(docs, **levels)
    terms = "coalesce(transform(added, x -> named_struct('s', x.s, 'k', 4, 'e', x.e)), cast(array() as array<struct<s:int,k:int,e:int>>))"
    both = base.join(added, _KEY, "left").withColumn("all", F.array_sort(F.expr(f"concat(base, {terms})")))
    counts = [F.expr(f"cast(size(filter(`all`, x -> x.k = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return both.select("doc_id", *counts, _listed(F.col("base")).alias("base"), _listed(F.col("all")).alias("spans"))


def sanitised(docs: DataFrame, **levels) -> DataFrame:
    """One row per row of docs: doc_id and text with base spans and generalised terms as `[KIND]` and removed terms gone; overlapping spans become one, named by its first."""
    base, added = found(docs, **levels)
    base = base.dropDuplicates(_KEY).join(added, _KEY, "left").drop("doc_id")
    src = id_text(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64(F.lit(7), "text", "doc_id").alias("g")).join(base, _KEY, "left")
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    src = src.withColumn("cuts", F.expr(f"""array_sort(concat(transform(base, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'r', {names}[x.k])),
        coalesce(transform(added, x -> named_struct('s', x.s, 'k', 4, 'e', x.e, 'r', if(x.action = 'remove', '', {names}[4]))), cast(array() as array<struct<s:int,k:int,e:int,r:string>>))))"""))
    # segments of text that stay, each with what stands for the cut after it; block by block, with the largest end before each block
    src = src.withColumn("blocks", F.expr(f"transform(sequence(0, int((size(cuts) - 1) div {_RUN})), b -> slice(cuts, b * {_RUN} + 1, {_RUN}))"))
    src = src.withColumn("ends", F.expr("transform(blocks, c -> array_max(transform(c, x -> x.e)))"))
    keep = "if(x.s >= a.at, concat(a.out, array(named_struct('f', a.at, 't', x.s, 'r', x.r))), a.out)"
    run = f"aggregate(blocks[b], named_struct('at', if(b = 0, 0, array_max(slice(ends, 1, b))), 'out', cast(array() as array<struct<f:int,t:int,r:string>>)), (a, x) -> named_struct('at', greatest(a.at, x.e), 'out', {keep})).out"
    segments = f"concat(flatten(transform(sequence(0, size(blocks) - 1), b -> {run})), array(named_struct('f', array_max(ends), 't', length(text), 'r', '')))"
    src = src.withColumn("segments", F.expr(f"if(size(cuts) > 0, {segments}, null)")).withColumn("cells", F.expr(f"if(size(cuts) > 0, regexp_extract_all(text, '(?s).{{1,{_RUN}}}', 0), null)"))
    part = f"substring(cells[c], greatest(y.f - c * {_RUN}, 0) + 1, least(y.t, (c + 1) * {_RUN}) - greatest(y.f, c * {_RUN}))"
    text = f"array_join(transform(segments, y -> concat(if(y.t > y.f, array_join(transform(sequence(int(y.f div {_RUN}), int((y.t - 1) div {_RUN})), c -> {part}), ''), ''), y.r)), '')"
    return src.select("doc_id", F.expr(f"if(size(cuts) > 0, {text}, text)").alias("text"))
