"""The registered queries of the operators, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language_id, licenses, mixing, near_dedup, pii, substring_dedup, tokens, toxicity, winnowing
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return register


#: The words of a text, as op4 takes them.
_SETS = """
    words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
    sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)]) end s from words),
    sized as (select doc_id, len(s) n, list_sort(s) s from sets),
    classes as (select min(doc_id) c, s, any_value(n) n from sized where n > 0 group by s),
    grams as (select c, n, unnest(s) g from classes),
    linked as (select a.c a, b.c b from grams a join grams b on a.g = b.g and a.c < b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
    edges as (select a, b from linked union all select b, a from linked),
"""


@query(
    "op4_minhash_near_dedup",
    f"""with recursive {_SETS}
    reach(node, root) as (select c, c from classes union select e.b, r.root from reach r join edges e on r.node = e.a where e.b > r.root),
    roots as (select node, min(root) root from reach group by node)
    select d.doc_id, d.n n_shingles, coalesce(r.root, d.doc_id) component_id, d.doc_id = coalesce(r.root, d.doc_id) kept
    from sized d left join classes c on d.s = c.s and d.n > 0 left join roots r on r.node = c.c""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query(
    "op1_benchmark_decontamination",
    """with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
    bw as (select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
    win as (select distinct item, n, array_to_string(w[i : i + n - 1], ' ') g from (select item, w, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from bw where len(w) > 0)),
    lens as (select distinct n from win),
    places as (select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, lens)),
    occ as (select p.doc_id, p.i, p.n, item from places p join win using (n, g)),
    hit as (select doc_id, count(distinct k) h from (select doc_id, unnest(range(i, i + n)) k from occ) group by doc_id),
    its as (select doc_id, count(distinct item) c, string_agg(distinct item, ',' order by item) s from occ group by doc_id)
    select d.doc_id, cast(len(w) as bigint) n_words, coalesce(h, 0) n_hit, coalesce(c, 0) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(h, 0) > 0 contaminated
    from dw d left join hit using (doc_id) left join its using (doc_id)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op10_token_ids_rans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, ids=False)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op3_winnowing_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.compared(table(spark, sf_dir, "documents"))

    def digest(column: str):
        """Distinct hashes in ascending order, 8 hexadecimal digits each, comma-joined."""
        return F.array_join(F.transform(F.array_sort(F.array_distinct(column)), lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ",")

    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), digest("hashes").alias("fingerprint"), digest("edited_hashes").alias("edited_fingerprint"), "near_edited", "near_next")


@query(
    "op6_sentence_span_dedup",
    """with raw as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') l from documents),
    toks as (select doc_id, unnest(l) raw, unnest(range(1, len(l) + 1)) i, len(l) m from raw),
    word as (select doc_id, raw, i, m, regexp_extract(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^\\x20\\x09-\\x0D]+') t from toks),
    keyed as (select *, ((list_sum(list_transform(range(0, strlen(t)), lambda j: ('0x' || substr(hex(t), 2 * j + 1, 2))::bigint)) * 40503 + strlen(t) * 10007) % 65536) k from word),
    ends as (select *, regexp_matches(t, '[.!?]$') or contains(raw, chr(10)) or i = m or k <= min(k) over (partition by doc_id order by i rows between 2 preceding and 2 following) e from keyed),
    fine as (select *, coalesce(sum(cast(e as int)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint s from ends),
    sent as (select doc_id, s, string_agg(t, ' ' order by i) x, string_agg(raw, '' order by i) z from fine group by doc_id, s),
    near as (select doc_id, s, x, count(*) over (partition by doc_id) n, lead(x, 1) over w x1, lead(x, 2) over w x2, lead(x, 3) over w x3 from sent window w as (partition by doc_id order by s)),
    runs as (select doc_id, s p, n, case when n < 4 then x || coalesce(chr(10) || x1, '') || coalesce(chr(10) || x2, '') else x || chr(10) || x1 || chr(10) || x2 || chr(10) || x3 end r from near where s + 4 <= n or (s = 0 and n < 4)),
    firsts as (select r, min((doc_id, p)) q from runs group by r having count(*) > 1),
    gone as (select distinct doc_id, s from (select r.doc_id, unnest(range(p, p + least(4, n))) s from runs r join firsts using (r) where (r.doc_id, r.p) <> q)),
    kept as (select doc_id, count(*) n, count(g.s) k, string_agg(z, '' order by s) filter (g.s is null) y from sent left join (select doc_id, s from gone) g using (doc_id, s) group by doc_id)
    select d.doc_id, case when text is not null then regexp_extract(text, '^[\\x20\\x09-\\x0D]*') || coalesce(y, '') end as text, coalesce(n, 0) n_sentences, coalesce(k, 0) n_removed from raw d left join kept using (doc_id)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


@query("op5_language_id_ecoc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.fold(3)
    model = language_id.fit(docs, docs.where(held != 1).select("doc_id", F.col("lang").alias("label")))
    return language_id.identified(docs, model).select("doc_id", F.coalesce(held == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the rows outside the held-out fold; documents that are missing from labels, or labelled twice over, add nothing."""
    learn = language_id.fold(4) != 2
    marks = labels.where(learn).select("doc_id", F.col("toxic").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"), F.min("label").alias("low")).where("label = low").select("doc_id", "label")
    return toxicity.fit(docs, marks, toxicity.learned_languages(docs.where(learn)))


@query("op7_toxicity_cnn")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(language_id.fold(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


_PII = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)",
    "card": "[0-9]([\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_RUN = "[\\p{L}\\p{N}]+"


def _placed(source: str, text: str, pattern: str, columns: str) -> str:
    """SQL for the matches of a pattern: columns, v, s (code points before it)."""
    return f"""select {columns}, m[i] v, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::bigint s
        from (select *, unnest(range(1, len(m) + 1)) i from (select *, regexp_extract_all({text}, '{pattern}') m, string_split_regex({text}, '{pattern}') p from {source} where regexp_matches({text}, '{pattern}')))"""


_FOUND_PII = " union all ".join(f"select *, {k} k from ({_placed('d', 't', pattern, 'rid')})" for k, pattern in enumerate(_PII.values()))


@query(
    "op2_pii_information_theoretic",
    f"""with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
    found as ({_FOUND_PII}),
    digits as (select *, regexp_replace(v, '[^0-9]', '', 'g') g from found),
    base as (select rid, k, v, s, s + length(v) e from digits where case k when 0 then true
        when 1 then list_bool_and(list_transform(string_split(v, '.'), lambda y: length(ltrim(y, '0')) < 3 or (length(ltrim(y, '0')) = 3 and ltrim(y, '0') <= '255')))
        when 3 then length(g) between 9 and 15
        else case when length(g) between 12 and 19 then list_sum(list_transform(range(0, length(g)), lambda i: case when i % 2 = 0 then g[length(g) - i]::int when g[length(g) - i]::int > 4 then 2 * g[length(g) - i]::int - 9 else 2 * g[length(g) - i]::int end)) % 10 = 0 else false end end),
    sides as (select rid, k || ':' || v entity, e, greatest(s - 64, -1) f, substr(' ' || t || ' ', greatest(s - 64, -1) + 2, s - greatest(s - 64, -1)) l, substr(' ' || t || ' ', e + 2, least(e + 64, length(t) + 1) - e) r from base join d using (rid)),
    lefts as (select rid, entity, f + s s, f + s + length(v) e, lower(v) t from ({_placed('sides', 'l', _RUN, 'rid, entity, f')}) where s > 0 and length(v) >= 4),
    rights as (select rid, entity, e + s s, e + s + length(v) e, lower(v) t from ({_placed('sides', 'r', _RUN, 'rid, entity, e, r')}) where s + length(v) < length(r) and length(v) >= 4),
    near as (select * from (select * from lefts union all select * from rights) n where not exists (select 1 from base b where b.rid = n.rid and n.s < b.e and b.s < n.e)),
    df_e as (select k || ':' || v entity, count(distinct rid) df_e from base group by 1),
    together as (select entity, t, count(distinct rid) co from near group by entity, t having count(distinct rid) >= 2),
    df as (select t, count(*) df from (select distinct rid, unnest(list_filter(regexp_extract_all(lower(t), '{_RUN}'), lambda x: length(x) >= 4)) t from d) group by t),
    n as (select count(*) n from d),
    told as (select distinct t from together join df_e using (entity) join df using (t), n where df_e < n and ln(n * co / (df * df_e)) / ln(n / df_e) >= 0.85),
    pieces as (select rid, m[i] v, p[i] q, i from (select *, unnest(range(1, len(m) + 1)) i from (select rid, regexp_extract_all(t, '{_RUN}') m, string_split_regex(t, '{_RUN}') p from d where regexp_matches(t, '{_RUN}')))),
    every as (select rid, lower(v) t, length(v) w, (sum(length(q) + length(v)) over (partition by rid order by i rows unbounded preceding))::bigint e from pieces),
    marked as (select rid, e - w s, e from every e join told using (t) where w >= 4 and not exists (select 1 from base b where b.rid = e.rid and e.e - e.w < b.e and b.s < e.e)),
    spans as (select rid, s, k, e from base union all select distinct rid, s, 4, e from marked),
    lists as (select rid, count(*) filter (k = 0) n_email, count(*) filter (k = 1) n_ip, count(*) filter (k = 2) n_card, count(*) filter (k = 3) n_phone,
        string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 4) b, string_agg(['email', 'ip', 'card', 'phone', 'term'][k + 1] || ':' || s || ':' || e, ',' order by s, k, e) a from spans group by rid)
    select doc_id, coalesce(n_email, 0) n_email, coalesce(n_ip, 0) n_ip, coalesce(n_card, 0) n_card, coalesce(n_phone, 0) n_phone, sha256(coalesce(b, '')) base_sha256, coalesce(a, '') spans from d left join lists using (rid)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
_STATEMENTS = ", ".join(f"('{label}', regexp_extract_all('{text}', {_WORDS}))" for label, text in licenses.TEMPLATES)
_MARKS = ", ".join(f"('{label}', '{must}', '{mustnt}')" for label, (must, mustnt) in licenses.MARKS.items())
_PHRASES = ", ".join(f"('{label}', {text.split()!r})" for text, label in licenses.PHRASES.items())


@query(
    "op8_license_set_join",
    f"""with dw as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER}, {_WORDS}) w from documents),
    marks(label, must, mustnt) as (values {_MARKS}),
    phrases(label, p) as (values {_PHRASES}),
    places as (select rid, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1 : i + len(p)] = p)) i from dw, phrases),
    base as (select rid, count(*) n, min(i) f, max(i) l, string_agg(distinct label, ',' order by label) b from places group by rid),
    templates(label, t) as (select label, list_distinct(t) from (values {_STATEMENTS}) v(label, t)),
    blocks as (select rid, list_distinct(w[32 * b + 1 : 32 * b + 64]) x from (select rid, w, unnest(range(0, (len(w) + 31) // 32)) b from dw)),
    met as (select rid, label, len(list_intersect(x, t)) / len(t) c from blocks, templates join marks using (label) where len(list_intersect(x, t)) >= ceil(0.8 * len(t) - 1e-9) and list_contains(x, must) and not list_contains(x, mustnt)),
    every as (select rid, label from met union select rid, label from places),
    named as (select rid, string_agg(label, ',' order by label) a from every group by rid),
    best as (select rid, max(c) c from met group by rid)
    select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n, 0) n_base, f first_word, l last_word, coalesce(b, '') base_labels, coalesce(a, '') labels, case when n > 0 then 1.0::double else coalesce(c, 0.0)::double end score
    from dw d left join base using (rid) left join named using (rid) left join best using (rid)""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query(
    "op9_pfair_mixing",
    """with recursive cnt as (select source, count(*) n from documents group by source),
    lim as (select greatest(1000, 2 * count(*)) p, count(*) k, sum(round(1000000 * sqrt(n))::bigint)::bigint w from cnt),
    part as (select source, n, row_number() over (order by source) s, ((round(1000000 * sqrt(n))::bigint * (p - k)) // w)::bigint base, ((round(1000000 * sqrt(n))::bigint * (p - k)) % w)::bigint rem from cnt, lim),
    share as (select source, n, s, 1 + base + case when row_number() over (order by rem desc, source) <= (select p - k from lim) - (select sum(base) from part) then 1 else 0 end a from part),
    arr as (select list(a order by s) a, list(n order by s) n from share),
    sim(t, served, pick) as (
        select 0::bigint, list_transform(a, lambda x: 0::bigint), 0::bigint from arr
        union all
        select t + 1, list_transform(served, lambda v, j: v + case when j = pk then 1 else 0 end), pk from
            (select t, served, (list_min(list_filter(list_transform(range(1, len(a) + 1), lambda j: case when served[j] * p // a[j] <= t then {'due': ((served[j] + 1) * p + a[j] - 1) // a[j], 'j': j} end), lambda x: x is not null))).j pk from sim, arr, lim where t < p)),
    slots as (select x.t - 1 slot, x.pick s, b.served, b.served[x.pick] nth from sim x join sim b on b.t = x.t - 1 where x.t > 0),
    ranked as (select doc_id, d.source, s, a, row_number() over (partition by d.source order by doc_id) - 1 r from documents d join share using (source)),
    turned as (select *, r // 32 block, (r // 32) // a turn, (r // 32) % a nth from ranked)
    select doc_id, source, block, turn * p + slot slot,
        list_sum(list_transform(range(1, len(arr.a) + 1), lambda j: least(arr.n[j], 32 * (turn * arr.a[j] + served[j]))))::bigint + r % 32 position
    from turned join slots using (s, nth), arr, lim""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))
