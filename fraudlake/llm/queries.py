"""The registered queries of this subpackage: one per operator, over its whole
table, with the DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlake.llm import (bpe, fingerprints, hard_negatives, html_extract, langid, line_dedup, packing,
                           pii, quality, sharding, simhash, token_align, token_counts)
from fraudlake.llm.common import table
from fraudlake.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return deco


# white space of the word and line rules: \x20 and \x09-\x0D
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query("op1_line_dedup", f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (select *, translate(trim(line, {_SPACES}), {_UPPER}) as k from lines),
common as (
  select k, max(doc_id) as owner from keyed where length(k) >= 20
  group by k having count(distinct doc_id) >= 3),
marked as (
  select keyed.*, c.owner is not null and c.owner <> keyed.doc_id as dropped
  from keyed left join common c on keyed.k = c.k)
select doc_id, count(*) as n_lines, cast(sum(cast(dropped as bigint)) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id""")
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_SHARDS = 8


@query("op2_sharding", f"""
with crc_table as (
  select list_transform(range(256), lambda i: list_reduce(
    list_concat([i], range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
sized as (
  select doc_id, strlen(coalesce(text, '')) + 1 as size,
         xor(list_reduce(list_concat([4294967295], list_transform(
           regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: cast('0x' || h as bigint))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as crc
  from documents, crc_table),
placed as (
  select *, sum(size) over (order by doc_id rows unbounded preceding) as upto,
         sum(size) over () as total from sized),
cut as (
  select *, least({_SHARDS - 1}, ((2 * upto - size) * {_SHARDS}) // (2 * total)) as k from placed)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'bytes' as law,
       cast(k as integer) as shard,
       row_number() over (partition by k order by doc_id) - 1 as slot,
       cast(null as integer) as grown_shard
from cut""")
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), _SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"),
                      F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op3_fingerprints")
def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    return p.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.to_hex(F.col("fp")).alias("fingerprint"),
        fingerprints.to_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query("op5_quality", rf"""
with docs as (
  select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as ws from documents),
windows as (
  select doc_id, ws[i] || chr(32) || ws[i + 1] || chr(32) || ws[i + 2] as g, i
  from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from docs where len(ws) >= 3)),
repeated as (
  select doc_id, i from windows
  qualify count(*) over (partition by doc_id, g) >= 2),
repeats as (
  select doc_id, count(distinct i + j) as n from repeated, range(3) r(j) group by doc_id),
base as (
  select d.doc_id, lang, source, len(ws) as n_words,
         length(array_to_string(ws, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         (select count(*) - count(distinct x) from
            (select unnest(string_split(text, chr(10))) as x)
            where regexp_matches(x, '[^\x20\x09-\x0D]')) as n_dup_lines,
         coalesce(r.n, 0) as n_repeat_words
  from docs d left join repeats r on r.doc_id = d.doc_id),
failed as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         [(n_symbols * 1000000) // greatest(word_chars, 1), (word_chars * 1000000) // greatest(n_words, 1),
          (n_dup_lines * 1000000) // greatest(n_words, 1),
          (n_repeat_words * 1000000) // greatest(n_words, 1)] as ratios
  from base),
long_form as (
  select lang, source, k as ratio, ratios[k + 1] as v
  from failed, range(4) t(k) where not base_failed),
bucketed as (
  select lang, source, ratio,
         (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) as b from long_form),
quart as (
  select *, q3 - q1 as iqr from (
    select lvl, lang, source, ratio, docs, min(b) filter (where 4 * upto >= docs) as q1,
           min(b) filter (where 4 * upto >= 3 * docs) as q3
    from (
      select *, row_number() over w as upto, count(*) over (partition by lvl, lang, source, ratio) as docs
      from (select 'g' as lvl, lang, source, ratio, b from bucketed
            union all select 'l', lang, null, ratio, b from bucketed
            union all select 'a', null, null, ratio, b from bucketed)
      window w as (partition by lvl, lang, source, ratio order by b rows unbounded preceding))
    group by all)),
fences as (
  select lvl, lang, source, ratio, docs,
         q1 - 4 * greatest(iqr, s) as low, q3 + 4 * greatest(iqr, s) as high
  from quart join (values (0, 10000), (1, 500000), (2, 50000), (3, 100000)) v(r, s) on r = ratio),
chosen as (
  select f.doc_id, bool_and(f.ratios[g.ratio + 1] between
           case when g.docs >= 100 then g.low when l.docs >= 100 then l.low else a.low end and
           case when g.docs >= 100 then g.high when l.docs >= 100 then l.high else a.high end) as ok
  from failed f
  join fences g on g.lvl = 'g' and g.lang is not distinct from f.lang
                and g.source is not distinct from f.source
  join fences l on l.lvl = 'l' and l.lang is not distinct from f.lang and l.ratio = g.ratio
  join fences a on a.lvl = 'a' and a.ratio = g.ratio
  group by f.doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(ok, false) as kept
from failed f left join chosen c on c.doc_id = f.doc_id""")
def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs, carry_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query("op7_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.packed(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length",
                      F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


@query("op10_bpe")
def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"))


@query("op6_simhash")
def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"),
                      F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


@query("op4_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"))


@query("op9_language_id")
def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.predicted(docs, langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_html_extraction")
def html_extraction_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extracted(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def _pii_kind_sql(order: int, k: pii.Kind, check: str) -> str:
    """Spans of one kind: matches of the plain pattern, placed by the lengths of the pieces
    between them; ``check`` is a condition on ``d`` (digits and capitals of the match)."""
    lead = "regexp_extract(m, '^[^A-Za-z0-9]')" if k.alone else "''"
    keep = "A-Z0-9" if k.name == "iban" else "0-9"

    def word(words: str) -> str:
        hit = f"regexp_matches(translate(near, {_UPPER}), '(^|[^a-z])({words})([^a-z]|$)')"
        return f"cast({hit} as int) * {pii.STEP}" if words else "0"

    ok = "true" if order < len(pii.BASE) else (
        f"not regexp_matches(next, '^[A-Za-z0-9]') and "
        f"round(least(1.0, {k.score} + {word(k.words)} - {word(k.against)}), 2) >= {pii.ENOUGH}")
    return f"""
  select doc_id, {order} as ord, '{k.name}' as kind, pos + length(led) as s, pos + length(m) as e from (
    select *, regexp_replace(own, '[^{keep}]', '', 'g') as d from (
      select *, {lead} as led, m[length({lead}) + 1:] as own from (
        select doc_id, f[i + 1] as m, right(g[i + 1], {pii.BEFORE}) || ' ' || left(g[i + 2], {pii.AFTER}) as near,
               g[i + 2] as next,
               list_sum(list_transform(g[:i + 1], lambda x: length(x)))
                 + coalesce(list_sum(list_transform(f[:i], lambda x: length(x))), 0) as pos
        from (select doc_id, f, g, unnest(range(len(f))) as i from (
          select doc_id, regexp_extract_all(t, '{k.plain}') as f, string_split_regex(t, '{k.plain}') as g
          from texts)))))
  where {check} and {ok}"""


_PII_CHECKS = {
    "email": "true", "ip": rf"regexp_matches(own, '\A{pii._OCTET}(\.{pii._OCTET}){{3}}\z')",
    "card": """case when length(d) between 13 and 19 then list_sum(list_transform(range(1, length(d) + 1), lambda i:
      case when i % 2 = 1 then cast(d[length(d) - i + 1] as int)
           else [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(d[length(d) - i + 1] as int) + 1] end)) % 10 = 0 else false end""",
    "phone": "length(d) between 9 and 15",
    "iban": """list_reduce(list_concat([0], list_transform(string_split(d[5:] || d[:4], ''), lambda c:
      case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)),
      lambda r, v: (r * case when v > 9 then 100 else 10 end + v) % 97) = 1""",
    "ssn": "not regexp_matches(d, '^(000|666|9)|^...00|0000$')",
    "routing": """list_sum(list_transform(range(1, 10), lambda i: cast(d[i] as int) * [3, 7, 1][(i - 1) % 3 + 1])) % 10 = 0
      and regexp_matches(d, '^(0[1-9]|1[0-2]|2[1-9]|3[0-2]|6[1-9]|7[0-2]|80)')""",
}


@query("op12_pii", f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
found as ({" union all".join(_pii_kind_sql(i, k, _PII_CHECKS[k.name]) for i, k in enumerate([*pii.BASE, *pii.ADDED]))}),
named as (select *, concat_ws(':', kind, s, e) as span from found)
select t.doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip,
       count(*) filter (where kind = 'card') as n_card, count(*) filter (where kind = 'phone') as n_phone,
       sha256(coalesce(string_agg(span, ',' order by ord, s) filter (where ord < {len(pii.BASE)}), '')) as base_sha256,
       coalesce(string_agg(span, ',' order by ord, s), '') as spans
from texts t left join named n on n.doc_id = t.doc_id group by t.doc_id""")
def pii_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.BASE]
    return out.select(
        "doc_id", *[F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
                    for name in base],
        F.sha2(pii.joined(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        pii.joined(F.col("pii")).alias("spans"))


@query("op13_hard_negatives", """
with vectors as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor, b.id, a.label = b.label as alike, cast(list_inner_product(a.v, b.v) as bigint) as score
  from vectors a join vectors b on a.id % 100 = 0 and a.id <> b.id),
positives as (
  select anchor, id as positive, score as positive_score from scored where alike
  qualify row_number() over (partition by anchor order by score desc, id) <= 5)
select anchor as anchor_id, positive as positive_id,
       cast(row_number() over (partition by anchor, positive order by score desc, id) as integer) as rank,
       id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor)
where not alike and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5""")
def hard_negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = hard_negatives.whole_numbers(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(points.withColumn("label", label), F.col("id") % 100 == 0)


@query("op11_token_alignment")
def token_alignment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_align.aligned(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                      "groups_sha256")
