"""The operators as queries over the standard tables, and their SQL where it can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, lines, nbsvm, pii, pst, rules, simhash, toxicity, warc
from .common import table

def _tokenizers() -> str:
    """The folder of public tokenizers' files: LANTERNFISH_TOKENIZERS, or where the package of that name keeps them."""
    if told := os.environ.get("LANTERNFISH_TOKENIZERS"):
        return told
    import public_tokenizers

    return os.path.dirname(str(public_tokenizers.path("byte_bpe_50k.json")))


TOKENIZERS = _tokenizers()


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.sha2("text", 256).alias("text_sha256"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.json", ["doc_id"], decoded=True)
    return bpe.ids_digest(got.withColumn("decoded_sha256", F.sha2("decoded", 256)), ["doc_id", "n_tokens", "decoded_sha256"])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.archive_pages(spark, table(spark, sf_dir, "pages"), min_bytes=0)
    c = F.col("capture")
    return got.select(F.col("metadata.fields")["capture-key"].cast("long").alias("page_id"), F.coalesce(c["payload_bytes"], c["http_length"]).alias("payload_bytes"),
                      F.coalesce(c["computed_digest"], c["payload_digest"]).alias("payload_digest"), c["warc_type"].alias("record_type"),
                      F.col("metadata.fields")["refers-to-key"].cast("long").alias("refers_to"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontam.match(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", decontam.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontam.items_digest().alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _held(folds: int, held: int) -> F.Column:
    return (F.crc32(F.col("doc_id").cast("string")) % folds == held).alias("held_out")


def op5_pst_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    got = pst.score(table(spark, sf_dir, "documents"), ~held)
    return got.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0, 5, ["doc_id"])
    return got.select("doc_id", _held(5, 0), "score", "predicted")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = nbsvm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 1, 3, ["doc_id"])
    return got.select("doc_id", _held(3, 1), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return got.select("doc_id", *(count(k) for k in range(4)), F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_bpe_codec, op3_warc, op4_decontaminate, op5_pst_score, op6_quality_rules, op7_toxicity, op8_simhash, op9_quality, op10_pii)}


WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SQL = {}
SQL["op1_line_dedup"] = r"""
with l as (select doc_id, k - 1 as k, list_filter(regexp_split_to_array(translate(ln, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from (select doc_id, unnest(string_split(text, chr(10))) as ln, generate_subscripts(string_split(text, chr(10)), 1) as k from documents)),
u as (select doc_id, k, ws, array_to_string(ws, ' ') as t from l where len(ws) > 0),
d as (select t, any_value(ws) as ws, min({'d': doc_id, 'k': k}) as place from u group by 1),
s as (select t, place, t as v, 0 as p from d where len(ws) >= 5 union all
      select t, place, array_to_string(list_concat(list_slice(ws, 1, p - 1), list_slice(ws, p + 1, len(ws))), ' ') as v, p from (select *, unnest(range(1, len(ws) + 1)) as p from d where len(ws) >= 5)),
g as (select v, p, min(place) as m from s group by 1, 2),
a as (select v, min(case when p > 0 then m end) as other, min(case when p = 0 then m end) as self from g group by 1),
near as (select distinct t from s join g using (v, p) join a using (v) where (p > 0 and (m < place or self < place)) or (p = 0 and other < place)),
gone as (select doc_id, k from u join d using (t) left join near using (t) where near.t is not null or not (place.d = doc_id and place.k = k)),
r as (select doc_id, count(*) as n_removed, string_agg(cast(k as varchar), ',' order by k) as removed_lines from gone group by 1),
kept as (select doc_id, coalesce(string_agg(ln, chr(10) order by k), '') as text from (select doc_id, unnest(string_split(text, chr(10))) as ln, unnest(range(0, len(string_split(text, chr(10))))) as k from documents) x
  where not exists (select 1 from gone where gone.doc_id = x.doc_id and gone.k = x.k) group by 1)
select doc_id, cast(len(string_split(documents.text, chr(10))) as bigint) as n_lines, coalesce(n_removed, 0) as n_removed, coalesce(removed_lines, '') as removed_lines, sha256(coalesce(kept.text, '')) as text_sha256
from documents left join r using (doc_id) left join kept using (doc_id)"""
SQL["op3_warc"] = """
with p as (select page_id, encode(coalesce(html, '')) as b, max(page_id) over (partition by coalesce(html, '')) as best from pages)
select page_id, octet_length(b) as payload_bytes,
       array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast(list_sum(list_transform(range(0, 5), lambda j: (((strpos('0123456789abcdef', substr(sha1(b), 1 + cast((i + j) // 4 as bigint), 1)) - 1) >> cast(3 - (i + j) % 4 as integer)) & 1) << cast(4 - j as integer))) as bigint), 1)), '') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id = best then null else best end as refers_to
from p"""
SQL["op4_decontaminate"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
        from (select item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
ks as (select distinct k from win),
dg as (select doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
       from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
hit as (select doc_id, i, dg.k, item_id from dg join win using (k, g)),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as s from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(it.s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)"""

_RULES = [(rule, figure, above, c) for rule, (figure, above, cs) in rules.CANDIDATES.items() for c in cs]
SQL["op6_quality_rules"] = r"""
with recursive d as (select doc_id, coalesce(lang, '') as s, coalesce(text, '') as t from documents),
w as (select doc_id, s, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as ls from d),
g as (select doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
r as (select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1) group by 1),
f0 as (select doc_id, s, cast(len(w) as bigint) as n_words, coalesce(cast(list_sum(list_transform(w, lambda x: length(x))) as bigint), 0) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
        cast(len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
        len(ls) as n_lines, coalesce(r.n_repeat_words, 0) as n_repeat_words from w left join r using (doc_id)),
f as (select *, coalesce(n_symbols::double / nullif(word_chars, 0), 0) as symbol_share, coalesce(n_dup_lines::double / nullif(n_lines, 0), 0) as line_share,
        coalesce(n_repeat_words::double / nullif(n_words, 0), 0) as repeat_share, coalesce(word_chars::double / nullif(n_words, 0), 0) as word_length,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f0),
good as (select doc_id, max(quality) > 0 as good from labels where quality is not null group by 1),
told as (select f.*, good from f join good using (doc_id) where not base_failed),
tests as (TESTS),
p as (select *, case when k >= n * RISK then 0.0 else least(0.0, ln(list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(RISK) + (n - j) * ln(1 - RISK)))))) end as log_p from tests where n > 0),
o as (select *, row_number() over (order by log_p, s, rule, cutoff) as i, count(*) over () as m from p),
ok as (select *, min(case when log_p <= ln(DELTA / (m - i + 1)) then 1 else 0 end) over (order by i rows unbounded preceding) as held from o),
cut as (select s, rule, arg_max(cutoff, struct_pack(a := gain, b := -k, c := cutoff)) as cutoff from ok where held = 1 and gain > 0 group by 1, 2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not exists (select 1 from cut where cut.s = f.s and (HITS)) as kept from f
""".replace("with recursive", "with").replace("TESTS", " union all ".join(
    f"select s, '{rule}' as rule, {c!r}::double as cutoff, count(*) filter (good) as n, count(*) filter (good and {f} {'>' if a else '<'} {c!r}::double) as k, count(*) filter (not good and {f} {'>' if a else '<'} {c!r}::double) as gain from told group by s"
    for rule, f, a, c in _RULES)).replace("HITS", " or ".join(f"(rule = '{rule}' and {f} {'>' if a else '<'} cutoff)" for rule, (f, a, _) in rules.CANDIDATES.items())).replace("RISK", repr(rules.RISK / len(rules.CANDIDATES)) + "::double").replace("DELTA", repr(rules.DELTA) + "::double")


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
