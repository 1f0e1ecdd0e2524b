"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, linededup, mixing, quality, simhash, substring, toxicity, warc
from .common import fresh_path, table

# Weights of the mixture; the tables have no domain column, so sources are dealt to two domains.
LANG_WEIGHTS = {"en": 4.0, "fr": 2.0, "de": 2.0, "es": 1.0}
DOMAIN_WEIGHTS = {"web": 3.0, "books": 1.0}


def domain_of(source):
    return F.when(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1).isin(*"01234567"), "web").otherwise("books")


def levels(docs: DataFrame) -> dict:
    return {"domain": domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, levels=levels(docs), weights={"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS}, share=0.5, max_epochs=2, seed="mix")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path, with_payload=False)
    return records.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), warc.page_of("refers_to").alias("refers_to"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_key_chars=1, report=True)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, seeds=(42,), max_bits=3, blocks=6, agree=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.host_quality(table(spark, sf_dir, "documents")).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_path")[0].alias("domain"), "lang", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_copies").alias("copies"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


QUERIES = {f.__name__: f for f in (op1_warc, op2_langid, op3_substring, op4_decontaminate, op5_linededup, op6_simhash, op7_quality, op8_toxicity, op9_mixing, op10_licenses)}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_warc": """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as m from p where n >= 100 group by d having count(*) > 1)
select p.page_id, cast(p.n as bigint) as payload_bytes, p.d as payload_digest,
  case when f.m is not null and p.page_id is distinct from f.m then 'revisit' else 'response' end as record_type,
  case when f.m is not null and p.page_id is distinct from f.m then f.m end as refers_to
from p left join f on p.d = f.d and p.n >= 100
""",
    "op3_substring": f"""
with w as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, w, i, list_slice(w, i, i + 12) as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w where len(w) >= 13)),
least_doc as (select g, min(doc_id) as m from s group by g having count(distinct doc_id) > 1),
hit as (select s.doc_id, s.i from s join least_doc l on s.g = l.g where l.m < s.doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from hit),
marks as (select doc_id, list(p) as ps from gone group by doc_id),
kept as (select w.doc_id, w.w, coalesce(len(m.ps), 0) as r, case when m.ps is null then w.w else [w.w[i] for i in list_sort(list_filter(range(1, len(w.w) + 1), lambda x: not list_contains(m.ps, x)))] end as k
  from w left join marks m on w.doc_id = m.doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(r as bigint) as n_removed, sha256(coalesce(array_to_string(k, ' '), '')) as kept_sha256 from kept
""",
    "op5_linededup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (select doc_id, pos, line, {_LOWER.format(f"trim(line, {_SPACE})")} as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
j as (select k.doc_id, k.pos, k.line, f.key is not null as gone from k left join f on k.key = f.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
""",
    "op7_quality": rf"""
with d as (select doc_id, source, coalesce(text, '') as text, {_WORDS} as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
g as (select doc_id, i, [w[i], w[i + 1], w[i + 2]] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
t as (select doc_id, g from g group by doc_id, g having count(*) > 1),
p as (select distinct doc_id, unnest([i, i + 1, i + 2]) as p from (select g.doc_id, g.i from g join t on g.doc_id = t.doc_id and g.g = t.g)),
r as (select doc_id, count(*) as n from p group by doc_id),
l as (select doc_id, count(*) - count(distinct line) as n from (select doc_id, unnest(ls) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select d.doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
  cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols, coalesce(l.n, 0) as n_dup_lines, coalesce(r.n, 0) as n_repeat_words
  from d left join l on d.doc_id = l.doc_id left join r on d.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
x as (select *, base_failed or 100 * n_symbols > 50 * n_words or word_chars > 20 * n_words as failed from b),
h as (select source, count(*) as n, count(*) filter (where failed) as f from x group by source),
a as (select avg(f / n) as m, coalesce(var_samp(f / n), 0.0) as spread, avg(1.0 / n) as chance from h),
z as (select m, greatest(0.0, case when spread - m * (1 - m) * chance > m * (1 - m) / 10001 then m * (1 - m) / (spread - m * (1 - m) * chance) - 1 else 10000.0 end) as s from a),
v as (select source, (f + m * s) / (n + s) > 0.8 as rejected, (f + m * s) / (n + s) <= 0.1 as vouches from h, z)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not rejected and (vouches or not failed) as kept
from x join v on x.source is not distinct from v.source
""",
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", chr(39) * 2) + "'"


def _containment_sql(threshold: float = 0.8) -> str:
    """The license scan, plainly: every run of words of a line or paragraph is tried."""
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    templates = ", ".join(f"({i}, {_literal(label)}, {_literal(text)})" for i, (label, text) in enumerate(licenses.TEMPLATES))
    phrases = ", ".join(f"({_literal(label)}, {words.format(_literal(text))})" for text, label in licenses.PHRASES)
    return f"""
with d as (select row_number() over () as r, doc_id, {_LOWER.format("coalesce(text, '')")} as text from documents),
t as (select k, label, {words.format(_LOWER.format("text"))} as w from (values {templates}) t(k, label, text)),
tk as (select k, label, len(w) as span, len(list_distinct(w)) as size, cast(greatest(1, ceil({threshold} * len(list_distinct(w)) - 1e-9)) as int) as need, unnest(list_distinct(w)) as token from t),
ph as (select * from (values {phrases}) p(label, w)),
dw as (select r, doc_id, {words.format("text")} as w from d),
ln as (select r, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as nth from d),
lw as (select r, nth, {words.format("line")} as w from ln),
full_lines as (select *, sum(len(w)) over (partition by r order by nth rows between unbounded preceding and current row) - len(w) as before, nth - row_number() over (partition by r, len(w) > 0 order by nth) as para from lw),
tokens as (select r, nth, para, before + i as place, token from (select r, nth, para, before, unnest(w) as token, unnest(range(1, len(w) + 1)) as i from full_lines where len(w) > 0)),
next_ones as (select r, place, token, lead(token, 1) over ahead as second, lead(token, 2) over ahead as third from tokens window ahead as (partition by r order by place)),
base as (select r, label, place as i from next_ones join ph on token = ph.w[1] where list_slice([token, second, third], 1, len(ph.w)) = ph.w),
hit as (select tokens.*, k, label, span, size, need from tokens join tk using (token)),
fit as (select r, para, k from hit group by r, para, k, need having count(distinct token) >= need),
here as (select hit.* from hit join fit using (r, para, k)),
alone as (select r, k, nth, any_value(label) as label, count(distinct token) / any_value(size) as share from here group by r, k, nth, need having count(distinct token) >= need),
last_of as (select b.r, b.para, b.k, b.place as p, b.nth as last_line, b.label, b.need, b.size, a.token, max(a.place) as place, max(a.nth) as nth from here b join here a on a.r = b.r and a.para = b.para and a.k = b.k and a.place <= b.place and a.place > b.place - b.span group by all),
runs as (select r, k, p, any_value(label) as label, any_value(need) as need, any_value(size) as size, any_value(last_line) as last_line, min(nth) as first_line, count(*) as n from last_of group by r, para, k, p),
wrapped as (select r, label, n / size as share from runs where n >= need and first_line <> last_line and not exists (select 1 from alone where alone.r = runs.r and alone.k = runs.k and alone.nth between first_line and last_line)),
found as (select r, label, share from alone union all select r, label, share from wrapped),
b as (select r, count(*) as n_base, min(i) - 1 as first_word, max(i) - 1 as last_word, string_agg(distinct label, ',' order by label) as labels from base group by r),
f as (select r, max(share) as share from found group by r),
every as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(b.labels, '') as base_labels, coalesce(every.labels, '') as labels, case when b.r is not null then 1.0 else coalesce(share, 0.0) end as score
from dw left join b on b.r = dw.r left join f on f.r = dw.r left join every on every.r = dw.r
"""


SQL["op10_licenses"] = _containment_sql()


def _budget_step(k: int, up: str) -> str:
    """SQL of one level of the budget: nodes of k levels share what their parent was given."""
    path = ["domain", "lang", "source"][:k]
    family = f"partition by {', '.join(path[:-1])}" if k > 1 else ""
    order = f"{family} order by ratio, {path[-1]} nulls first"
    join = "cross join whole" if k == 1 else "join g{} u on {}".format(k - 1, " and ".join(f"n.{p} is not distinct from u.{p}" for p in path[:-1]))
    return f"""
n{k} as (select {', '.join(path)}, sum(cap) as cap, max(w{k}) as w from weighed group by {', '.join(path)}),
r{k} as (select {', '.join(f'n.{p}' for p in path)}, n.cap, n.w, {up}.given, case when n.w > 0 then n.cap / n.w else 0.0 end as ratio from n{k} n {join}),
o{k} as (select *, coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0.0) as used, sum(w) over ({order} rows between current row and unbounded following) as open from r{k}),
u{k} as (select *, case when open > 0 then (given - used) / open else 0.0 end as unit from o{k}),
s{k} as (select *, first_value(case when ratio > unit then unit end ignore nulls) over ({order} rows between unbounded preceding and unbounded following) as share from u{k}),
g{k} as (select {', '.join(path)}, case when ratio <= unit then cap else least(cap, greatest(0.0, w * share)) end as given from s{k})"""


SQL["op9_mixing"] = f"""
with d as (select doc_id, lang, source, case when substr(md5(coalesce(source, '')), 1, 1) in ('0', '1', '2', '3', '4', '5', '6', '7') then 'web' else 'books' end as domain,
  cast(len({_WORDS}) as bigint) as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens) as tokens from d group by domain, lang, source),
weighed as (select *, cast(tokens as double) * 2.0 as cap, case domain when 'web' then 3.0 when 'books' then 1.0 else 1.0 end as w1,
  case lang when 'en' then 4.0 when 'fr' then 2.0 when 'de' then 2.0 when 'es' then 1.0 else 1.0 end as w2, 1.0 as w3 from leaves),
whole as (select least(sum(cap), floor(sum(tokens) * 0.5)) as given from weighed),
{_budget_step(1, 'whole')},
{_budget_step(2, 'u')},
{_budget_step(3, 'u')},
plan as (select l.domain, l.lang, l.source, cast(l.tokens as bigint) as tokens, cast(floor(g.given) as bigint) as budget
  from leaves l join g3 g on l.domain is not distinct from g.domain and l.lang is not distinct from g.lang and l.source is not distinct from g.source where l.tokens > 0 and floor(g.given) > 0),
k as (select d.*, p.budget // p.tokens as epochs, p.budget % p.tokens as rest, md5('mix|' || cast(p.budget // p.tokens as varchar) || '|' || coalesce(cast(d.doc_id as varchar), '')) as key
  from d join plan p on d.domain is not distinct from p.domain and d.lang is not distinct from p.lang and d.source is not distinct from p.source),
c as (select *, sum(n_tokens) over (partition by domain, lang, source order by key range between unbounded preceding and current row) as upto from k),
t as (select doc_id, domain, lang, source, n_tokens, cast(epochs + case when rest > 0 and upto <= rest then 1 else 0 end as bigint) as copies from c)
select * from t where copies > 0
"""
