"""Queries over the training-data tables, one per operator, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of documents: 3-word shingles, at most 2 of 64 bits apart."""
    from .simhash import simhash_groups

    g = simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)
    return g.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in documents."""
    from .decontam import contamination

    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=10)
    return c.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


_DOC_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLES["op5_decontaminate"] = f"""
with d as (select doc_id, row_number() over () as r, {_DOC_WORDS} as w from documents),
b as (select item_id, {_DOC_WORDS} as w from benchmark),
bw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
ln as (select distinct n from bw),
dw as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join ln where len(w) >= n)),
hits as (select distinct dw.r, dw.i, dw.n from dw semi join bw on dw.n = bw.n and dw.g = bw.g),
cover as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from hits) group by r),
its as (select r, count(*) as n_items, string_agg(s, ',' order by s) as l
        from (select distinct dw.r, cast(bw.item_id as varchar) as s from dw join bw on dw.n = bw.n and dw.g = bw.g where bw.item_id is not null) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cover using (r) left join its using (r)
"""


@query
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the verdict of the adaptive fences."""
    from .quality_rules import quality_rules

    q = quality_rules(table(spark, sf_dir, "documents"), min_docs=100, spread=3)
    return q.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATES = {"symbols": "greatest(n_symbols - 1, 0) * 1000 // greatest(n_words, 1)", "repeats": "greatest(n_repeat_words - 16, 0) * 1000 // greatest(n_words, 1)", "adjacent": "n_adjacent * 1000 // greatest(n_words, 1)", "dup_lines": "greatest(n_dup_lines - 1, 0) * 1000 // greatest(n_lines, 1)", "length": "word_chars * 100 // greatest(n_words, 1)"}
_LEVELS = {"lo": (1, 200), "q1": (1, 4), "mid": (1, 2), "q3": (3, 4), "hi": (199, 200)}
_VALUE = "case when {b} < 32 then {b} else ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1) end"


def _quantiles(source: str, g: str) -> str:
    """Per group g: total, and <rate>_<level> from the sketch table."""
    at = ", ".join(f"min(case when {d} * upto >= {n} * total then bucket end) as {k}" for k, (n, d) in _LEVELS.items())
    value = {k: _VALUE.format(b="(" + k + " + 1)") + " - 1" if k in ("q3", "hi") else _VALUE.format(b=k) for k in _LEVELS}
    names = ", ".join(f"max(case when rate = '{r}' then {value[k]} end) as {r}_{k}" for r in _RATES for k in _LEVELS)
    return f"""select {g}, max(total) as total, {names} from (select {g}, rate, max(total) as total, {at} from (
      select {g}, rate, bucket, sum(n) over (partition by {g}, rate order by bucket) as upto, sum(n) over (partition by {g}, rate) as total
      from (select {g}, rate, bucket, sum(n) as n from {source} group by all)) group by {g}, rate) group by {g}"""


def _sketch(rows: str) -> str:
    each = " union all ".join(f"select lang, source, '{k}' as rate, cast({e} as bigint) as v from {rows}" for k, e in _RATES.items())
    return f"select 0 as z, coalesce(lang, '?') as lg, coalesce(source, '?') as so, rate, case when v < 32 then v else 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) end as bucket, cast(count(*) as bigint) as n from ({each}) group by all"


def _joined(rows: str, k: int) -> str:
    return f"{rows} b left join o{k} o on o.lg = coalesce(lang, '?') and o.so = coalesce(source, '?') left join l{k} l on l.lg = coalesce(lang, '?') left join a{k} a on true"


_PICK = lambda c: f"(case when o.total >= 100 then o.{c} when l.total >= 100 then l.{c} else a.{c} end)"
_TYPICAL = " and ".join(f"coalesce({_PICK(k + '_q1')} = {_PICK(k + '_q3')} or (2 * ({_RATES[k]}) >= 2 * {_PICK(k + '_q1')} - 3 * ({_PICK(k + '_q3')} - {_PICK(k + '_q1')}) and 2 * ({_RATES[k]}) <= 2 * {_PICK(k + '_q3')} + 3 * ({_PICK(k + '_q3')} - {_PICK(k + '_q1')})), true)" for k in ("length", "adjacent"))
_INSIDE = " and ".join([f"coalesce({e} <= {_PICK(k + '_hi')} + 3 * ({_PICK(k + '_hi')} - {_PICK(k + '_mid')}), true)" for k, e in _RATES.items()] + [f"coalesce({_RATES['length']} >= {_PICK('length_lo')} - 3 * ({_PICK('length_mid')} - {_PICK('length_lo')}), true)"])
ORACLES["op8_quality_rules"] = rf"""
with d as materialized (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents),
g as (select r, i, array_to_string(w[i:i + 7], ' ') as g from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
g2 as (select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1),
rw as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from g2) group by r),
st as materialized (select d.r, doc_id, lang, source, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(rw.n, 0) as bigint) as n_repeat_words, cast(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as bigint) as n_adjacent, cast(len(ls) as bigint) as n_lines
  from d left join rw using (r)),
sb as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from st),
fair as materialized (select * from sb where not base_failed),
sk1 as materialized ({_sketch("fair")}),
o1 as materialized ({_quantiles("sk1", "lg, so")}),
l1 as materialized ({_quantiles("sk1", "lg")}),
a1 as materialized ({_quantiles("sk1", "z")}),
ref as materialized (select b.* from {_joined("fair", 1)} where {_TYPICAL}),
sk2 as materialized ({_sketch("ref")}),
o2 as materialized ({_quantiles("sk2", "lg, so")}),
l2 as materialized ({_quantiles("sk2", "lg")}),
a2 as materialized ({_quantiles("sk2", "z")})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_INSIDE} as kept
from {_joined("sb", 2)}
"""


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, at most 256 KiB of text each (small, so that small tables split as well)."""
    from .sharding import shards

    s = shards(table(spark, sf_dir, "documents"), limit=256 << 10)
    return s.select(F.col("id").alias("doc_id"), "n_bytes", "depth", "shard")


ORACLES["op4_sharding"] = """
with d as (select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as k from documents),
b as (select z, k >> (60 - z) as p from d cross join (select unnest(range(0, 41)) as z) group by z, k >> (60 - z) having sum(n_bytes) <= 262144 or count(*) = 1),
f as (select k, min(z) as depth from (select distinct k from d) join b on p = k >> (60 - z) group by k)
select doc_id, n_bytes, cast(depth as integer) as depth, substr(lpad(bin(k), 60, '0'), 1, depth) as shard from d join f using (k)
"""


@query
def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of documents, written as Parquet lists and read back."""
    import public_tokenizers

    from .tokens import tokenize_round_trip

    t = tokenize_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return t.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of the weakly labelled classifier for every document."""
    from .quality_classifier import score

    return score(table(spark, sf_dir, "documents"), train_rows=6000).withColumnRenamed("id", "doc_id")


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and fitted rates of documents for the target token shares."""
    from .mixing import TARGETS, domain, mixture

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), domain().alias("domain"))
    return mixture(table(spark, sf_dir, "documents"), labels, TARGETS, train_rows=6000).withColumnRenamed("id", "doc_id").drop("h")


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, written to seekable bundles and read back."""
    from .warc import warc_round_trip

    r = warc_round_trip(table(spark, sf_dir, "pages"), revisit_least=0)
    return r.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc"] = """
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first, count(*) as n from p group by h)
select page_id, cast(strlen(t) as bigint) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((cast('0x' || substr(p.h, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as bigint) + 1, 1)), 'string_agg', '') as payload_digest,
  case when n > 1 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when n > 1 and page_id <> first then first end as refers_to
from p join f on p.h = f.h
"""


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents outside the 13-word windows that a smaller doc_id has too."""
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), size=13).withColumnRenamed("id", "doc_id")


ORACLES["op6_substring_dedup"] = r"""
with d as materialized (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)),
h as (select r, i from (select r, i, doc_id, min(doc_id) over (partition by g) as m from g) where doc_id > m),
c as (select distinct r, p from (select r, unnest(range(i, i + 13)) as p from h)),
k as (select d.r, string_agg(x.word, ' ' order by x.p) as kept, count(*) as n from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) x
  join d using (r) anti join c on x.r = c.r and x.p = c.p group by d.r)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join k using (r)
"""


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines of at least 20 code points that three of them share."""
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents"), least_docs=3, least_chars=20).withColumnRenamed("id", "doc_id")


ORACLES["op3_line_dedup"] = r"""
with l as materialized (select r, doc_id, line, i, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select r, doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as i from (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
k as (select key, max(doc_id) as last from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select l.*, k.key is not null and l.doc_id <> k.last as gone from l left join k on l.key = k.key)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by r, doc_id
"""


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two or three words."""
    from .phrases import collocations

    return collocations(table(spark, sf_dir, "documents"), max_words=3, least=10, share=50, top=2000)


ORACLES["op11_phrases"] = r"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as x from d)),
f as materialized (select lang, m, phrase, cast(count(*) as hugeint) as f from (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from p cross join (select unnest([1, 2, 3]) as m) where len(w) >= m)) group by all),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m >= 2 and f >= 10),
k as (select lang, m, phrase, a, w, unnest(range(1, m)) as k from c),
s as (select k.lang, k.m, k.phrase, k.a, k.k, x.f as l, y.f as r, (1000000 * k.a * k.a) // (x.f * y.f) as score
      from k join f x on x.lang = k.lang and x.m = k.k and x.phrase = array_to_string(k.w[1:k.k], ' ') join f y on y.lang = k.lang and y.m = k.m - k.k and y.phrase = array_to_string(k.w[k.k + 1:], ' ')),
b as (select lang, m, phrase, a, l, r, score from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
g as (select lang, max(a) as longer, phrase from (select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase from c where m = 3) group by lang, phrase),
n as (select lang, sum(f) as n from f where m = 1 group by lang)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from b left join g on b.lang = g.lang and b.phrase = g.phrase join n on n.lang = b.lang where longer is null or 100 * longer < 50 * a qualify rank <= 2000
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations that share their first turns with every hundredth."""
    from .prefix_trie import prefix_trie, sequences, spliced

    seqs = sequences(table(spark, sf_dir, "conversations"))
    c = F.col("conv_id")
    return prefix_trie(spliced(seqs, c - c % 100, F.crc32(c.cast("string")) % 6, most=5))


_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda a, k: case when a & 1 = 1 then xor(3988292384, a >> 1) else a >> 1 end))"
_CRC32 = "xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split({s}, ''), lambda x: cast(ascii(x) as bigint))), lambda a, b: xor(a >> 8, cast(tab[(xor(a, b) & 255) + 1] as bigint))))"
ORACLES["op12_prefix_trie"] = f"""
with t as materialized (select conv_id, row_number() over (partition by conv_id order by turn nulls first, md5(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos,
    md5(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as g, cast(length(coalesce(text, '')) as bigint) as chars from conversations where conv_id is not null),
k as (select {_CRC_TABLE} as tab),
c as materialized (select conv_id, {_CRC32.format(s="cast(conv_id as varchar)")} % 6 as h from (select distinct conv_id from t) cross join k),
b as (select c.conv_id, t.pos, t.g, t.chars from c join t on t.conv_id = c.conv_id - c.conv_id % 100 and t.pos <= h
      union all select c.conv_id, 1000000 + t.pos, t.g, t.chars from c join t on t.conv_id = c.conv_id and t.pos > h),
s as materialized (select conv_id, coalesce(list(g order by pos) filter (g is not null), []) as gs, coalesce(list(chars order by pos) filter (g is not null), []) as cs from (select c.conv_id, b.pos, b.g, b.chars from c left join b using (conv_id)) group by conv_id),
m as (select conv_id, d, array_to_string(gs[1:d], '') as p, case when d = 0 then '' else array_to_string(gs[1:d - 1], '') end as up, case when d = 0 then 0 else cs[d] end as chars, len(gs) = d as ends from (select *, unnest(range(0, len(gs) + 1)) as d from s)),
n as materialized (select d, p, min(up) as up, min(conv_id) as conv_id, count(*) as n, max(chars) as chars, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '') as ids from m group by d, p),
ch as (select d - 1 as d, up as p, count(*) as n from n where d > 0 group by all),
a as (select n.*, coalesce(ch.n, 0) as children from n left join ch on n.d = ch.d and n.p = ch.p),
sub as (select k as d, p[:32 * k] as p, sum((n - 1) * chars) as saved, count(*) filter (children = 0) as leaves from (select *, unnest(range(0, d + 1)) as k from a) group by all)
select a.conv_id, cast(a.d as bigint) as depth, u.conv_id as parent_conv_id, cast(a.n as bigint) as n_convs, cast(children as bigint) as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, sha256(a.ids) as ends_sha256
from a join sub on a.d = sub.d and a.p = sub.p left join n u on a.d > 0 and u.d = a.d - 1 and u.p = a.up
"""


@query
def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main language of every document, from mixtures of languages learnt without a third of them."""
    from .langid import languages

    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return languages(table(spark, sf_dir, "documents"), held_out=third).withColumnRenamed("id", "doc_id")
