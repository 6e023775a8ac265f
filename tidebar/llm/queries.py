"""The registered queries of this subpackage: each operator with its production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidebar.llm import chat, decontaminate, grammar, licenses, neardup, packing, phrases, pii, quality, secrets, tokens, trie, urls, wrappers
from tidebar.llm.base import LOWER, ORACLES, QUERIES, UPPER, query, table  # noqa: F401


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _license_sql() -> str:
    """Every block against every template, without any filter."""
    split = lambda x: f"list_filter(string_split_regex({x}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    places = []
    for phrase, _ in licenses.PHRASES:
        p = phrase.split()
        same = " and ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
        places.append(f"list_filter(range(len(w) - {len(p) - 1}), lambda i: {same})")
    found = ", ".join(f"case when len({p}) > 0 then '{label}' end" for p, (_, label) in zip(places, licenses.PHRASES))
    templates = ", ".join(f"('{label}', {sorted(set(licenses.words_of(t.lower())))}, {licenses.stride_of(t)})" for label, t in licenses.TEMPLATES)
    return f"""with d as (select doc_id, {_LOWER} as t, {split(_LOWER)} as w from documents),
b as (select doc_id, len(w) as n_words, list_concat({places[0]}, {places[1]}, {places[2]}) as places,
  list_filter([{found}], lambda x: x is not null) as found from d),
t(label, words, stride) as (values {templates}),
k as (select doc_id, w, stride, unnest(range(0, greatest(0, len(w) - stride - 1) + 1, stride)) as i from d, (select distinct stride from t)),
m as (select doc_id, label, len(list_intersect(w[i + 1 : i + 2 * t.stride], words)) as shared, len(words) as size from k join t on k.stride = t.stride),
g as (select doc_id, list(distinct label) as more, max(shared / size) as score from m where 10 * shared >= 8 * size group by 1)
select b.doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word,
  array_to_string(list_sort(found), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(found, coalesce(more, [])))), ',') as labels, coalesce(score, 0.0) as score
from b left join g on b.doc_id = g.doc_id"""


@query("op3_license_scan", _license_sql())
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf, "documents"))


@query("op7_secret_scan")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf, "documents"))


@query("op8_url_filter")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf, "pages"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf, "documents"))


@query("op10_chat_format")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from tidebar.session import staged

    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(extra))
    return chat.read_back(staged(formatted, "chat"))


@query("op6_personal_data")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return pii.scan_personal_data(table(spark, sf, "documents"))


# All pairs that share a shingle, counted; then everything reachable.
_NEAR_SQL = f"""with recursive d as (select doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from d),
u as (select doc_id, len(s) as n, unnest(s) as x from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c, any_value(a.n) as na, any_value(b.n) as nb
  from u a join u b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 80 * (na + nb - c)),
r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, l.b from r join l on r.other = l.a)
select s.doc_id, len(s.s) as n_shingles, m.component_id, s.doc_id = m.component_id as kept
from s join (select doc_id, min(other) as component_id from r group by 1) m on s.doc_id = m.doc_id"""


@query("op5_near_duplicates", _NEAR_SQL)
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), shingle=2, percent=80)


@query("op1_token_grammar")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return grammar.encode_and_read(table(spark, sf, "documents"), tokens.tokenizer_path("byte_bpe_50k.json"), end_id=2)


@query("op2_mixture_packing")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokens.tokenizer_path("word_bpe_49k.json"), end_id=2)


@query("op4_benchmark_leaks")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    pairs = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return pairs.select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), "share", "exact")


# Every phrase of up to three words, counted; every cut; every longer candidate around a shorter one.
_PHRASES_SQL = f"""with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from p),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) as phrase
  from w, (values (1), (2), (3)) as s(k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
t as (select lang, sum(f) as n from f where k = 1 group by 1),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as x from f where k > 1 and f >= 10),
h as (select lang, f as outer_f, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '), array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) as phrase
  from f where k = 3 and f >= 10),
d as (select c.* from c where not exists (select 1 from h where h.lang = c.lang and h.phrase = c.phrase and 100 * h.outer_f >= 50 * c.a)),
cut as (select d.lang, d.phrase, d.a, s.pos, y.f as l, z.f as r,
  ((1000000::hugeint * d.a * d.a) // (y.f::hugeint * z.f))::bigint as score
  from d join (values (1), (2)) as s(pos) on s.pos < d.k
  join f y on y.lang = d.lang and y.phrase = array_to_string(d.x[1 : s.pos], ' ')
  join f z on z.lang = d.lang and z.phrase = array_to_string(d.x[s.pos + 1 : d.k], ' ')),
b as (select * from cut qualify row_number() over (partition by lang, phrase order by score, pos) = 1),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b)
select o.lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score from o join t on o.lang = t.lang where rank <= 2000"""


@query("op12_phrase_collocations", _PHRASES_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


# The trie by its definition: every prefix as a list, every node against the nodes above it.
_TRIE_SQL = """with t as (select conv_id as c, list({'r': coalesce(role, ''), 'x': coalesce(text, '')}
  order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as l from conversations where conv_id is not null group by 1),
h as (select c, l, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(c::varchar, ''), lambda z: ord(z)::bigint)),
  lambda s, z: list_reduce(list_prepend(xor(s, z), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
  lambda u, v: case when u % 2 = 1 then xor(u >> 1, 3988292384) else u >> 1 end)), 4294967295) % 9 as h from t),
b as (select h.c, list_concat(coalesce(p.l, [])[1 : h.h], h.l[h.h + 1 : len(h.l)]) as l from h left join t p on p.c = h.c - h.c % 5),
m as (select c, d, l[1 : d] as k, len(l) as size from (select c, l, unnest(range(0, len(l) + 1)) as d from b)),
n as (select d, k, min(c) as c, count(*) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where size = d), '')) as e from m group by d, k),
i as (select m.c, m.d, n.c as node from m join n on m.d = n.d and m.k = n.k),
p as (select n.c, n.d, n.n, n.e, case when n.d = 0 then 0 else (n.n - 1) * strlen(n.k[n.d].x) end as s, i.node as parent
  from n left join i on i.c = n.c and i.d = n.d - 1),
k as (select parent as c, d - 1 as d, count(*) as n from p where d > 0 group by 1, 2),
u as (select i.node as c, i.d, sum(p.s) as s, count(*) filter (where k.n is null) as leaves
  from p join i on i.c = p.c and i.d <= p.d left join k on k.c = p.c and k.d = p.d group by 1, 2)
select p.c as conv_id, p.d as depth, p.parent as parent_conv_id, p.n as n_convs, coalesce(k.n, 0) as n_children,
  u.leaves as n_leaves, u.s::bigint as saved_tokens, p.e as ends_sha256
from p join u on u.c = p.c and u.d = p.d left join k on k.c = p.c and k.d = p.d"""


@query("op11_conversation_trie", _TRIE_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf, "conversations"))


@query("op13_article_text")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return wrappers.extract_articles(table(spark, sf, "pages"))
