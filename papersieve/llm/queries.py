"""The operators' queries over the given tables: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papersieve.llm import bpe, codes, decontaminate, html, licences, neardup, pii, quality, substrings, topk, toxicity, trie, warc
from papersieve.llm.common import table
from papersieve.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query
def op1_byte_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), *vocabulary())


@query
def op2_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op10_top_k"] = """
with parts as (
  select vec_id, i, cast(floor(1024 * cast(embedding[i] as double)) as bigint) as x
  from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings
        where embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0)),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(sum(q.x * c.x) as bigint) as score
  from parts q join parts c on q.i = c.i and q.vec_id <> c.vec_id
  where q.vec_id % 100 = 0 group by all)
select query_id, cast(row_number() over w as integer) as rank, vec_id, score
from scored window w as (partition by query_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""


@query
def op8_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


@query
def op4_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_personal_data(spark, sf_dir):
    return pii.span_digests(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.classify(docs, table(spark, sf_dir, "labels")).drop("text")


@query
def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op5_licences(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query
def op11_prefix_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a string in SQL: eight steps a byte, the byte entering at the first of them.
_CRC = """(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, length(s) + 1), lambda i: list_concat([ascii(s[i])::bigint], [0::bigint for z in range(7)])))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384::bigint * (xor(c, b) & 1))))"""

ORACLES["op11_prefix_trie"] = f"""
with turns as (
  select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first) as own
  from conversations where conv_id is not null group by conv_id),
sums as (select conv_id, own, xor({_CRC}, 4294967295::bigint) % 6 as h from (select *, conv_id::varchar as s from turns)),
rebuilt as (
  select a.conv_id, list_concat(coalesce(b.own, [])[1:a.h], a.own[a.h + 1:]) as seq
  from sums a left join turns b on b.conv_id = a.conv_id - a.conv_id % 100),
steps as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from rebuilt),
prefixes as (
  select conv_id, depth, depth = len(seq) as ends, md5(seq[1:depth]::varchar || depth) as node,
    case when depth > 0 then md5(seq[1:depth - 1]::varchar || (depth - 1)) end as parent,
    case when depth > 0 then length(seq[depth].t) else 0 end as size
  from steps),
nodes as (
  select node, min(depth) as depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from prefixes group by node),
children as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
lines as (
  select distinct a.node as above, d.node as below
  from prefixes a join prefixes d on a.conv_id = d.conv_id and a.depth <= d.depth),
sums_below as (
  select l.above, count(*) filter (where c.parent is null) as n_leaves, sum((n.n_convs - 1) * n.size)::bigint as saved_tokens
  from lines l join nodes n on n.node = l.below left join children c on c.parent = l.below group by l.above)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(c.n_children, 0)::bigint as n_children,
  s.n_leaves::bigint as n_leaves, s.saved_tokens, n.ends_sha256
from nodes n left join nodes p on p.node = n.parent left join children c on c.parent = n.node join sums_below s on s.above = n.node
"""


@query
def op12_warc_index(spark, sf_dir):
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"), folder)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op12_warc_index"] = """
with payloads as (select page_id, coalesce(html, '') as payload from pages),
digests as (select page_id, payload, octet_length(encode(payload)) as payload_bytes, sha1(payload) as hex, max(page_id) over (partition by payload) as keeper from payloads),
groups as (
  select *, list_transform(range(0, 8), lambda i: ('0x' || hex[5 * i + 1 : 5 * i + 5])::bigint) as parts from digests)
select page_id, payload_bytes::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((parts[1 + j // 4] >> (15 - 5 * (j % 4))) & 31)]), 'string_agg', '') as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type,
  case when page_id <> keeper then keeper end as refers_to
from groups
"""


@query
def op13_vector_codes(spark, sf_dir):
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """Assignment and update of every round, each a common table of the next."""
    out = []
    for k in range(rounds + 1):
        out.append(f"""
near{k} as (
  select p.row, p.part, min({{'d': list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v) + list_inner_product(b.v, b.v), 'e': b.entry}}) as m
  from parts p join book{k} b on p.part = b.part group by all)""")
        if k < rounds:
            out.append(f"""
mean{k} as (
  select part, entry, list(x order by i) as v from (
    select n.part, n.m.e as entry, i, floor(sum(p.v[i]) / count(*)) as x
    from near{k} n join parts p on p.row = n.row and p.part = n.part, unnest(range(1, len(p.v) + 1)) u(i) group by all) group by all),
book{k + 1} as (select b.part, b.entry, coalesce(m.v, b.v) as v from book{k} b left join mean{k} m on m.part = b.part and m.entry = b.entry)""")
    return ",".join(out)


ORACLES["op13_vector_codes"] = f"""
with kept as (
  select row_number() over (order by vec_id) as row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (select row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] as v from kept, unnest(range(0, 4)) u(part)),
book0 as (select part, row - 1 as entry, v from parts where row <= 256),
{_rounds_sql(4)},
digest as (select sha256(string_agg(array_to_string(list_transform(v, lambda x: x::bigint), ','), ',' order by part, entry)) as codebooks_sha256 from book4),
coded as (
  select k.vec_id, k.label, string_agg(lower(printf('%02x', n.m.e)), '' order by n.part) as code, sum(n.m.d)::bigint as error
  from near4 n join kept k on k.row = n.row group by k.row, k.vec_id, k.label)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded, digest
"""
