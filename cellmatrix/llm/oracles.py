"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = """with p as (select page_id, coalesce(html, '') t from pages), b as (select *, octet_length(encode(t)) n from p)
select page_id, cast(n as bigint) payload_bytes, sha1(t) payload_digest,
 case when n >= 1000 and page_id <> max(page_id) over (partition by t) then 'revisit' else 'response' end record_type,
 case when n >= 1000 and page_id <> max(page_id) over (partition by t) then max(page_id) over (partition by t) end refers_to from b"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2 = f"""with recursive w as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) s from w),
f as (select doc_id, len(s) n, unnest(s) x from g),
pairs as (select a.doc_id a, b.doc_id b, count(*) c from f a join f b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
links as (select a, b from pairs join g x on x.doc_id = a join g y on y.doc_id = b where 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
reach as (select doc_id a, doc_id b from g union select reach.a, links.b from reach join links on reach.b = links.a)
select g.doc_id, cast(len(s) as bigint) n_shingles, min(b) component_id, g.doc_id = min(b) kept from g join reach on g.doc_id = a group by g.doc_id, s"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1, "op2_minhash_neardup": OP2}
