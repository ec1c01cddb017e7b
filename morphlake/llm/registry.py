"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from morphlake.llm.op1_inverted_multi_index import op1_inverted_multi_index
from morphlake.llm.op2_curriculum_mix import op2_curriculum_mix
from morphlake.llm.op3_sampled_splitters import op3_sampled_splitters
from morphlake.llm.op4_lsh_forest_join import op4_lsh_forest_join
from morphlake.llm.op5_warc import op5_warc
from morphlake.llm.op6_suffix_automaton import op6_suffix_automaton
from morphlake.llm.op7_pii_transducers import op7_pii_transducers
from morphlake.llm.op8_additive_quality import op8_additive_quality
from morphlake.llm.op9_context_tree_weighting import op9_context_tree_weighting
from morphlake.llm.op10_license_sentences import op10_license_sentences
from morphlake.llm.op11_reversed_search import op11_reversed_search
from morphlake.llm.op12_tree_bpe import op12_tree_bpe
from morphlake.llm.op13_merkle_manifest import op13_merkle_manifest

_ALL = (
    op1_inverted_multi_index, op2_curriculum_mix, op3_sampled_splitters, op4_lsh_forest_join, op5_warc,
    op6_suffix_automaton, op7_pii_transducers, op8_additive_quality, op9_context_tree_weighting, op10_license_sentences,
    op11_reversed_search, op12_tree_bpe, op13_merkle_manifest,
)


def queries():
    return {f.__name__: f for f in _ALL}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce({}, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Brute force over all pairs of documents that share a shingle, and components by following links.
_OP4 = f"""
with recursive w as (select doc_id, {_WORDS.format("text")} as ws from documents),
n as (select doc_id, ws, case when len(ws) = 0 then 0 else greatest(1, len(ws) - 4) end as n, array_to_string(ws, ' ') as t from w),
g as (select distinct doc_id, case when len(ws) < 5 then t else array_to_string(ws[i:i+4], ' ') end as g from (select *, unnest(range(1, n + 1)) as i from n)),
s as (select doc_id, count(*) as s from g group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b where c >= 0.8 * (x.s + y.s - c) - 1e-9),
r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on l.a = r.b)
select n.doc_id, (select min(b) from r where r.a = n.doc_id) as class_id, (select count(*) from l where l.a = n.doc_id) as n_links,
  case when n = 0 then 1 else count(*) over (partition by t) end as n_copies, n as n_shingles from n
"""
_OP5 = """
with p as (select page_id, coalesce(html, '') as h from pages), q as (select *, strlen(h) as b, min(page_id) over (partition by h) as f from p)
select page_id, b as payload_bytes, sha256(h) as payload_digest, case when b >= 100 and f <> page_id then 'revisit' else 'response' end as record_type, case when b >= 100 and f <> page_id then f end as refers_to from q
"""
_OP6 = f"""
with d as (select doc_id, {_WORDS.format("text")} as ws from documents), i as (select item_id, {_WORDS.format("text")} as ws from benchmark),
iw as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') as g from (select *, unnest(range(1, greatest(2, len(ws) - 8))) as p from i where len(ws) > 0)),
ns as (select distinct n from iw),
dw as (select doc_id, ns.n, p, array_to_string(ws[p:p + ns.n - 1], ' ') as g from (select *, unnest(range(1, len(ws) + 1)) as p from d), ns where p + ns.n - 1 <= len(ws)),
h as (select distinct dw.doc_id, iw.item_id, dw.p, dw.n from dw join iw on dw.n = iw.n and dw.g = iw.g),
c as (select doc_id, count(distinct w) as n_hit from (select doc_id, unnest(range(p, p + n)) as w from h) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as items from (select distinct doc_id, cast(item_id as varchar) as x from h) group by 1)
select d.doc_id, len(d.ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join m using (doc_id)
"""

_TERMS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_OP11 = f"""
with d as (select doc_id, {_TERMS} as ts from documents), b as (select row_number() over () as item, item_id, {_TERMS} as ts from benchmark),
s as (select count(*) as n, sum(len(ts))::bigint as l from d where len(ts) > 0),
q as (select item, item_id, t, count(*) as times from (select item, item_id, unnest(ts) as t from b) group by 1, 2, 3),
c as (select row, doc_id, t, count(*) as tf, any_value(n) as n from (select row_number() over () as row, doc_id, len(ts) as n, unnest(ts) as t from d) group by 1, 2, 3),
k as (select c.* from c semi join q using (t)), f as (select t, count(*) as df from k group by 1),
w as (select t, floor(1000 * ln((2.0::double * s.n + 2) / (2 * df + 1)))::bigint as w from f, s),
x as (select item, item_id, row, doc_id, sum(w * times * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * k.n * s.n) // s.l)))))::bigint as score from k join q using (t) join w using (t), s group by 1, 2, 3, 4),
r as (select item_id, row_number() over (partition by item order by score desc, doc_id) as rank, doc_id, score from x where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""


def _merkle(tree: str, height: int) -> str:
    """Levels above {tree}0 (k, pos, node) as SQL, and what is left and right of each node in its run; a level of one node is its own."""
    out = []
    for h in range(height):
        run = "partition by k, pos // 3 order by pos"
        sides = ", ".join(f"case when n > 1 then coalesce(string_agg(node, '') over ({run} rows between {rows}), '') end as {side}" for side, rows in (("lft", "unbounded preceding and 1 preceding"), ("rgt", "1 following and unbounded following")))
        out.append(f"{tree}{h}s as (select *, {sides} from (select *, count(*) over (partition by k) as n from {tree}{h}))")
        out.append(f"{tree}{h + 1} as (select k, pos // 3 as pos, case when any_value(n) = 1 then any_value(node) else sha256(string_agg(node, '' order by pos)) end as node from {tree}{h}s group by 1, 2)")
    return ",\n".join(out)


_HEIGHT, _UPPER = 11, 6
_FIELD = "coalesce(strlen({0}::varchar)::varchar || ':' || {0}::varchar, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {})"
_BIT = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
_STEPS = [*[(f"a{h}", 3**h, "t.k", "t.pos") for h in range(_HEIGHT)], *[(f"b{h}", 3**h, "''", "t.up") for h in range(_UPPER)]]
_TAKEN = ", ".join(f"t{i + 1} as (select t.* exclude (fold, proof), coalesce(sha256(lft || fold || rgt), fold) as fold, proof || coalesce(lft || rgt, '') as proof from t{i} t join {name}s s on s.k = {key} and s.pos = {pos} // {size})" for i, (name, size, key, pos) in enumerate(_STEPS))
#: Trees of up to 3 ** 11 leaves a source, and up to 3 ** 6 sources. crc32 of an id is taken byte by byte from its table.
_OP13 = f"""
with recursive c0 as (select i, 0 as step, i::bigint as v from range(256) r(i) union all select i, step + 1, {_BIT.format("v")} from c0 where step < 8),
crc as (select list(v order by i) as tab from c0 where step = 8),
d as (select *, coalesce('=' || source, '-') as k, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])) % 2 = 1 as hit from documents, crc),
e as (select *, {_LEAF.format(_FIELD.format("text"))} as leaf, {_LEAF.format(_FIELD.format("other"))} as altered from (select *, case when hit then replace(text, chr(10), '') else text end as other from d)),
l as (select *, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as pos from e),
a0 as (select k, pos, leaf as node from l),
{_merkle("a", _HEIGHT)},
u as (select k, node as subroot, row_number() over (order by k) - 1 as pos from a{_HEIGHT}),
b0 as (select '' as k, pos, subroot as node from u),
{_merkle("b", _UPPER)},
t0 as (select l.k, l.pos, u.pos as up, doc_id, leaf, subroot, altered as fold, '' as proof from l join u using (k)),
{_TAKEN}
select doc_id, leaf, subroot, b{_UPPER}.node as root, sha256(proof) as proof_sha256, fold as folded_root, fold = b{_UPPER}.node as verified from t{_HEIGHT + _UPPER}, b{_UPPER}
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_lsh_forest_join": _OP4, "op5_warc": _OP5, "op6_suffix_automaton": _OP6, "op11_reversed_search": _OP11, "op13_merkle_manifest": _OP13}
