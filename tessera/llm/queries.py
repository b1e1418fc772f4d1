"""The registered queries of the text operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, fim, html, line_dedup, merkle, ngram_join, packing, pii, quality, secrets, sharding, suffix_tree, token_counts
from tessera.llm.common import read


def tokenizer_path() -> str:
    """Of the byte-level vocabulary; TESSERA_TOKENIZER names another file."""
    if named := os.environ.get("TESSERA_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: read(s, d, "documents")
    return {
        "op1_minimax_sharding": lambda s, d: sharding.shard(docs(s, d), 16),
        "op2_html_extraction": lambda s, d: html.extract(read(s, d, "pages")),
        "op3_secret_scan": lambda s, d: secrets.scan(docs(s, d)),
        "op4_quality_rules": lambda s, d: quality.score(docs(s, d)),
        "op5_ngram_jaccard_join": lambda s, d: ngram_join.components(docs(s, d)),
        "op6_line_dedup": lambda s, d: line_dedup.dedup_lines(docs(s, d), report=True).select("doc_id", "text", "n_removed", "removed"),
        "op7_token_counts": lambda s, d: token_counts.count_tokens(docs(s, d), tokenizer_path()),
        "op8_pii": lambda s, d: pii.scan(docs(s, d)),
        "op9_benchmark_decontamination": lambda s, d: decontam.find_leaks(docs(s, d), read(s, d, "benchmark")),
        "op10_best_fit_packing": lambda s, d: packing.pack_documents(docs(s, d), tokenizer_path()),
        "op11_suffix_tree_scores": lambda s, d: suffix_tree.score(docs(s, d)),
        "op12_fill_in_middle": lambda s, d: fim.digests(docs(s, d)),
        "op13_merkle_manifest": lambda s, d: merkle.audit(docs(s, d)),
    }


#: Levels of the trees in SQL: 8**7 leaves a language.
LEVELS = 7


def _tree_sql(name: str, leaves: str) -> str:
    """CTEs of the trees over (g, pos, hash): a path of (run, own place) and the top for every leaf."""
    part = [f"{name}0 as ({leaves})"]
    for k in range(1, LEVELS + 1):
        part.append(f"{name}{k} as (select g, p as pos, sha256(string_agg(hash, '' order by pos)) as hash, list(hash order by pos) as run from (select *, pos // 8 as p, count(*) over (partition by g) as m from {name}{k - 1}) where m > 1 group by g, p)")
    join = " ".join(f"left join {name}{k} x{k} on x{k}.g is not distinct from l.g and x{k}.pos = l.pos // {8**k}" for k in range(1, LEVELS + 1))
    path = ", ".join(f"case when x{k}.run is not null then [struct_pack(run := x{k}.run, own := l.pos // {8 ** (k - 1)} % 8)] else [] end" for k in range(1, LEVELS + 1))
    top = ", ".join(f"x{k}.hash" for k in range(LEVELS, 0, -1))
    return ",\n".join([*part, f"{name}_path as (select l.*, flatten([{path}]) as path, coalesce({top}, l.hash) as top from {name}0 l {join})"])


def _merkle_sql() -> str:
    text = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    leaf = lambda t: "sha256(" + " || ".join(text(f"cast({c} as varchar)") for c in ("doc_id", "source", "lang", "n_chars", t)) + ")"
    fold = "list_reduce(list_prepend(struct_pack(run := [{0}], own := -1), {1}), lambda a, s: struct_pack(run := [sha256(array_to_string(s.run[1:s.own] || [a.run[1]] || s.run[s.own + 2:], ''))], own := -1)).run[1]"
    # DuckDB has no crc32: bit by bit over the digits of the id.
    return f"""
with recursive digit as (select doc_id, cast(doc_id as varchar) as s, 4294967295::ubigint as c, 0 as k from (select distinct doc_id from documents where doc_id is not null)
  union all select doc_id, s, {_crc_step()}, k + 1 from digit where k < length(s)),
hit as (select doc_id from digit where k = length(s) and xor(c, 4294967295::ubigint) % 3 = 0),
hashed as (select d.doc_id, d.lang, {leaf("text")} as hash, {leaf("case when h.doc_id is not null then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end")} as other from documents d left join hit h using (doc_id)),
{_tree_sql("a", "select doc_id, lang as g, hash, other, row_number() over (partition by lang order by doc_id nulls first, hash) - 1 as pos from hashed")},
{_tree_sql("b", "select 0 as g, lang, hash, row_number() over (order by lang nulls first) - 1 as pos from (select g as lang, any_value(top) as hash from a_path group by 1)")},
whole as (select a.doc_id, a.hash as leaf, a.other, a.top as subroot, b.top as root, list_concat(a.path, b.path) as path from a_path a join b_path b on a.g is not distinct from b.lang),
out as (select *, {fold.format("other", "path")} as folded_root from whole)
select doc_id, leaf, subroot, root, sha256(array_to_string(flatten(list_transform(path, lambda s: s.run[1:s.own] || s.run[s.own + 2:])), '')) as proof_sha256, folded_root, folded_root = root as verified from out"""


def _crc_step() -> str:
    step = "xor(c, ascii(substr(s, k + 1, 1))::ubigint)"
    for _ in range(8):
        step = f"(select case when x & 1 = 1 then xor(x >> 1, 3988292384::ubigint) else x >> 1 end from (select {step} as x))"
    return step


def oracle_sql() -> dict[str, str]:
    return {
        "op13_merkle_manifest": _merkle_sql(),
        "op11_suffix_tree_scores": lambda s, d: suffix_tree.score(docs(s, d)),
        "op12_fill_in_middle": r"""
with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), 'null')) as d from documents),
draw as (select *, len(u) as n, [('0x' || d[8 * k + 1:8 * k + 8])::ubigint for k in [0, 1, 2, 3]] as h from units),
cut as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
        case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form from draw),
part as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:], '') as s from cut)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then text when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from part""",
        "op6_line_dedup": r"""
with split as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as pos from split),
worded as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from line),
placed as (select *, sum(n) over (partition by doc_id order by pos) - n as before, sum(n) over (partition by doc_id) as total, row_number() over (partition by doc_id order by pos) as rn from worded where n > 0),
win as (select doc_id, pos, total - before as rest, list(line) over w as key, max(pos) over w as last, max(rn) over w as last_rn from placed
        window w as (partition by doc_id order by before range between current row and 49 following)),
nth as (select *, row_number() over o as nth, first_value(doc_id) over o as odoc, first_value(last_rn) over o as orn from win where rest >= 50 window o as (partition by key order by doc_id, pos)),
later as (select doc_id, pos as first, last, last_rn, odoc, orn from nth where nth > 1),
hit as (select l.doc_id, l.pos from line l where exists (select 1 from later c where c.doc_id = l.doc_id and l.pos between c.first and c.last)),
run as (select doc_id, min(pos) as a, max(pos) as b from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as g from hit) group by doc_id, g),
final as (select r.doc_id, r.a, r.b, max_by(struct_pack(rn := c.last_rn, odoc := c.odoc, orn := c.orn), struct_pack(l := c.last, f := c.first)) as t from run r join later c on c.doc_id = r.doc_id and c.first between r.a and r.b group by all),
next as (select f.doc_id, f.a, f.b, l.pos, l.rn - f.t.rn as i, o.line is not null and o.line = l.line as same from final f join placed l on l.doc_id = f.doc_id and l.rn > f.t.rn left join placed o on o.doc_id = f.t.odoc and o.rn = f.t.orn + l.rn - f.t.rn),
stop as (select doc_id, a, b, min(i) filter (where not same) as i from next group by all),
reach as (select n.doc_id, n.a, n.b, max(n.pos) as e from next n join stop s on n.doc_id = s.doc_id and n.a = s.a and n.b = s.b and n.i < coalesce(s.i, 1e18) group by all),
whole as (select f.doc_id, f.a, coalesce(r.e, f.b) as b from final f left join reach r on r.doc_id = f.doc_id and r.a = f.a and r.b = f.b),
marked as (select l.doc_id, l.pos, l.line, exists (select 1 from whole c where c.doc_id = l.doc_id and l.pos between c.a and c.b) as cut from line l),
island as (select doc_id, min(pos) as a, max(pos) as b from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as g from marked where cut) group by doc_id, g),
runs as (select doc_id, string_agg(a || ':' || b, ',' order by a) as removed, cast(sum(b - a + 1) as bigint) as n_removed from island group by doc_id),
left_over as (select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (where not cut), '') as text from marked group by doc_id)
select s.doc_id, case when r.doc_id is null then s.text else o.text end as text, coalesce(r.n_removed, 0) as n_removed, coalesce(r.removed, '') as removed
from split s left join runs r using (doc_id) left join left_over o using (doc_id)""",
    }
