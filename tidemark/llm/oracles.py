"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: str) -> str:
    return f"translate({x}, '{_UPPER}', '{_LOWER}')"


LINE_DEDUP = rf"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i
  from documents),
keyed as (select *, {_lower(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} as key from lines),
repeats as (select key, max(doc_id) as last from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (select k.*, r.key is not null and k.doc_id <> r.last as gone from keyed k left join repeats r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

#: An unsigned CRC-32 of a text of ASCII characters.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split({}, ''), lambda x: ascii(x)::bigint),
  lambda c, b: list_reduce(range(8), lambda a, j: xor(a >> 1, 3988292384 * (a & 1)), xor(c, b)), 4294967295::bigint))"""


def _tree(name: str, nodes: str) -> str:
    """Levels (g, k, i, h, n) over nodes (g, i, h, n): runs of 16 become their hash while a group has several."""
    return f"""{name} as (select g, 0 as k, i, h, n from {nodes}
  union all select g, k + 1, i // 16, sha256(string_agg(h, '' order by i)), (min(n) + 15) // 16 from {name} where n > 1 group by g, k, i // 16)"""


def _steps(tree: str, ids: str) -> str:
    """For each of ids (g, i) and level its siblings (k, before, after)."""
    return f"""select a.g, a.i, b.k, string_agg(b.h, '' order by b.i) filter (where b.i < a.i // pow(16, b.k)::bigint) as before,
  string_agg(b.h, '' order by b.i) filter (where b.i > a.i // pow(16, b.k)::bigint) as after
  from {ids} a join {tree} b on a.g = b.g and b.n > 1 and b.i // 16 = a.i // pow(16, b.k + 1)::bigint group by a.g, a.i, b.k"""


def _field(x: str) -> str:
    return f"case when {x} is null then '-' else strlen({x}::varchar)::varchar || ':' || {x}::varchar end"


MERKLE = f"""
with recursive leaves as (
  select doc_id, coalesce('1' || source, '0') as g, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) as h,
    case when {_CRC.format("doc_id::varchar")} % 5 = 0 then sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", _lower("text"))))}) end as altered
  from documents),
numbered as (select *, row_number() over (partition by g order by doc_id, h) - 1 as i, count(*) over (partition by g) as n from leaves),
{_tree("rows_tree", "numbered")},
subroots as (select g as code, h, row_number() over (order by g) - 1 as i, count(*) over () as n, '' as g from rows_tree where n = 1),
{_tree("top_tree", "subroots")},
root as (select h from top_tree where n = 1),
steps as (
  select n.doc_id, s.k, s.before, s.after from numbered n join ({_steps("rows_tree", "numbered")}) s on n.g = s.g and n.i = s.i
  union all
  select n.doc_id, 1000 + s.k, s.before, s.after from numbered n join subroots r on n.g = r.code join ({_steps("top_tree", "subroots")}) s on s.i = r.i),
paths as (select doc_id, row_number() over (partition by doc_id order by k) as step, coalesce(before, '') as before, coalesce(after, '') as after from steps),
fold as (
  select doc_id, 0::bigint as step, coalesce(altered, h) as h from numbered
  union all
  select f.doc_id, p.step, sha256(p.before || f.h || p.after) from fold f join paths p on f.doc_id = p.doc_id and p.step = f.step + 1),
proofs as (select doc_id, sha256(string_agg(before || after, '' order by step)) as proof_sha256 from paths group by doc_id),
folded as (select doc_id, arg_max(h, step) as folded_root from fold group by doc_id)
select n.doc_id, n.h as leaf, r.h as subroot, root.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.folded_root, f.folded_root = root.h as verified
from numbered n join subroots r on n.g = r.code cross join root left join proofs p on n.doc_id = p.doc_id join folded f on n.doc_id = f.doc_id
"""

_TERMS = rf"""unnest(regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""

LEXICAL = f"""
with terms as (select doc_id, {_TERMS} as term from documents),
tf as (select doc_id, term, count(*) as tf from terms group by doc_id, term),
lengths as (select doc_id, count(*) as n from terms group by doc_id),
totals as (select count(*) as docs, sum(n)::bigint as len from lengths),
df as (select term, count(*) as df from tf group by term),
asked as (select distinct item_id, {_TERMS} as term from benchmark),
weights as (select term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from df cross join totals),
scores as (
  select a.item_id, tf.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * l.n * t.docs) // t.len)))))::bigint as score
  from asked a join tf on a.term = tf.term join weights w on a.term = w.term join lengths l on tf.doc_id = l.doc_id cross join totals t group by a.item_id, tf.doc_id)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
from scores where score > 0 qualify rank <= 10
"""

SQL: dict[str, str] = {"op11_lexical": LEXICAL, "op12_line_dedup": LINE_DEDUP, "op13_merkle": MERKLE}
