"""DuckDB statements for the queries of the catalogue, put together from common table expressions."""

from __future__ import annotations

from .functions.quantize import CATEGORIES, FIELDS, PRIVATE_USE, Grid
from .operators.analysis import SPECIALS
from .operators.doubling import SENTINELS
from .plans.sweep import FACTORS

K = 8


def statement(*ctes: str, final: str) -> str:
    return "with " + ",\n".join(ctes) + "\n" + final


def raw(source: str = "events") -> str:
    if source == "lineitem":
        return """raw as (
  select l_suppkey as file_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as ord,
    since / 86.4e9 as start_sec, since / 86.4e9 + l_quantity / 10::double as end_sec, l_partkey % 128 as pitch, l_linenumber::bigint as program,
    l_returnflag = 'R' as is_drum, 1 + floor(l_extendedprice)::bigint % 127 as velocity
  from (select *, epoch_us(l_shipdate) - min(epoch_us(l_shipdate)) over (partition by l_suppkey) as since from lineitem))"""
    return """raw as (
  select user_id as file_id, event_id as ord, since / 3.6e9 as start_sec, since / 3.6e9 + value / 50::double as end_sec, event_id % 128 as pitch,
    case event_type when 'click' then 0 when 'purchase' then 24 when 'signup' then 40 when 'view' then 56 else 0 end::bigint as program,
    event_type not in ('click', 'purchase', 'signup', 'view') as is_drum, 1 + regexp_extract(props, '(\\d+)', 1)::bigint % 127 as velocity
  from (select *, epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id) as since from events))"""


def even(x: str) -> str:
    return f"round_even(({x})::double, 0)::bigint"


def quantized(g: Grid, name: str = "q") -> str:
    v = even(f"velocity * {g.vel_bins - 1} / 127::double") if g.vel_bins < 128 else "velocity::bigint"
    return f"""{name} as (
  select file_id, ord, {even(f"start_sec * {g.onset_scale!r}::double")} as t,
    greatest(1, least({even(f"(end_sec - start_sec) * {g.dur_scale!r}::double")}, {g.max_duration}))::bigint as d,
    pitch::bigint as p, (case when is_drum then 128 else program end)::bigint as i, {v} as v from raw)"""


def chunked(g: Grid, name: str = "notes", of: str = "q") -> str:
    return f"""{name} as (
  select file_id, dense_rank() over (partition by file_id order by rc) - 1 as chunk_idx, row_number() over (partition by file_id, rc order by t, p, i, ord) - 1 as pos,
    ord, t - min(t) over (partition by file_id, rc) as t, d, p, i, v from (select *, t // {g.chunk_steps} as rc from {of}))"""


def notes(g: Grid = Grid(), source: str = "events") -> list[str]:  # noqa: B008
    return [raw(source), quantized(g), chunked(g)]


def vocabulary(of: str = "notes", name: str = "vocab", by: str = "") -> str:
    each = " union ".join(f"select {by}'<{c}-' || {f} || '>' as token, '{c}' as category from {of}" for c, f in zip(CATEGORIES, FIELDS, strict=True))
    part = f"partition by {by.rstrip(', ')} " if by else ""
    return f"{name} as materialized (select *, row_number() over ({part}order by token) - 1 as idx from ({each}))"


def indexed(of: str = "notes", vocab: str = "vocab", by: str = "", name: str = "ix") -> str:
    cols = ", ".join(f"v_{f}.idx as {f}_idx" for f in FIELDS)
    same = f" and v_{{f}}.{by.rstrip(', ')} = n.{by.rstrip(', ')}" if by else ""
    joins = " ".join(f"left join {vocab} v_{f} on v_{f}.token = '<{c}-' || n.{f} || '>'" + same.format(f=f) for c, f in zip(CATEGORIES, FIELDS, strict=True))
    return f"{name} as (select n.*, {cols} from {of} n {joins})"


def sym(f: str) -> str:
    return f"'[' || lpad({f}_idx::varchar, 6, '0') || ']'"


COMPOUND = " || ".join(sym(f) for f in FIELDS)
BODY = " || ".join(sym(f) for f in FIELDS[1:])


def words(of: str = "ix", standalone: bool = False, by: str = "'all' as grp, ", name: str = "each") -> str:
    if not standalone:
        return f"{name} as (select {by}file_id, chunk_idx, pos, 0 as part, {COMPOUND} as word from {of})"
    return f"{name} as (select {by}file_id, chunk_idx, pos, 0 as part, {sym('t')} as word from {of} union all select {by}file_id, chunk_idx, pos, 1 as part, {BODY} as word from {of})"


COUNTED = "words as materialized (select grp, word, count(*) as n from each group by grp, word)"


def text_words(source: str, column: str = "text") -> list[str]:
    return [
        f"plain as (select word, count(*) as n from (select unnest(regexp_split_to_array({column}, '[ \\n\\r\\t]+')) as word from {source}) where word <> '' group by word)",
        "words as materialized (select 'all' as grp, array_to_string([ '[' || lpad(unicode(c)::varchar, 6, '0') || ']' for c in string_split(word, '')], '') as word, n from plain)",
    ]


def pairs_of(w: str) -> str:
    return f"select grp, l, r, sum(n)::bigint as c from (select grp, n, s[j] as l, s[j + 1] as r from (select grp, n, s, unnest(range(1, len(s))) as j from (select grp, n, string_split(sym[2:-2], '][') as s from {w}))) group by grp, l, r"


def training(k: int = K) -> list[str]:
    out = ["w0 as (select grp, word, n, word as sym from words)"]
    for m in range(k):
        out.append(f"top{m} as materialized (select grp, l, r from ({pairs_of(f'w{m}')}) qualify row_number() over (partition by grp order by c desc, l, r) = 1)")
        out.append(f"w{m + 1} as materialized (select w.grp, word, n, case when l is null then sym else replace(sym, '[' || l || '][' || r || ']', '[M{m:05d}]') end as sym from w{m} w left join top{m} using (grp))")
    return out


def merges(k: int = K) -> str:
    return " union all ".join(f"select {m} as rank, l, r, 'M{m:05d}' as made from top{m}" for m in range(k))


def tokens_in(sym: str) -> str:
    return f"(len({sym}) - len(replace({sym}, '[', '')))"


def ladder(sizes: list[int]) -> str:
    each = " union all ".join(f"select grp, {k}::bigint as merges, n, {tokens_in('word')} as o, {tokens_in('sym')} as b from w{k}" for k in sizes)
    return f"""select grp, merges, sum(n)::bigint as n_words, sum(n * o)::bigint as original_tokens, sum(n * b)::bigint as bpe_tokens,
  sum(n * b)::bigint / sum(n * o)::bigint::double as reduction_ratio, sum(n * o)::bigint / sum(n * b)::bigint::double as compression_factor from ({each}) group by grp, merges"""


def expansions(k: int = K, x: str = "") -> list[str]:
    """toks(sym, size, original_tokens, categories), of base tokens and merges; x goes behind the names."""
    out = [f"e{x}0 as (select lpad(idx::varchar, 6, '0') as sym, [token] as toks, [category] as cats from vocab)"]
    for m in range(k):
        out.append(f"e{x}{m + 1} as materialized (select * from e{x}{m} union all select 'M{m:05d}', list_concat(a.toks, b.toks), list_concat(a.cats, b.cats) from top{m} join e{x}{m} a on a.sym = l join e{x}{m} b on b.sym = r)")
    out.append(f"toks{x} as (select sym, len(toks) as size, array_to_string(toks, ' ') as original_tokens, array_to_string(list_sort(cats), '+') as categories, array_to_string(toks, '+') as joined from e{x}{k})")
    out.append(f"freq{x} as (select s as sym, sum(n)::bigint as n from (select n, unnest(string_split(sym[2:-2], '][')) as s from w{k}) group by s)")
    out.append(f"tf{x} as (select t.*, coalesce(n, 0)::bigint as n from toks{x} t left join freq{x} using (sym))")
    return out


def trained_notes(k: int = K, standalone: bool = False) -> list[str]:
    return [*notes(), vocabulary(), indexed(), words(standalone=standalone), COUNTED, *training(k)]


def component(k: int, of: str = "tf") -> str:
    return f"""select {k}::bigint as merges, size, categories, vocab_count, round_even(vocab_count / sum(vocab_count) over (partition by size), 4) as vocab_proportion, corpus_count,
  row_number() over (partition by size order by corpus_count desc, categories) as top
  from (select size, categories, count(*) as vocab_count, sum(n)::bigint as corpus_count from {of} where size > 1 group by size, categories)"""


def draw(below: int, *keys: str, salt: int = 0) -> str:
    h = f"{salt * 7919 + 12345}::bigint"
    for k in keys:
        h = f"((({h}) * 31337 + ({k})::bigint * 104729) % 1000003)"
    return f"((({h}) * 48271 % 2147483647) % {below})"


def controls(test: str) -> str:
    return f"nc as materialized (select *, {test} as is_control from notes)"


RANDOM_CONTROL = f"{draw(10_000, 'file_id', 'ord')} < 3000"


def padded(g: Grid = Grid()) -> list[str]:  # noqa: B008
    r = g.rest_steps
    return [
        "ends as (select file_id, chunk_idx, max(t) as end_t, min(t) filter (where not is_control) as first_t from nc group by all)",
        """base as (
  select e.file_id, e.chunk_idx, t as time, pos, 'EVENT' as kind, t, d, p, i, v, coalesce(lead(t) over (partition by e.file_id, e.chunk_idx order by pos), end_t) as until
  from nc e join ends using (file_id, chunk_idx) where not is_control
  union all select file_id, chunk_idx, 0, -1, 'START', null, null, null, null, null, coalesce(first_t, end_t) from ends)""",
        f"""padded as materialized (
  select file_id, chunk_idx, time + rest_no * {r} as time, pos, rest_no, case when rest_no > 0 then 'REST' else kind end as kind,
    case when rest_no = 0 then t end as t, case when rest_no = 0 then d end as d, case when rest_no = 0 then p end as p, case when rest_no = 0 then i end as i, case when rest_no = 0 then v end as v
  from (select *, unnest(range(0, greatest(0, (until - time - 1) // {r}) + 1)) as rest_no from base) where rest_no > 0 or kind <> 'START')""",
    ]


def sequence(g: Grid = Grid()) -> list[str]:  # noqa: B008
    """By counting instead of a window: a control goes before the first slot whose key reaches its own."""
    return [
        *padded(g),
        "slots as materialized (select *, row_number() over w as slot, coalesce(lag(time) over w, 0) as key from padded window w as (partition by file_id, chunk_idx order by pos, rest_no))",
        f"""placed as (
  select file_id, chunk_idx, slot as at_, 1 as later, 0 as ordinal, kind, t, d, p, i, v from slots
  union all
  select c.file_id, c.chunk_idx, coalesce((select min(slot) from slots s where s.file_id = c.file_id and s.chunk_idx = c.chunk_idx and s.key >= c.t - {g.lead_steps}), 4611686018427387904), 0, c.pos, 'CONTROL', c.t, c.d, c.p, c.i, c.v
  from nc c where is_control
  union all select distinct file_id, chunk_idx, 0, 1, 0, 'SEPARATOR', null::bigint, null::bigint, null::bigint, null::bigint, null::bigint from nc)""",
        "seq as materialized (select file_id, chunk_idx, row_number() over (partition by file_id, chunk_idx order by at_, later, ordinal) - 1 as seq, kind, t, d, p, i, v from placed)",
    ]


def sequence_ids() -> str:
    tok = ", ".join(f"'<{c}-' || {f} || '>'" for c, f in zip(CATEGORIES, FIELDS, strict=True))
    return f"""sid as materialized (
  select file_id, chunk_idx, seq, j, kind = 'CONTROL' as is_control, coalesce((idx + case when kind = 'CONTROL' then (select count(*) from vocab) else 0 end)::varchar, token) as id
  from (select *, toks[j] as token from (select *, unnest(range(1, len(toks) + 1)) as j from (select *, case when kind in ('EVENT', 'CONTROL') then [{tok}] else ['[' || kind || ']'] end as toks from seq)))
  left join vocab using (token))"""


def doubled(k: int = K) -> str:
    s = len(SPECIALS)
    fixed = ", ".join(f"({i}, '{t}', 'special')" for i, t in enumerate(SPECIALS))
    ends = " union all ".join(f"select {s} + 2 * (b + m) + {i}, '{t}', 'sentinel' from size" for i, t in enumerate(SENTINELS))
    return f"""select id::bigint as id, token, kind from (
  select * from (values {fixed}) x(id, token, kind)
  union all select {s} + idx, token, 'base' from vocab
  union all select {s} + b + k, joined, 'merged' from mt, size
  union all select {s} + b + m + idx, 'ctrl:' || token, 'ctrl_base' from vocab, size
  union all select {s} + b + m + b + k, 'ctrl:' || joined, 'ctrl_merged' from mt, size
  union all {ends})"""


def coarse(field: str, fine: float, to: float, x: str | None = None) -> str:
    x = x or field
    if field == "v":
        return even(f"{x} * {float(to - 1)!r}::double / {float(fine - 1)!r}::double")
    return f"greatest({0 if field == 't' else 1}, {even(f'{x} * {float(fine)!r}::double / {float(to)!r}::double')})"


def sweep(k: int, standalone: bool = False) -> list[str]:
    from .operators.corpus import fine_grid

    ctes, parts = [raw()], []
    for factor, (field, values) in FACTORS.items():
        g = fine_grid(field, values[0])
        ctes += [quantized(g, f"q_{factor}"), chunked(g, f"n_{factor}", f"q_{factor}")]
        for v in values:
            cols = ", ".join((field if v == values[0] else coarse(field, values[0], v)) + f" as {field}" if f == field else f for f in FIELDS)
            parts.append(f"select '{factor}|{v:03d}' as grp, file_id, chunk_idx, pos, {cols} from n_{factor}")
    ctes.append("allnotes as materialized (" + " union all ".join(parts) + ")")
    ctes += [vocabulary("allnotes", by="grp, "), indexed("allnotes", by="grp, "), words(standalone=standalone, by="grp, "), COUNTED, *training(k)]
    ctes.append(f"sweep as materialized (select split_part(grp, '|', 1) as factor, split_part(grp, '|', 2)::bigint as sweep_value, merges, original_tokens, bpe_tokens, reduction_ratio, compression_factor from ({ladder([k])}))")
    return ctes


def private(idx: str) -> str:
    (a0, a1), (b0, b1), (c0, _) = PRIVATE_USE
    n1, n2 = a1 - a0 + 1, b1 - b0 + 1
    return f"chr((case when {idx} < {n1} then {idx} + {a0} when {idx} < {n1 + n2} then {idx} - {n1} + {b0} else {idx} - {n1 + n2} + {c0} end)::int)"


def spans(test: str = "true", keys: tuple[str, ...] = ("file_id", "chunk_idx"), salt: int = 13, of: str = "notes", g: Grid = Grid()) -> list[str]:  # noqa: B008
    """own_spans(keys, a, b): a walk over each chunk's notes, one place a round. The statement has to be a recursive one."""
    k = ", ".join(keys)
    u = f"({draw(1_000_000, *(f'n.{x}' for x in keys), 'n.pos', salt=salt)} + 0.5) / 1e6"
    gap = f"floor(-ln({u}) / 0.05)::bigint"
    mine = " and ".join(f"n.{x} = m.{x}" for x in keys)
    return [
        f"""walk as (
  select distinct {k}, -1::bigint as pos, true as inside, 0::bigint as end_t, 0::bigint as nxt, false as opens, 0::bigint as t from {of} where {test}
  union all
  select {", ".join(f"z.{x}" for x in keys)}, z.pos, opens or (inside and not closes), case when opens then z.t + {g.lead_steps} else end_t end, nxt, opens, z.t
  from (select *, (not inside or closes) and t >= nxt as opens from (
    select {", ".join(f"n.{x}" for x in keys)}, n.pos, n.t, m.inside, m.end_t, m.inside and n.t >= m.end_t as closes, case when m.inside and n.t >= m.end_t then n.t + {gap} else m.nxt end as nxt
    from walk m join {of} n on {mine} and n.pos = m.pos + 1)) z)""",
        f"own_spans as (select {k}, t as a, end_t as b from walk where opens)",
    ]


def schedule(passes: int, keys: tuple[str, ...], of: str = "notes") -> list[str]:
    """chosen(keys, k, mode, rate, subset)."""
    k = ", ".join(keys)
    h = lambda below, *more, salt: draw(below, *keys, "k", *more, salt=salt)
    return [
        f"groups as (select {k}, list_sort(list(distinct i)) as insts from {of} group by {k})",
        f"each_pass as (select *, case when len(insts) > 1 then 1 + {h(1_000_000, salt=2)} % (len(insts) - 1) end as c from (select *, unnest(range(0, {passes})) as k from groups))",
        f"drawn as (select {k}, k, i, c, row_number() over (partition by {k}, k order by {h(1_000_000, 'i', salt=3)}, i) as at_ from (select *, unnest(insts) as i from each_pass))",
        f"subsets as (select {k}, k, string_agg(i::varchar, ',' order by i) as subset from drawn where at_ <= c group by {k}, k)",
        "modes as (select *, case when k % 10 = 0 then 'none' when k % 10 = 1 then 'span' when k % 10 < 6 then 'random' when len(insts) > 1 then 'instrument' else 'none' end as mode from each_pass)",
        f"chosen as (select {k}, k, mode, case when mode = 'random' then 1 + {h(9, salt=1)} end as rate, case when mode = 'instrument' then subset end as subset from modes left join subsets using ({k}, k))",
    ]
