"""DuckDB SQL for the corpus operators that SQL can express, written plainly: every pair, every window, every running sum.

The page texts (2), the trained operators (3, 7), graph search (6), the surrogates (4) and the byte strings (9) have none; their tests are in tests/llm.
"""

from __future__ import annotations

from .common import LOWER, UPPER
from .decontaminate import WINDOW
from .minhash_dedup import SHINGLE

_LOW = f"translate(text, '{UPPER}', '{LOWER}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _ahead(n: int, over: str) -> str:
    """The word and the n - 1 next ones, null where there are fewer."""
    return " || ' ' || ".join(["w", *(f"lead(w, {k}) over {over}" for k in range(1, n))])


def _preferences() -> str:
    side = lambda which: f"""
        select pair_id, min(conv) as id, string_agg(shown, '' order by i) filter (i > n) as body,
            string_agg(begin_at || '-' || (begin_at + size + 7), ',' order by i) filter (i > n and role = 'assistant') as mask
        from (
            select *, coalesce(sum(length(head) + size + 8) filter (i > n) over (partition by pair_id order by i rows between unbounded preceding and 1 preceding), 0) + length(head) as begin_at
            from turns join prefix using (pair_id) where {which}
        ) group by pair_id"""  # noqa: E731
    return f"""
    with openings as (
        select conv_id, min({{'t': coalesce(turn, 9223372036854775807), 'r': coalesce(role, 'unknown'), 'x': coalesce(text, '')}}) as f from conversations where conv_id is not null group by conv_id
    ), halves as (
        select conv_id, f.r as r, f.x as x, (row_number() over (partition by f.r, f.x order by conv_id) - 1) // 2 as half from openings
    ), pairs as (
        select conv_id, min(conv_id) over (partition by r, x, half) as pair_id from halves
    ), raw as (
        select pair_id, coalesce(c.conv_id = pair_id, true) as side, c.conv_id as conv, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations c left join pairs p on p.conv_id = c.conv_id
    ), turns as (
        select *, '<|' || role || '|>' || chr(10) as head, length(text) as size, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown,
            row_number() over (partition by pair_id, side order by turn nulls last, role, text) as i
        from raw
    ), agree as (
        select pair_id, i, bool_and(x.role is not distinct from y.role and x.text is not distinct from y.text) as same
        from (select * from turns where side) x full join (select * from turns where not side) y using (pair_id, i) group by pair_id, i
    ), prefix as (
        select pair_id, coalesce(min(i) filter (not same) - 1, max(i)) as n from agree group by pair_id
    ), one as ({side("side")}), two as ({side("not side")}), opening as (
        select pair_id, string_agg(shown, '' order by i) as prompt from turns join prefix using (pair_id) where side and i <= n group by pair_id
    )
    select pair_id, one.id as chosen_id, two.id as rejected_id, n as n_prefix, coalesce(prompt, '') as prompt,
        case when one.id is not null then coalesce(one.body, '') end as chosen, case when one.id is not null then coalesce(one.mask, '') end as chosen_mask,
        case when two.id is not null then coalesce(two.body, '') end as rejected, case when two.id is not null then coalesce(two.mask, '') end as rejected_mask
    from prefix left join one using (pair_id) left join two using (pair_id) left join opening using (pair_id)"""


def _contamination() -> str:
    words = f"regexp_extract_all(coalesce({_LOW}, ''), '{_ALNUM}')"
    sizes = " union all ".join(f"select r, i, {n} as n, {_ahead(n, 'nxt')} as s from spread window nxt as (partition by r order by i)" for n in range(1, WINDOW + 1))
    return f"""
    with listed as (select row_number() over () as r, doc_id, {words} as ws from documents),
    spread as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from listed),
    items as (select coalesce(cast(item_id as varchar), 'null') as item, {words} as ws from benchmark),
    windows as (
        select distinct item, n, array_to_string(ws[i : i + n - 1], ' ') as s
        from (select *, unnest(range(1, len(ws) - n + 2)) as i from (select *, least(len(ws), {WINDOW}) as n from items where len(ws) > 0))
    ),
    found as (select r, i, n, item from ({sizes}) join windows using (n, s)),
    hit as (select r, count(distinct i + k) as n_hit from (select r, i, unnest(range(0, n)) as k from (select distinct r, i, n from found)) group by r),
    named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from found) group by r)
    select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
    from listed left join hit using (r) left join named using (r)"""


def _near_duplicates() -> str:
    return f"""
    with recursive listed as (select doc_id, regexp_extract_all(coalesce({_LOW}, ''), '{_SPACED}') as ws from documents),
    spread as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from listed where len(ws) >= {SHINGLE}),
    shingles as (
        select distinct doc_id, s from (select doc_id, {_ahead(SHINGLE, "nxt")} as s from spread window nxt as (partition by doc_id order by i)) where s is not null
        union all select doc_id, array_to_string(ws, ' ') from listed where len(ws) between 1 and {SHINGLE - 1}
    ),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    common as (select x.doc_id as a, y.doc_id as b, count(*) as c from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all),
    links as (select a, b from common join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * c >= 75 * (p.n + q.n - c)),
    reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
    lowest as (select a as doc_id, min(b) as low from reach group by a)
    select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, doc_id = least(doc_id, coalesce(low, doc_id)) as kept
    from listed left join sizes using (doc_id) left join lowest using (doc_id)"""


def _mix(rounds: int = 4) -> str:
    steps = ""
    for k in range(rounds):
        last = k == rounds - 1
        crossing = " or (upto - size < gap and upto - gap < gap - upto + size)" if last else ""
        steps += f""",
    goal{k} as (
        select s.source, chance, target - certain * source_size - coalesce(got, 0) as gap
        from goals s left join (select source, sum(size) as got from state{k} where extra group by source) g on s.source is not distinct from g.source where chance > 0
    ),
    order{k} as (
        select d.r, size, gap, sum(size) over (partition by d.source order by u / (1 - u) * (1 - chance) / chance, doc_id, digest, d.r) as upto
        from state{k} d join goal{k} g on d.source is not distinct from g.source where not extra and size > 0 and gap > 0 and size <= gap * {2 if last else 1}
    ),
    state{k + 1} as materialized (select * replace (extra or r in (select r from order{k} where upto <= gap{crossing}) as extra) from state{k})"""
    return f"""
    with base as (
        select row_number() over () as r, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_SPACED}')) as bigint) as size, coalesce(md5(text), '') as digest from documents
    ),
    state0 as materialized (
        select *, false as extra, (cast(cast('0x' || left(md5('mix:' || coalesce(cast(doc_id as varchar), 'null') || ':' || digest), 12) as bigint) as double) + 0.5) / 281474976710656.0 as u from base
    ),
    sums as (select source, sum(size)::double as source_size from base group by source),
    placed as (select *, ([3.0, 1.0, 2.0]::double[])[1 + (row_number() over (order by source nulls last) - 1) % 3] as weight, source_size * 2.0::double as most from sums),
    levels as (
        select (sum(source_size) * 1.5::double - coalesce(sum(most) filter (fixed), 0)) / sum(weight) filter (not fixed) as level, ratio from (
            select p.*, x.ratio, p.most / p.weight < x.ratio as fixed from placed p, (select distinct most / weight as ratio from placed) x
        ) group by ratio
    ),
    targets as (select source, source_size, least(most, weight * coalesce((select level from levels where level <= ratio order by ratio limit 1), 1e300)) as target from placed),
    goals as (
        select *, floor(share) as certain, share - floor(share) as chance from (select *, case when source_size > 0 then target / source_size else 0 end as share from targets)
    ){steps}
    select doc_id, size, d.source, cast(source_size as bigint) as source_size, target, cast((certain + extra::int) * size as bigint) as taken
    from state{rounds} d join goals g on d.source is not distinct from g.source"""


ORACLES = {"op1_chat_preferences": _preferences(), "op5_decontaminate": _contamination(), "op8_minhash_dedup": _near_duplicates(), "op10_pareto_mix": _mix()}
