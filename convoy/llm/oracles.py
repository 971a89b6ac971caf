"""DuckDB equivalents of the queries that SQL can express over whole tables."""

OP8 = r"""
with n as (
    select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id,
    min(doc_id) over same as keep_id,
    count(*) over same as group_size,
    doc_id = min(doc_id) over same as kept,
    sha256(t) as text_sha256
from n
window same as (partition by t)
"""

OP10 = r"""
with recursive sized as (
    select doc_id, source, md5('mix:' || doc_id) as draw,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
    from documents
),
sources as (
    select source, sum(size)::bigint as source_size,
        [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as weight
    from sized group by source
),
-- Rounds of clamping: a source whose share by weight is above its cap leaves with its cap.
rounds as (
    select 0 as round, source, source_size, weight, false as capped,
        1.5::double * sum(source_size) over () as open_words, sum(weight) over () as open_weight
    from sources
    union all
    select round + 1, source, source_size, weight, now_capped,
        1.5::double * sum(source_size) over ()
            - coalesce(sum(2.0::double * source_size) filter (where now_capped) over (), 0),
        sum(weight) filter (where not now_capped) over ()
    from (
        select *, capped or weight * open_words / open_weight >= 2.0::double * source_size as now_capped
        from rounds
    )
    where round < (select count(*) from sources)
),
targets as (
    select source, source_size,
        case when capped then 2.0::double * source_size else weight * open_words / open_weight end as target
    from rounds where round = (select count(*) from sources)
),
drawn as (
    select s.doc_id, s.source, s.size, t.source_size, t.target,
        case when t.source_size = 0 then 0 else floor(t.target / t.source_size) end::bigint as whole,
        sum(s.size) over (partition by s.source order by s.draw, s.size) - s.size as before
    from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, source, size, source_size, target,
    whole + (before + size / 2 <= target - whole * source_size)::bigint as repeats, repeats * size as taken
from drawn
"""

OP12 = r"""
with d as (
    select row_number() over () as row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from documents
),
b as (
    select item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
    from benchmark
),
windows as (
    select distinct item_id, array_to_string(w[i:least(i + 9, len(w))], ' ') as t, least(len(w), 10) as n
    from (select *, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)
),
places as (
    select row, i, n, array_to_string(w[i:i + n - 1], ' ') as t
    from (select *, unnest(generate_series(1, len(w) - n + 1)) as i from d, (select distinct n from windows) where len(w) >= n)
),
found as (select p.row, p.i, p.n, q.item_id from places p join windows q on p.t = q.t and p.n = q.n),
words as (
    select row, count(distinct place) as n_hit
    from (select row, unnest(generate_series(i, i + n - 1)) as place from (select distinct row, i, n from found))
    group by row
),
items as (
    select row, count(*) as n_items, string_agg(id, ',' order by id) as ids
    from (select distinct row, item_id, item_id::varchar as id from found) group by row
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (row) left join items using (row)
"""

OP13 = r"""
with recursive turns as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as seq
    from conversations where conv_id is not null
),
-- CRC-32 of the decimal id, bit by bit.
crc as (
    select conv_id, list_reduce(
        list_prepend(4294967295::bigint, list_transform(generate_series(1, len(conv_id::varchar)),
            lambda i: ord(substr(conv_id::varchar, i::int, 1))::bigint)),
        lambda c, x: list_reduce(
            [xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
            lambda v, z: xor(v >> 1, (v & 1) * 3988292384::bigint))) as c
    from (select distinct conv_id from turns)
),
heads as (select conv_id, conv_id - conv_id % 100 as base, xor(c, 4294967295::bigint) % 6 as h from crc),
rebuilt as (
    select h.conv_id, t.seq as place, t.role, t.text from heads h join turns t on t.conv_id = h.base and t.seq < h.h
    union all
    select h.conv_id, t.seq + 10, t.role, t.text from heads h join turns t on t.conv_id = h.conv_id and t.seq >= h.h
),
prefixes as (
    select conv_id, length(text) as chars, row_number() over w as depth,
        sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') over w) as node
    from rebuilt window w as (partition by conv_id order by place)
    union all
    select conv_id, 0, 0, '' from heads
),
lengths as (select conv_id, max(depth) as n from prefixes group by conv_id),
nodes as (
    select node, depth, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = n), '')) as ends_sha256
    from prefixes join lengths using (conv_id) group by node, depth
),
links as (
    select distinct a.node, b.node as parent
    from prefixes a join prefixes b on a.conv_id = b.conv_id and a.depth = b.depth + 1
),
below as (
    select distinct a.node as top, b.node
    from prefixes a join prefixes b on a.conv_id = b.conv_id and a.depth <= b.depth
),
children as (select parent as node, count(*) as n_children from links group by parent),
sums as (
    select top as node, count_if(n_children is null) as n_leaves, sum((n_convs - 1) * chars)::bigint as saved_tokens
    from below join nodes using (node) left join children using (node) group by top
)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) as n_children,
    n_leaves, saved_tokens, n.ends_sha256
from nodes n join sums using (node) left join children using (node) left join links using (node)
left join nodes p on p.node = links.parent
"""

ORACLES = {
    "op8_exact_dedup": OP8,
    "op10_mixing": OP10,
    "op12_decontaminate": OP12,
    "op13_prefix_trie": OP13,
}
