"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from rowtide.llm.url_templates import RULES


def url_templates(fanout: int = 50, depth: int = 4, z: float = 1.64, least: int = 5, purity: float = 0.8, support: int = 5, smooth: float = 4.0, cover: float = 0.2) -> str:
    rules = ", ".join(f"('{verdict}', '{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}')" for verdict, rule in RULES)
    sql = f"""with rules(verdict, rule, rhost, rpath) as (values {rules}),
    cut as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as h from cut),
    split as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') as path from hosts),
    fits as (select page_id, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as ruled from split, rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by page_id),
    rows as (select split.*, rule, ruled, regexp_replace(regexp_replace(path, '[0-9a-fA-F]{{16,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') as form from split left join fits using (page_id)),
    t0 as (select host, form, count(*)::double as n, count(ruled)::double as l, count(*) filter (ruled = 'block')::double as b, string_split(regexp_replace(form, '^/', ''), '/') as parts, '' as template from rows group by host, form)"""
    for i in range(depth):
        part = f"parts[{i + 1}]" if i < depth - 1 else f"case when len(parts) >= {depth} then array_to_string(parts[{depth}:], '/') end"
        sql += f""",
    p{i} as (select *, {part} as part from t{i}),
    c{i} as (select host, template, part, sum(n) as n, sum(l) as l, sum(b) as b from p{i} where part is not null group by all),
    a{i} as (select host, template, sum(n) as an, sum(l) as al, sum(b) as ab from c{i} group by all),
    w{i} as (select host, template, part, coalesce(case when l = 0 then n * {fanout} < an when l >= {least} and al - l >= {least} and abs(b / l - (ab - b) / (al - l)) <= {z} * sqrt((ab / al) * (1 - (ab / al)) * (1 / l + 1 / (al - l))) then true else false end, false) as wild from c{i} join a{i} using (host, template)),
    t{i + 1} as (select host, form, p{i}.n, p{i}.l, p{i}.b, parts, case when part is null then template else template || '/' || case when wild then '*' else part end end as template from p{i} left join w{i} using (host, template, part))"""
    return f"""{sql},
    g as (select coalesce(sum(b) / nullif(sum(l), 0), 0) as g from t{depth}),
    priors as (select host, (sum(b) + {smooth} * max(g)) / (sum(l) + {smooth}) as prior from t{depth}, g group by host),
    own as (select host, template, sum(n) as n, sum(l) as l, sum(b) as b from t{depth} group by all),
    judged as (select host, template, l, l >= {support} and (b + {smooth} * prior) / (l + {smooth}) >= {purity} and l >= {cover} * n as rejected from own join priors using (host))
    select page_id, rows.host, path, rule, t.template, cast(judged.l as bigint) as labelled, coalesce(ruled, case when rejected then 'block' else 'allow' end) as verdict
    from rows join t{depth} t on t.host = rows.host and t.form = rows.form join judged on judged.host = rows.host and judged.template = t.template"""


def passages(size: int = 20) -> str:
    return rf"""with docs as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents),
    starts as (select doc_id, p, hash(array_to_string(words[p + 1:p + {size}], ' ')) as a, md5(array_to_string(words[p + 1:p + {size}], ' ')) as k from (select doc_id, words, unnest(range(0, greatest(0, len(words) - {size - 1}))) as p from docs)),
    repeated as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from starts) where r > 1),
    gone as (select distinct doc_id, p + i as p from repeated, range({size}) r(i)),
    marked as (select d.doc_id, d.p, d.w, g.p is not null as gone from (select doc_id, unnest(range(0, len(words))) as p, unnest(words) as w from docs) d left join gone g on g.doc_id = d.doc_id and g.p = d.p),
    kept as (select doc_id, count(*) filter (gone) as n_removed, string_agg(w, ' ' order by p) filter (not gone) as kept from marked group by doc_id)
    select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join kept using (doc_id)"""


def byte_strings(size: int = 50) -> str:
    return f"""with docs as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
    starts as (select doc_id, p, md5(substr(h, 2 * p + 1, {2 * size})) as k from (select doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - {size - 1}))) as p from docs)),
    firsts as (select k, min(doc_id) as f from starts group by k),
    repeated as (select doc_id, p from starts join firsts using (k) where f < doc_id),
    bytes as (select doc_id, unnest(range(0, len(h) // 2)) as p, unnest(regexp_extract_all(h, '..')) as x from docs),
    near as (select b.doc_id, b.p, x, max(r.p) over (partition by b.doc_id order by b.p rows unbounded preceding) as s from bytes b left join repeated r on r.doc_id = b.doc_id and r.p = b.p),
    marked as (select doc_id, p, x, coalesce(p - s < {size}, false) as gone from near),
    edged as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by p), false) as opens from marked),
    kept as (select doc_id, count(*) filter (gone) as n_removed, count(*) filter (opens) as n_spans, string_agg(x, '' order by p) filter (not gone) as kept from edged group by doc_id)
    select doc_id, cast(len(h) // 2 as bigint) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from docs left join kept using (doc_id)"""


ORACLES = {"op1_url_templates": url_templates(), "op6_passages": passages(), "op7_bwt_dedup": byte_strings()}
