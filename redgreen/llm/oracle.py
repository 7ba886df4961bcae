"""DuckDB SQL for the operators that SQL can express."""



def _centroid_rounds(k: int, rounds: int) -> str:
    """Lloyd's rounds, one common table expression after the other."""
    scaled = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double))"
    plain = "len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"
    square = "list_inner_product({0}, {0})"
    parts = [
        f"v as (select row_number() over () r, vec_id, {scaled} e from embeddings where len(embedding) = 64 and {plain})",
        f"c0 as (select cast(row_number() over (order by sha256('2:' || vec_id), e) - 1 as integer) cluster, e c from v "
        f"where vec_id is not null order by sha256('2:' || vec_id), e limit {k})",
    ]
    for i in range(rounds + 1):
        distance = f"{square.format('e')} + {square.format('c')} - 2 * list_inner_product(e, c)"
        parts.append(
            f"a{i} as materialized (select r, vec_id, e, min(struct_pack(d := cast({distance} as bigint), cluster := cluster)) m "
            f"from v, c{i} group by r, vec_id, e)"
        )
        if i < rounds:
            parts += [
                f"s{i} as (select m.cluster cluster, generate_subscripts(e, 1) p, unnest(e) x from a{i})",
                f"g{i} as (select cluster, p, floor(sum(x) / count(*)) x from s{i} group by all)",
                f"n{i} as (select cluster, list(x order by p) c from g{i} group by cluster)",
                f"c{i + 1} as materialized (select cluster, coalesce(n{i}.c, c{i}.c) c from c{i} left join n{i} using (cluster))",
            ]
    digest = "sha256(array_to_string(list_transform(c, lambda x: cast(cast(x as bigint) as varchar)), ','))"
    return (
        "with " + ", ".join(parts) + f" select vec_id, m.cluster as cluster, m.d as distance, cast(sum(m.d) over (partition by m.cluster) as bigint) cluster_inertia, "
        f"cast(sum(m.d) over () as bigint) inertia, {digest} centroid_sha256 from a{rounds} join c{rounds} on m.cluster = c{rounds}.cluster"
    )


ORACLE: dict[str, str] = {
    "op12_overlap": r"""
with recursive words as (select row_number() over () r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
sets as (select r, doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end s from words),
sizes as (select r, doc_id, len(s) n from sets),
items as (select r, unnest(s) x from sets where doc_id is not null),
common as (select a.r a, b.r b, count(*) c from items a join items b on a.x = b.x and a.r < b.r group by all),
links as (select a, b from common join sizes p on a = p.r join sizes q on b = q.r where 100 * c >= 80 * (p.n + q.n - c)),
edges as (select a u, b v from links union all select b, a from links),
reach as (select r u, r v from words union select x.u, e.v from reach x join edges e on x.v = e.u)
select d.doc_id, d.n n_shingles, min(o.doc_id) component_id
from sizes d join reach on d.r = u join sizes o on o.r = v group by d.r, d.doc_id, d.n
""",
    "op13_lexical": r"""
with tokens as (select row_number() over () r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
tf as (select r, doc_id, t, count(*) tf from tokens group by all),
sizes as (select r, sum(tf)::bigint n from tf group by r),
facts as (select count(*) n_docs, sum(n)::bigint n_terms from sizes),
df as (select t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)::double))::bigint w from tf, facts group by t, n_docs),
damp as (select r, 10 + (90 * n * n_docs) // n_terms m from sizes, facts),
items as (select row_number() over () q, item_id, text from benchmark),
asked as (select distinct q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from items),
scores as (select q, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
        from asked join tf using (t) join df using (t) join damp using (r) group by all),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) place from scores where score > 0)
select item_id, place::integer "rank", doc_id, score from ranked where place <= 10
""",
    "op11_centroids": _centroid_rounds(40, 5),
    "op1_topk": """
with raw as (select vec_id, embedding from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as double)) e from raw),
pairs as (select q.vec_id query_id, c.vec_id vec_id, cast(list_inner_product(q.e, c.e) as bigint) score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) r from pairs)
select query_id, cast(r as integer) as rank, vec_id, score from ranked where r <= 20
""",
    "op4_minhash": r"""
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
        else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from words),
sizes as (select doc_id, len(s) n from sets),
items as (select doc_id, unnest(s) x from sets),
common as (select a.doc_id a, b.doc_id b, count(*) c from items a join items b on a.x = b.x and a.doc_id < b.doc_id group by all),
links as (select a, b from common join sizes p on a = p.doc_id join sizes q on b = q.doc_id where 100 * c >= 80 * (p.n + q.n - c)),
edges as (select a u, b v from links union all select b, a from links),
reach as (select doc_id u, doc_id v from documents union select r.u, e.v from reach r join edges e on r.v = e.u)
select d.doc_id, n n_shingles, min(v) component_id, d.doc_id = min(v) kept
from sizes d join reach on d.doc_id = u group by d.doc_id, n
""",
    "op5_mixing": r"""
with docs as (select doc_id, coalesce(lang, '') lang, coalesce(source, '') source,
        coalesce('d' || cast(try_cast(regexp_extract(coalesce(source, ''), '(\d+)$', 1) as int) % 3 as varchar), '') "domain",
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) n from documents),
leaves as (select "domain", lang, source, sum(n) tokens, sum(n) * 2 capacity from docs group by all),
total as (select cast(floor(sum(tokens) * cast(0.6 as double)) as double) budget from leaves),
d0 as (select "domain", cast(sum(capacity) as double) cap, budget,
        cast(case "domain" when 'd0' then 5 when 'd1' then 3 when 'd2' then 2 else 1 end as double) w from leaves, total group by all),
d1 as (select *, coalesce(sum(cap) over (order by cap / w, "domain" rows between unbounded preceding and 1 preceding), 0) before,
        sum(w) over (order by cap / w, "domain" rows between current row and unbounded following) ws from d0),
d2 as (select *, cap * ws <= (budget - before) * w as full_ from d1),
d3 as (select "domain", case when full_ then cap else w * max(case when not full_ then (budget - before) / ws end) over () end budget from d2),
l0 as (select "domain", lang, cast(sum(capacity) as double) cap, budget,
        cast(case lang when 'en' then 4 when 'de' then 3 when 'fr' then 2 else 1 end as double) w from leaves join d3 using ("domain") group by all),
l1 as (select *, coalesce(sum(cap) over (partition by "domain" order by cap / w, lang rows between unbounded preceding and 1 preceding), 0) before,
        sum(w) over (partition by "domain" order by cap / w, lang rows between current row and unbounded following) ws from l0),
l2 as (select *, cap * ws <= (budget - before) * w as full_ from l1),
l3 as (select "domain", lang, case when full_ then cap else w * max(case when not full_ then (budget - before) / ws end) over (partition by "domain") end budget from l2),
s0 as (select "domain", lang, source, tokens, cast(capacity as double) cap, budget,
        cast(case source when 'src0' then 2 else 1 end as double) w from leaves join l3 using ("domain", lang)),
s1 as (select *, coalesce(sum(cap) over (partition by "domain", lang order by cap / w, source rows between unbounded preceding and 1 preceding), 0) before,
        sum(w) over (partition by "domain", lang order by cap / w, source rows between current row and unbounded following) ws from s0),
s2 as (select *, cap * ws <= (budget - before) * w as full_ from s1),
s3 as (select "domain", lang, source, tokens, cast(floor(case when full_ then cap
        else w * max(case when not full_ then (budget - before) / ws end) over (partition by "domain", lang) end) as bigint) budget from s2 where tokens > 0),
spend as (select "domain", lang, source, budget, cast(budget // tokens as bigint) whole, cast(budget % tokens as bigint) rest from s3),
lined as (select docs.*, budget, whole, rest, sum(n) over (partition by "domain", lang, source
        order by md5('17:' || whole || ':' || coalesce(cast(doc_id as varchar), '')), doc_id, n rows unbounded preceding) upto
        from docs join spend using ("domain", lang, source)),
taken as (select *, whole + case when upto <= rest then 1 else 0 end times from lined)
select doc_id, "domain", lang, source, cast(unnest(range(0, times)) as bigint) epoch, n n_tokens, budget leaf_budget from taken
""",
}
