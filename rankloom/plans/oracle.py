"""The same rows as the queries' in DuckDB's SQL, each on its own over the raw tables."""

from __future__ import annotations

import math

#: Common table expressions by name, each built on those before it.
PARTS: dict[str, str] = {
    "ratings": """
      select o_custkey as user_id, l_partkey as item_id, cast(least(5, 1 + floor((l_quantity - 1) / 10)) as int) as rating, o_orderdate as ts, l_orderkey, l_linenumber
      from orders join lineitem on o_orderkey = l_orderkey
      where o_orderdate >= timestamp '1995-01-01' + to_days(cast(l_partkey % 100 * 24 as int))""",
    "cuts": "select timestamp '2000-07-01' as v, timestamp '2001-01-01' as t",
    "cohort_valid": """
      select user_id, v as query_time, count(*) filter (ts < v) as n_prior, count(*) filter (ts >= v and ts < t and rating >= 4) as n_pos
      from ratings, cuts group by user_id, v having n_prior >= 3 and n_pos >= 1""",
    "cohort_test": """
      select user_id, t as query_time, count(*) filter (ts < t) as n_prior, count(*) filter (ts >= t and rating >= 4) as n_pos
      from ratings, cuts group by user_id, t having n_prior >= 3 and n_pos >= 1""",
    "positives_valid": "select distinct user_id, item_id from ratings, cuts where ts >= v and ts < t and rating >= 4",
    "positives_test": "select distinct user_id, item_id from ratings, cuts where ts >= t and rating >= 4",
    "first_seen": "select item_id, min(ts) as first_seen from ratings group by item_id",
}
for _s in ("valid", "test"):
    PARTS |= {
        f"hist_{_s}": f"select r.*, query_time from ratings r join cohort_{_s} using (user_id) where ts < query_time",
        f"seen_{_s}": f"select distinct user_id, item_id from hist_{_s}",
        f"pop_{_s}": f"""
          select query_time, item_id, count(*) as score from ratings, (select distinct query_time from cohort_{_s}) q
          where ts < query_time and ts >= query_time - interval 90 day group by query_time, item_id""",
        f"elig_{_s}": f"""
          select c.user_id, c.query_time, f.item_id from cohort_{_s} c join first_seen f on f.first_seen < c.query_time
          anti join seen_{_s} s on s.user_id = c.user_id and s.item_id = f.item_id""",
        f"poppool200_{_s}": f"""
          select user_id, query_time, row_number() over (partition by user_id order by coalesce(score, 0) desc, item_id) - 1 as rank, item_id, coalesce(score, 0)::double as l1_score
          from elig_{_s} left join pop_{_s} using (query_time, item_id) qualify rank < 200""",
        f"poppool_{_s}": f"select * from poppool200_{_s} where rank < 100",
        f"pairs_{_s}": f"select distinct query_time, user_id, item_id from ratings, (select distinct query_time from cohort_{_s}) q where ts < query_time",
        f"deg_{_s}": f"select query_time, item_id, sqrt(count(*)) + 1e-9 as root from pairs_{_s} group by query_time, item_id",
        f"sim_{_s}": f"""
          select query_time, i, j, n / a.root / b.root as sim from (
            select x.query_time, x.item_id as i, y.item_id as j, count(*) as n from pairs_{_s} x join pairs_{_s} y on x.query_time = y.query_time and x.user_id = y.user_id and x.item_id <> y.item_id group by 1, 2, 3) c
          join deg_{_s} a using (query_time) join deg_{_s} b using (query_time) where a.item_id = i and b.item_id = j""",
        f"liked_{_s}": f"""
          select *, max(rating) over (partition by user_id) < 4 as fallback from hist_{_s} qualify rating >= 4 or max(rating) over (partition by user_id) < 4""",
        f"cooc_{_s}": f"""
          select user_id, j as item_id, round(sum(w * sim), 9) as score from (
            select user_id, query_time, item_id, sum(pow(0.5, date_diff('microsecond', ts, query_time) / 86400e6 / 180)) as w from liked_{_s} group by all) l
          join sim_{_s} s on s.query_time = l.query_time and s.i = l.item_id group by user_id, j having score > 0""",
        f"coocpool_{_s}": f"""
          select user_id, query_time, row_number() over (partition by user_id order by score desc, item_id) - 1 as rank, item_id, score as l1_score
          from cooc_{_s} join elig_{_s} using (user_id, item_id) qualify rank < 100""",
    }
PARTS |= {
    "vecs": "select vec_id, embedding::double[] as v, label from embeddings",
    "item_vecs": "select p_partkey as item_id, v from part, (select count(*) as n from embeddings) join vecs on vec_id = p_partkey % n",
    "half_lives": "select unnest([30.0, 90.0, 180.0, 365.0]::double[]) as half_life",
}
for _s in ("valid", "test"):
    PARTS |= {
        f"uvec_{_s}": f"""
          select half_life, user_id, query_time, fallback, dim, sum(w * x) / sum(w) as x from (
            select half_life, user_id, query_time, fallback, pow(0.5, date_diff('microsecond', ts, query_time) / 86400e6 / half_life) as w, unnest(v) as x, generate_subscripts(v, 1) - 1 as dim
            from liked_{_s} join item_vecs using (item_id), half_lives) u group by all""",
        f"unorm_{_s}": f"""
          select half_life, user_id, query_time, fallback, list(x / greatest(n, 1e-12) order by dim) as v from (
            select *, sqrt(sum(x * x) over (partition by half_life, user_id)) as n from uvec_{_s}) u group by all""",
        f"dense_{_s}": f"""
          select half_life, user_id, u.query_time, row_number() over (partition by half_life, user_id order by round(list_dot_product(u.v, i.v), 9) desc, item_id) - 1 as rank, item_id, round(list_dot_product(u.v, i.v), 9) as l1_score
          from unorm_{_s} u join elig_{_s} using (user_id) join item_vecs i using (item_id) qualify rank < 100""",
    }
_DRAW = "('0x' || substr(md5({}), 1, 8))::bigint"


def draw(*parts: str) -> str:
    return _DRAW.format(" || ':' || ".join(f"({p})::varchar" for p in parts))


def merge_parts(name: str, split: str, channels: tuple[str, ...], m: int = 100) -> dict[str, str]:
    """The merge of channels' lists, turn by turn: a fold over m turns of each channel."""
    pool = {"dense": f"select user_id, query_time, rank, item_id from dense_{split} where half_life = 180", "pop": f"select user_id, query_time, rank, item_id from poppool_{split}", "cooc": f"select user_id, query_time, rank, item_id from coocpool_{split}"}
    k = len(channels)
    every = " union all ".join(f"select {c} as c, * from ({pool[n]}) p{c}" for c, n in enumerate(channels))
    lists = ", ".join(f"coalesce(list(item_id order by rank) filter (c = {c}), []) as l{c}" for c in range(k))
    pick = "case x.t % " + str(k) + " " + " ".join(f"when {c} then l{c}" for c in range(k)) + " end"
    source = "case unnest(s.src) " + " ".join(f"when {c} then '{n}'" for c, n in enumerate(channels)) + " end"
    empty = "{'out': []::bigint[], 'src': []::int[], 't': %s}"
    return {
        f"{name}_lists": f"select user_id, query_time, {lists} from ({every}) e group by all",
        f"{name}_folded": f"""
          select user_id, query_time, list_reduce(list_transform(range(0, {k * m}), lambda t: {empty % 't::int'}),
            lambda s, x: case when len(s.out) >= {m} then s else list_transform([list_filter({pick}, lambda y: not list_contains(s.out, y))[1]],
              lambda n: case when n is null then s else {{'out': list_append(s.out, n), 'src': list_append(s.src, x.t % {k}), 't': x.t}} end)[1] end,
            {empty % '-1::int'}) as s from {name}_lists""",
        name: f"""
          select user_id, query_time, rank, item_id, 1.0::double / (rank + 1) as l1_score, source from (
            select user_id, query_time, generate_subscripts(s.out, 1) - 1 as rank, unnest(s.out) as item_id, {source} as source from {name}_folded) m""",
    }


PARTS |= merge_parts("merged", "test", ("dense", "pop"))
PARTS |= merge_parts("merged_dp", "valid", ("dense", "pop"))
PARTS |= merge_parts("merged_dc", "valid", ("dense", "cooc"))
PARTS |= merge_parts("merged_cp", "valid", ("cooc", "pop"))
PARTS |= merge_parts("merged_dcp", "valid", ("dense", "cooc", "pop"))
PARTS |= {
    "queries": "select vec_id as query_id, v, label as qlabel from vecs where vec_id % 25 = 0",
    "qrels": """
      select *, case label when 'E' then 1.0 when 'S' then 0.1 when 'C' then 0.01 else 0.0 end::double as gain from (
        select query_id, vec_id as product_id, case abs(qlabel - label) when 0 then 'E' when 1 then 'S' when 2 then 'C' else 'I' end as label
        from queries, vecs where query_id <> vec_id and (query_id * 31 + vec_id) % 7 = 0) x""",
    "knn": """
      select query_id, vec_id as product_id, round(list_dot_product(q.v, x.v), 9) as l1_score, row_number() over (partition by query_id order by l1_score desc, vec_id) - 1 as rank
      from queries q join vecs x on query_id <> vec_id qualify rank < 100""",
    "pool": "select * from poppool_test",
    "evalusers": "select distinct user_id from pool semi join positives_test using (user_id, item_id)",
    "evalpos": "select * from positives_test semi join evalusers using (user_id)",
    "npos": "select user_id, count(*) as n_pos from evalpos group by user_id",
    "runs": f"""
      select 'l1_order' as model, user_id, item_id, rank as l1_rank, -rank::double as score from pool
      union all select 'popularity', user_id, item_id, rank, l1_score from pool
      union all select 'oracle', user_id, item_id, rank, case when p.item_id is null then 0 else 1 end from pool left join positives_test p using (user_id, item_id)
      union all select 'random', user_id, item_id, rank, {draw("0", "user_id", "item_id")} / 4294967296.0 from pool
      union all select 'flaky', user_id, item_id, rank, case when {draw("'flaky'", "user_id", "item_id")} % 50 = 0 then null else l1_score end from pool""",
    "ranked": """
      select *, row_number() over (partition by model, user_id order by coalesce(score, '-inf'::double) desc, l1_rank, item_id) - 1 as new_rank from runs""",
    "per_user": """
      select model, user_id,
        sum(case when hit and new_rank < 10 then 1 / log2(new_rank + 2) else 0 end) / (select sum(1 / log2(i + 2)) from range(0, least(10, max(n_pos))) t(i)) as ndcg_10,
        count(*) filter (hit and new_rank < 10) / 10 as precision_10, count(*) filter (hit and new_rank < 30) / 30 as precision_30,
        sum(case when hit and new_rank < 30 then 1 / log2(new_rank + 2) else 0 end) / (select sum(1 / log2(i + 2)) from range(0, least(30, max(n_pos))) t(i)) as ndcg_30,
        count(*) filter (hit and new_rank < 10) / max(n_pos) as recall_10, count(*) filter (hit and new_rank < 30) / max(n_pos) as recall_30,
        (count(*) filter (hit and new_rank < 10) > 0)::int::double as hit_rate_10, (count(*) filter (hit and new_rank < 30) > 0)::int::double as hit_rate_30
      from (select r.*, p.item_id is not null as hit, n_pos from ranked r join npos using (user_id) left join evalpos p on p.user_id = r.user_id and p.item_id = r.item_id) x group by model, user_id""",
}
_IDEAL = {k: [0.0] for k in (10, 30)}
for _k, _v in _IDEAL.items():
    for _i in range(_k):
        _v.append(_v[-1] + 1 / math.log2(_i + 2))
    PARTS["per_user"] = PARTS["per_user"].replace(f"(select sum(1 / log2(i + 2)) from range(0, least({_k}, max(n_pos))) t(i))", f"({_v}::double[])[least({_k}, max(n_pos)) + 1]")


def boot_parts(source: str, key: str, metric: str, resamples: int) -> dict[str, str]:
    """The paired bootstrap of `metric` in `source` against l1_order, as the library draws it."""
    return {
        "diffs": f"select a.model, a.{key} as u, a.{metric} - b.{metric} as diff from {source} a join {source} b on a.{key} = b.{key} and b.model = 'l1_order' where a.model not in ('l1_order', 'oracle')",
        "numbered": f"select u, row_number() over (order by {draw(chr(39) + 'n' + chr(39), 'u')} % 256, u) - 1 as i, count(*) over () as n from (select distinct u from diffs) d",
        "draws": f"select b, {draw('0', 'b', 'k')} % n as i from (select distinct n from numbered) x, range(0, {resamples}) r(b), lateral (select unnest(range(0, n)) as k) y",
        "boot": "select model, b, round(avg(diff), 12) as mean from draws join numbered using (i) join diffs using (u) group by model, b",
        "tests": """
          select *, max(least(1.0, step * p)) over (order by p, model) as p_holm, 1 - 0.05 / step as ci_level from (
            select model, p, count(*) over () - row_number() over (order by p, model) + 1 as step from (
              select model, least(1.0, 2 * least((count(*) filter (mean <= 0) + 1) / (count(*) + 1), (count(*) filter (mean >= 0) + 1) / (count(*) + 1))) as p from boot group by model) a) b""",
        "boots": "select model, list(mean order by mean) as l from boot group by model",
        "compared": """
          select model, mean_diff, p, p_holm, ci_level,
            l[lo + 1] + (l[least(lo + 1, len(l) - 1) + 1] - l[lo + 1]) * (x - lo) as ci_low,
            l[hi + 1] + (l[least(hi + 1, len(l) - 1) + 1] - l[hi + 1]) * (y - hi) as ci_high, p_holm < 0.05 and mean_diff > 0 as significant
          from (select *, floor(x)::bigint as lo, floor(y)::bigint as hi from (
            select *, (1 - ci_level) / 2 * (len(l) - 1) as x, (1 - (1 - ci_level) / 2) * (len(l) - 1) as y
            from tests join boots using (model) join (select model, avg(diff) as mean_diff from diffs group by model) m using (model)) a) b""",
    }


PARTS |= boot_parts("per_user", "user_id", "ndcg_10", 10_000)


def graded_parts(runs: str) -> dict[str, str]:
    return {
        "gruns": runs,
        "granked": """
          select *, case when label is not null then count(label) over (partition by model, query_id order by new_rank) - 1 end as judged_rank from (
            select r.*, label, gain, row_number() over (partition by model, r.query_id order by score desc, l1_rank, r.product_id) - 1 as new_rank
            from gruns r left join qrels q on q.query_id = r.query_id and q.product_id = r.product_id) x""",
        "ideal": """
          select query_id, sum(case when r < 10 then gain / log2(r + 2) else 0 end) as idcg, count(*) filter (label = 'E') as n_e
          from (select *, row_number() over (partition by query_id order by gain desc, product_id) - 1 as r from qrels) x group by query_id""",
        "gper": """
          select model, query_id, count(*) filter (label = 'E' and new_rank < 10) / 10 as p_10, count(*) filter (label = 'E' and new_rank < 5) / 5 as p_5,
            count(*) filter (label in ('E', 'S') and new_rank < 10) / 10 as p_10_es, count(*) filter (label in ('E', 'S') and new_rank < 5) / 5 as p_5_es,
            count(*) filter (label = 'E' and judged_rank < 10) / 10 as p_10_judged, count(*) filter (label = 'E' and judged_rank < 5) / 5 as p_5_judged,
            count(*) filter (label is not null and new_rank < 10) / 10 as judged_10,
            coalesce(sum(case when new_rank < 10 then coalesce(gain, 0) / log2(new_rank + 2) else 0 end) / nullif(max(idcg), 0), 0) as ndcg_10,
            coalesce(count(*) filter (label = 'E' and new_rank < 100) / nullif(max(n_e), 0), 0) as recall_100
          from granked left join ideal using (query_id) group by model, query_id""",
    }


_KNN_RUN = "select 'x' as model, query_id, product_id, rank as l1_rank, -rank::double as score from knn"
_ORACLE_RUN = "select 'oracle' as model, query_id, product_id, rank as l1_rank, coalesce(gain, 0) as score from knn left join qrels using (query_id, product_id)"
_GRADED_RUNS = f"{_KNN_RUN.replace(chr(39) + 'x', chr(39) + 'l1_order')} union all select 'random', query_id, product_id, rank, {draw('0', 'query_id', 'product_id')} / 4294967296.0 from knn union all {_ORACLE_RUN}"
_BINARY = ("ndcg_10", "precision_10", "precision_30", "ndcg_30", "recall_10", "recall_30", "hit_rate_10", "hit_rate_30")
_GRADED = ("p_10", "p_5", "p_10_es", "p_5_es", "p_10_judged", "p_5_judged", "judged_10", "ndcg_10", "recall_100")


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in columns)


def recalls(pool: str, cohort: str, pos: str, ks: tuple[int, ...], key: str = "") -> str:
    k, kc = (f"{key}, ", f"{key}, ") if key else ("", "")
    settings = f", (select distinct {key} from {pool}) s" if key else ""
    on = f"x.user_id = l.user_id and x.item_id = l.item_id{f' and x.{key} = l.{key}' if key else ''}"
    cols = ", ".join(f"round(avg(f{n} / n), 6) + 0.0 as recall_{n}, round(avg((f{n} > 0)::int), 6) + 0.0 as users_with_pos_{n}" for n in ks)
    found = ", ".join(f"count(*) filter (rank < {n}) as f{n}" for n in ks)
    return f"""select {k}{cols} from (select {f'x.{key}, ' if key else ''}x.user_id, count(*) as n, {found} from (select * from {pos} semi join {cohort} using (user_id){settings}) x left join {pool} l on {on} group by all) y {f'group by {key}' if key else ''}"""


def statement(select: str, parts: dict[str, str] | None = None) -> str:
    """The select with the common table expressions that it needs."""
    import re

    every = {k: v for k, v in PARTS.items() if k not in (parts or {})} | (parts or {})
    ordered: list[str] = []  # each after those it is built on

    def need(sql: str, own: str) -> None:
        for n in every:
            if n != own and n not in ordered and n not in open_ and re.search(rf"\b{n}\b", sql):
                open_.add(n)
                need(every[n], n)
                ordered.append(n)

    open_: set[str] = set()
    need(select, "")
    ctes = ", ".join(f"{n} as ({every[n]})" for n in ordered)
    return f"with recursive {ctes} {select}" if ctes else select


_POOLS = (("pop", "poppool_valid"), ("cooc", "coocpool_valid"), ("cooc_pop", "merged_cp"))
_SCREEN = f"""
  select category, users, items, ratings, eligible_valid_users, eligible_test_users, {r6("positives_per_user", "unreachable_share", *[f"{n}_{c}" for n, _ in _POOLS for c in ("recall_100", "users_with_pos_100")])},
    floor(greatest({", ".join(f"{n}_users_with_pos_100" for n, _ in _POOLS)}) * eligible_test_users + 1e-9)::bigint as est_test_eval_users
  from (select c_mktsegment as category, count(distinct user_id) as users, count(distinct item_id) as items, count(*) as ratings from ratings join customer on c_custkey = user_id group by 1) a
  join (select category, count(*) as eligible_valid_users, avg(n) as positives_per_user, sum(new) / sum(n) as unreachable_share, {", ".join(f"avg({n} / n) as {n}_recall_100, avg(({n} > 0)::int) as {n}_users_with_pos_100" for n, _ in _POOLS)} from (
    select c_mktsegment as category, user_id, count(*) as n, {", ".join(f"count(r_{n}) as {n}" for n, _ in _POOLS)}, count(*) filter (not coalesce(first_seen < query_time, false)) as new
    from positives_valid join (select user_id, query_time from cohort_valid) c using (user_id) join customer on c_custkey = user_id left join first_seen using (item_id)
      {" ".join(f"left join (select user_id, item_id, rank as r_{n} from {t}) p_{n} using (user_id, item_id)" for n, t in _POOLS)} group by 1, 2) x group by category) b using (category)
  join (select c_mktsegment as category, count(*) as eligible_test_users from cohort_test join customer on c_custkey = user_id group by 1) c using (category)"""
_SOUND = """
  select '{name}' as pool, (select count(*) from {pool} p join ratings r using (user_id, item_id) where r.ts < p.query_time) as seen,
    (select count(*) from {pool} p left join first_seen f using (item_id) where not coalesce(first_seen < query_time, false)) as unavailable,
    (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from {pool} group by user_id, item_id) x) as duplicates,
    (select count(*) from (select user_id from {pool} group by user_id having min(rank) <> 0 or max(rank) <> count(*) - 1 or count(distinct rank) <> count(*)) x) as gaps"""
_CLEAN = "regexp_replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '^ | $', '', 'g')"


def clean(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g')"
    for entity, char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return _CLEAN.format(out)


def words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


def cut(c: str, most: int) -> str:
    return f"case when len({words(c)}) <= {most} then {c} else array_to_string({words(c)}[:{most}], ' ') end as text, len({words(c)}) > {most} as truncated, least(len({words(c)}), {most}) as n_tokens"


_LINES = """list('- ' || coalesce(p_name, '(unknown)') || ' (rated ' || rating || ')' || coalesce(' | ' || p_type || '; ' || p_brand, '') order by r)"""
_PROFILE = f"""
  select user_id, n_prior, n_liked, n_disliked, truncated as profile_truncated, text from (
    select user_id, n_prior, n_liked, n_disliked, {cut("t", 60)} from (
      select user_id, n_prior, coalesce(len(l), 0) as n_liked, coalesce(len(d), 0) as n_disliked,
        'Items this shopper rated highly:\n' || coalesce(array_to_string(l, chr(10)), '') || chr(10) || 'Items this shopper rated low:' || chr(10) || coalesce(array_to_string(d, chr(10)), '- (none)') as t
      from (select user_id, count(*) as n_prior from hist_test group by user_id) n left join (
        select user_id, {_LINES} filter (slot = 1) as l, {_LINES} filter (slot = 0) as d from (
          select *, row_number() over (partition by user_id, slot order by ts desc, item_id, rating desc) as r from (
            select *, case when rating >= 4 then 1 when rating <= 2 then 0 end as slot from hist_test) a where slot is not null) b left join part on p_partkey = item_id
        where r <= case slot when 1 then 10 else 3 end group by user_id) c using (user_id)) e) f""".replace("highly:\n'", "highly:' || chr(10)")
_PTEXT = f"""
  select page_id, array_to_string(list_filter([nullif({clean("url")}, ''), 'Brand: ' || nullif({clean("brand")}, ''), 'Features: ' || bullets, 'Description: ' || nullif({clean("html")}, '')], lambda x: x is not null), chr(10)) as text
  from (select page_id, url, html, case when page_id % 3 > 0 then '<b>b&amp;' || page_id || '</b>' end as brand, case when page_id % 5 > 0 then 'one © x; two ' || page_id end as bullets from pages) p"""

ORACLE_SQL: dict[str, str] = {
    "minimum_slice": statement("select (select count(*) from cohort_test) as cohort_users, count(*) as users_with_pos, round(avg(ndcg_10), 6) + 0.0 as ndcg_10_conditional, round(sum(ndcg_10) / (select count(*) from cohort_test), 6) + 0.0 as ndcg_10_all_users from per_user where model = 'l1_order'"),
    "cohort_valid": statement("select * from cohort_valid"),
    "cohort_test": statement("select * from cohort_test"),
    "positives_test": statement("select * from positives_test"),
    "first_seen_items": statement("select * from first_seen"),
    "popularity_90d": statement("select query_time, item_id, score::double as score from pop_test"),
    "popularity_90d_topk": statement("select user_id, query_time, rank, item_id, l1_score from poppool_test"),
    "cooccurrence_sim": statement("select query_time, i, j, round(sim, 6) + 0.0 as sim from sim_test"),
    "cooccurrence_topk": statement("select user_id, query_time, rank, item_id, round(l1_score, 9) + 0.0 as l1_score from coocpool_test"),
    "user_vectors": statement("select user_id, fallback, generate_subscripts(v, 1) - 1 as dim, round(unnest(v), 6) + 0.0 as x from unorm_test where half_life = 180"),
    "dense_topk": statement("select user_id, query_time, rank, item_id, round(l1_score, 9) + 0.0 as l1_score from dense_test where half_life = 180"),
    "exact_knn": statement("select query_id, product_id, round(l1_score, 9) + 0.0 as l1_score, rank from knn"),
    "judged_pools": statement("select query_id, product_id, round(score, 9) + 0.0 as score, row_number() over (partition by query_id order by score desc, product_id) - 1 as rank from (select query_id, product_id, round(list_dot_product(q.v, x.v), 9) as score from qrels join (select query_id, v from queries) q using (query_id) join vecs x on vec_id = product_id) j"),
    "interleave_pool": statement("select user_id, query_time, rank, item_id, round(l1_score, 9) + 0.0 as l1_score, source from merged"),
    "source_share": statement("select source, round(count(*) / (select count(*) from merged), 4) + 0.0 as share from merged group by source"),
    "leakage_audit": statement(_SOUND.format(name="sound", pool="pool") + " union all " + _SOUND.format(name="planted", pool="planted"), {"planted": "select user_id, query_time, rank, item_id from pool union all select user_id, query_time, 7, item_id from seen_test join (select user_id, query_time from cohort_test) c using (user_id)"}),
    "profile_audit": statement("select count(*) filter (ts >= query_time) as late_events from ratings join cohort_test using (user_id)"),
    "split_cut_check": statement(" union all ".join(f"select '{name}' as log, train_first, train_last, valid_first, valid_last, test_first, test_last, train_last < v and v <= valid_first and valid_last < t and t <= test_first as ok from (select v, t, " + ", ".join(f"{f}(ts) filter ({c}) as {k}_{e}" for k, c in tags.items() for e, f in (("first", "min"), ("last", "max"))) + " from ratings, cuts group by v, t) x" for name, tags in (("sound", {"train": "ts < v", "valid": "ts >= v and ts < t", "test": "ts >= t"}), ("planted", {"train": "ts < v or (ts >= t and user_id % 50 = 0)", "valid": "ts >= v and ts < t", "test": "ts >= t and user_id % 50 <> 0"})))),
    "recall_table": statement(recalls("poppool200_test", "cohort_test", "positives_test", (50, 100, 200))),
    "positive_reachability": statement("select count(distinct user_id) as n_users, count(*) as n_positives, round(avg(new), 6) + 0.0 as share_not_yet_available, round(avg(again), 6) + 0.0 as share_already_seen, round(1 - (sum(new) + sum(again)) / count(*), 6) + 0.0 as max_reachable_share from (select p.user_id, (not coalesce(first_seen < query_time, false))::int as new, (s.item_id is not null)::int as again from positives_test p join (select user_id, query_time from cohort_test) c using (user_id) left join first_seen using (item_id) left join seen_test s on s.user_id = p.user_id and s.item_id = p.item_id) x"),
    "half_life_sweep": statement(recalls("dense_valid", "cohort_valid", "positives_valid", (50, 100), "half_life")),
    "channel_compare": statement(recalls("chan", "cohort_valid", "positives_valid", (50, 100), "channel"), {"chan": "select 'pop' as channel, user_id, item_id, rank from poppool_valid union all select 'cooc', user_id, item_id, rank from coocpool_valid union all select 'dense', user_id, item_id, rank from dense_valid where half_life = 180" + "".join(f" union all select '{label}', user_id, item_id, rank from {part}" for label, part in (("dense+pop", "merged_dp"), ("dense+cooc", "merged_dc"), ("cooc+pop", "merged_cp"), ("dense+cooc+pop", "merged_dcp")))}),
    "category_screen": statement(_SCREEN),
    "eval_cohort": statement("select user_id from evalusers"),
    **{f"score_{m}": statement(f"select user_id, {r6(*_BINARY)} from per_user where model = '{m}'") for m in ("l1_order", "popularity", "oracle", "random")},
    "failed_scores_rank_last": statement("select user_id, item_id, l1_rank, new_rank from ranked where model = 'flaky'"),
    "contract_audit": statement("select 0::bigint as missing, 0::bigint as extra, 0::bigint as infinite, count(*) as failures from runs where model = 'flaky' and score is null"),
    "graded_metrics": statement(f"select query_id, {r6(*_GRADED)} from gper", graded_parts(_KNN_RUN)),
    "graded_oracle": statement(f"select query_id, {r6(*_GRADED)} from gper", graded_parts(_ORACLE_RUN)),
    "l1_diagnostics": statement("select " + ", ".join(f"round(avg(coalesce(g{k}, 0) / nullif(n_e, 0)), 6) + 0.0 as recall_e_{k}, round(avg((coalesce(g{k}, 0) > 0)::int), 6) + 0.0 as queries_with_e_{k}, (select round(avg((label is not null)::int), 6) + 0.0 from lab where rank < {k}) as judged_{k}" for k in (10, 50, 100)) + ", (select count(distinct query_id) from knn) as queries from (select query_id, count(*) filter (label = 'E') as n_e from qrels group by query_id) a left join (select query_id, " + ", ".join(f"count(*) filter (label = 'E' and rank < {k}) as g{k}" for k in (10, 50, 100)) + " from lab group by query_id) b using (query_id)", {"lab": "select query_id, product_id, rank, label from knn left join qrels using (query_id, product_id)"}),
    "rrf_fusion": statement("select user_id, item_id, a.l1_rank, round(0.3::double / (60 + a.new_rank + 1) + (1.0::double - 0.3::double) / (60 + b.new_rank + 1), 9) + 0.0 as score from ranked a join ranked b using (user_id, item_id) where a.model = 'random' and b.model = 'popularity'"),
    "rrf_tuning": statement(
        "select w, round(m, 6) + 0.0 as ndcg_10, w = (select w from means order by round(m, 12) desc, w limit 1) as chosen from means",
        {
            "fused": "select w, user_id, item_id, row_number() over (partition by w, user_id order by w / (60 + a.new_rank + 1) + (1.0::double - w) / (60 + b.new_rank + 1) desc, a.l1_rank, item_id) - 1 as r from ranked a join ranked b using (user_id, item_id), (select i / 10 as w from range(0, 11) t(i)) g where a.model = 'random' and b.model = 'popularity'",
            "means": f"select w, avg(dcg / ({_IDEAL[10]}::double[])[least(10, n_pos) + 1]) as m from (select w, f.user_id, max(n_pos) as n_pos, sum(case when p.item_id is not null and r < 10 then 1 / log2(r + 2) else 0 end) as dcg from fused f join npos using (user_id) left join evalpos p on p.user_id = f.user_id and p.item_id = f.item_id group by 1, 2) x group by w",
        },
    ),
    "channel_diagnostics": statement(
        "select model, source, round(count(*) filter (new_rank < 10) / max(tops), 6) + 0.0 as topk_share, round(avg(new_rank) filter (pos), 6) + 0.0 as pos_mean_rank, round(avg((new_rank < 10)::int) filter (pos), 6) + 0.0 as pos_in_topk from dr join (select model, count(*) filter (new_rank < 10) as tops from dr group by model) t using (model) group by model, source union all select model, 'all', null, round(avg(new_rank) filter (pos), 6) + 0.0, null from dr group by model",
        {
            "ds": f"select 'l1_order' as model, *, -rank::double as score from merged union all select 'random', *, {draw('0', 'user_id', 'item_id')} / 4294967296.0 from merged",
            "dr": "select d.*, p.item_id is not null as pos, row_number() over (partition by model, d.user_id order by score desc, rank, d.item_id) - 1 as new_rank from ds d left join positives_test p on p.user_id = d.user_id and p.item_id = d.item_id",
        },
    ),
    "paired_bootstrap": statement("select model, b, round(mean, 6) + 0.0 as mean from boot where model = 'random'"),
    "holm_table": statement(f"select model, {r6('mean_diff', 'p', 'p_holm', 'ci_level', 'ci_low', 'ci_high')}, significant from compared"),
    "leaderboard": statement("select model, " + ", ".join(f"round(avg({m}), 6) + 0.0 as {m}" for m in _BINARY) + ", round(sum(ndcg_10) / (select count(*) from cohort_test), 6) + 0.0 as ndcg_10_all_users, round(any_value(c.mean_diff), 6) + 0.0 as diff_vs_l1, round(any_value(ci_low), 6) + 0.0 as ci_low, round(any_value(ci_high), 6) + 0.0 as ci_high, round(any_value(p_holm), 6) + 0.0 as p_holm, any_value(significant) as beats_l1 from per_user left join compared c using (model) group by model"),
    "leaderboard_graded": statement("select model, " + ", ".join(f"round(avg({m}), 6) + 0.0 as {m}" for m in _GRADED) + ", round(any_value(c.mean_diff), 6) + 0.0 as diff_vs_l1, round(any_value(ci_low), 6) + 0.0 as ci_low, round(any_value(ci_high), 6) + 0.0 as ci_high, round(any_value(p_holm), 6) + 0.0 as p_holm, any_value(significant) as beats_l1 from gper left join compared c using (model) group by model", graded_parts(_GRADED_RUNS) | boot_parts("gper", "query_id", "p_10", 10_000)),
    "rating5_sensitivity": statement(recalls("poppool200_test", "cohort_test", "five", (50, 100, 200)), {"five": "select distinct user_id, item_id from ratings semi join cohort_test using (user_id), cuts where ts >= t and rating >= 5"}),
    "clean_html": f"select page_id, {clean('html')} as text from pages",
    "product_text": _PTEXT,
    "token_cut": f"select doc_id, {cut('text', 160)} from documents",
    "render_item": f"select item_id, {cut('t', 8)}, attrs from (select p_partkey as item_id, 'Title: ' || p_name || chr(10) || 'Store: ' || p_brand || chr(10) || 'Categories: ' || p_type || case when p_partkey % 4 > 0 then chr(10) || 'Price: ' || floor(p_retailprice)::bigint else '' end as t, p_type || '|' || p_brand as attrs from part) x",
    "render_profile": statement(_PROFILE),
    "dedup_keep_first": statement("select user_id, item_id, ts, rating::bigint as rating, l_orderkey, l_linenumber::bigint as l_linenumber from ratings qualify row_number() over (partition by user_id, item_id, ts order by l_orderkey, l_linenumber) = 1"),
    "md5_sample": statement(f"select * from cohort_test order by {draw('0', 'user_id')}, user_id limit 50"),
    "label_stats": statement("select round(quantile_cont(n, 0.5), 6) + 0.0 as judged_median, round(avg(e), 6) + 0.0 as exact_mean, count(*) as queries, " + ", ".join(f"(select round(count(*) filter (label = '{s}') / count(*), 6) + 0.0 from qrels) as share_{s.lower()}" for s in "ESCI") + " from (select query_id, count(*) as n, count(*) filter (label = 'E') as e from qrels group by query_id) x"),
    "length_stats": f"select count(*) as count, round(avg(n), 6) + 0.0 as mean, round(stddev_samp(n), 6) + 0.0 as std, min(n) as min, " + ", ".join(f"round(quantile_cont(n, {q}), 6) + 0.0 as p{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.95)) + f", max(n) as max, count(*) filter (n = 0) as empty from (select len({words('text')}) as n from documents) x",
    "hash_embedding": f"select item_id, dim, round(x / sqrt(sum(x * x) over (partition by item_id)), 6) + 0.0 as x from (select item_id, dim, count(w) + 1e-6::double as x from (select p_partkey as item_id, d.dim, w from (select p_partkey, unnest({words('lower(p_name)')}) as w from part) p right join (select p_partkey as k, dim from part, range(0, 64) r(dim)) d on p.p_partkey = d.k and ('0x' || right(md5(w), 2))::bigint % 64 = d.dim) y group by all) z".replace("select p_partkey as item_id, d.dim, w from (select p_partkey", "select d.k as item_id, d.dim, w from (select p_partkey"),
    "freeze_digest": statement(
        "select digest, digest as digest_read, (select count(*) from pool)::bigint as rows from (select sha256(concat_ws(':', " + ", ".join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::bigint)::varchar" for k in range(4)) + ", sum(n)::varchar)) as digest from grouped) x",
        {
            "grouped": "select user_id, sha256(string_agg(d, '' order by d)) as d, count(*) as n from rowed group by user_id",
            "rowed": """select user_id, sha256('{"user_id":' || user_id || ',"query_time":"' || strftime(query_time, '%Y-%m-%dT%H:%M:%S.000') || '","rank":' || rank || ',"item_id":' || item_id || ',"l1_score":' || printf('%.1f', l1_score) || '}') as d from pool""",
        },
    ),
    "cost_latency": "select event_type as model, round(quantile_cont(value / 1000, 0.5), 6) + 0.0 as latency_p50, round(quantile_cont(value / 1000, 0.95), 6) + 0.0 as latency_p95, count(*) filter (event_id % 97 = 0) as failures, round(sum(length(props)) * 0.24::double / 1e6, 6) + 0.0 as cost_usd from events group by event_type",
    "preparation_report": statement(
        f"select (select count(*) from prep) as items, (select round(avg(truncated::int), 6) + 0.0 from prep) as item_truncated_share, (select count(*) from (select distinct item_id from ratings) r anti join prep using (item_id)) as items_without_metadata, (select round(avg(profile_truncated::int), 6) + 0.0 from prof) as profile_truncated_share, (select count(*) from cohort_test) as users, (select round(avg(n_pos), 6) + 0.0 from cohort_test) as positives_per_user",
        {"prep": f"select item_id, {cut('t', 9)} from (select p_partkey as item_id, 'Title: ' || p_name || chr(10) || 'Store: ' || p_brand || chr(10) || 'Categories: ' || p_type as t from part) x", "prof": _PROFILE},
    ),
    "pool_sizes": statement("select count(*) as count, round(avg(n), 6) + 0.0 as mean, round(stddev_samp(n), 6) + 0.0 as std, min(n) as min, " + ", ".join(f"round(quantile_cont(n, {q}), 6) + 0.0 as p{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + ", max(n) as max from (select user_id, count(*) as n from coocpool_test group by user_id) x"),
    "run_totals": "select event_type as model, count(*) filter (event_id % 97 = 0) as failures, sum(event_id % 5)::bigint as retries, string_agg(distinct 'v' || event_id % 3, ',' order by 'v' || event_id % 3) as versions from events group by event_type",
    "error_histogram": "select 'error ' || event_id % 4 as error, count(*) as n from events where event_id % 97 = 0 group by 1",
    "latest_run": "select event_type as model, event_id as run_id, date_trunc('day', ts)::timestamp as started_at from events where coalesce(case when event_id % 3 = 0 then event_id % 2 end, 0) = 0 qualify row_number() over (partition by event_type order by date_trunc('day', ts) desc, event_id desc) = 1",
}

ORACLE_SQL["markdown_rows"] = f"select model, printf('%.4f', p_10) as p_10, case when diff_vs_l1 is null then '—' else printf('%+.4f', diff_vs_l1) end as diff from ({ORACLE_SQL['leaderboard_graded']}) b"
_SIGNS = "select model, sign(round(avg(d), 9)) as s from (select a.model, a.ndcg_10 - b.ndcg_10 as d from {0} a join {0} b using (user_id) where b.model = 'l1_order' and a.model not in ('l1_order', 'oracle')) x group by model"
ORACLE_SQL["robustness_rule"] = statement(
    "select model, a.s = b.s as robust from (" + _SIGNS.format("per_user") + ") a join (" + _SIGNS.format("per_five") + ") b using (model)",
    {
        "five": "select distinct user_id, item_id from ratings, cuts where ts >= t and rating >= 5",
        "fivepos": "select * from five semi join (select user_id from pool join five using (user_id, item_id)) u using (user_id)",
        "nfive": "select user_id, count(*) as n_pos from fivepos group by user_id",
        "per_five": PARTS["per_user"].replace("npos", "nfive").replace("evalpos", "fivepos"),
    },
)
PARTS |= {
    "planes": f"select b, list(case when {draw('0', 'b', 'd')} % 2 = 1 then 1.0 else -1.0 end order by d)::double[] as p from range(0, 512) r(b), range(0, 64) t(d) group by b",
    "codes": "select vec_id, list(round(list_dot_product(v, p), 9) >= 0 order by b) as code from vecs, planes group by vec_id",
    "apart": """
      select q.query_id, c.vec_id, len(list_filter(list_zip(k.code, c.code), lambda z: z[1] <> z[2])) as apart
      from queries q join codes k on k.vec_id = q.query_id, codes c""",
}


def coded(k: int) -> str:
    """The candidates of a search by codes, with their exact scores and ranks."""
    return f"""
      select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) - 1 as rank from (
        select a.query_id, a.vec_id, round(list_dot_product(q.v, x.v), 9) as score
        from (select * from apart qualify row_number() over (partition by query_id order by apart, vec_id) <= {4 * k}) a join queries q on q.query_id = a.query_id join vecs x on x.vec_id = a.vec_id) s"""


ORACLE_SQL["code_candidates"] = statement("select query_id, vec_id, round(score, 9) + 0.0 as score, rank from near", {"near": coded(20)})
ORACLE_SQL["ann_overlap"] = statement(
    "select round(avg(n / 100), 6) + 0.0 as overlap, (select round(count(*) / (select count(*) from queries) / (select count(*) from vecs), 6) + 0.0 from near) as candidate_share from (select query_id, count(*) filter (found) as n from (select k.query_id, o.vec_id is not null as found from knn k left join other o on o.query_id = k.query_id and o.vec_id = k.product_id) x group by query_id) y",
    {"near": coded(100), "other": "select query_id, vec_id from near where query_id <> vec_id qualify row_number() over (partition by query_id order by rank) <= 100"},
)
