"""SQL that gives the rows of the queries p2 another way, and the texts that p6 and p8 must give back."""

from __future__ import annotations


def _summary(period: str, extra: list[float], name: str) -> str:
    levels = ", ".join(f"{p!r}::double" for p in sorted({i / 64 for i in range(65)} | set(extra)))
    parts = " union all ".join(
        f"select '{c}' as column_name, {c}::varchar as key_value, {period} as {name}, temperature as x from model_atom" for c in ("element", "structure")
    )
    return f"""
with part as ({parts}), sizes as (
  select column_name, key_value, {name}, count(*) filter (x is not null and not isnan(x)) as n, count(*) filter (x is null) as n_null, count(*) filter (isnan(x)) as n_nan
  from part group by all
), ranked as (
  select column_name, key_value, {name}, x, row_number() over (partition by column_name, key_value, {name} order by x) as rn from part
where x is not null and not isnan(x)
), summary as (
  select s.column_name, s.key_value, s.{name}, s.n, s.n_null, s.n_nan, lv.p, r.rn as rank, r.x as value_low, r.x as value_high, ceil(s.n / 64)::bigint as merge_rank_error
  from sizes s cross join (select unnest([{levels}]) as p) lv
  join ranked r on r.column_name = s.column_name and r.key_value is not distinct from s.key_value and r.{name} is not distinct from s.{name} and r.rn = greatest(1, ceil(lv.p * s.n))::bigint
)"""


_EXTRA = [0.01, 0.05, 0.1, 0.9, 0.95, 0.99]

SQL = {
    "p2_summary": _summary("load_id", _EXTRA, "load_id") + " select * from summary",
    "p2_daily": _summary("loaded_at::date", [], "day") + " select * from summary",
    "p2_combined": _summary("load_id", _EXTRA, "load_id")
    + """, step as (
      select *, rank - coalesce(lag(rank) over (partition by column_name, key_value, load_id order by rank, p), 0) as w from summary
    ), totals as (
      select column_name, key_value, sum(n)::bigint as n, sum(merge_rank_error)::bigint as rank_error
from (select distinct column_name, key_value, load_id, n, merge_rank_error from summary) group by all
    ), known as (
      select column_name, key_value, v, sum(w) over (partition by column_name, key_value order by v) as known
from (select column_name, key_value, value_high as v, sum(w) as w from step group by 1, 2, 3)
    ) select t.column_name, t.key_value, t.n, l.p, min(k.v) as value, t.rank_error
    from totals t join known k on k.column_name = t.column_name and k.key_value is not distinct from t.key_value cross
join (select unnest([0.05, 0.25, 0.5, 0.75, 0.95]::double[]) as p) l
    where k.known >= l.p * t.n group by t.column_name, t.key_value, t.n, l.p, t.rank_error""",
    "p6_texts": "select doc_id, md5(coalesce(text, '')) as digest, true as fits from documents",
    "p8_texts": "select doc_id, md5(text) as digest, true as fits from documents",
}
