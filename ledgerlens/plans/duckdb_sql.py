"""Independent DuckDB SQL for every query (the correctness oracle).

Each body may name earlier queries as tables; ``oracle_sql()`` resolves those names into a
``WITH`` prefix so every string runs alone on the registered test-table views.
"""

from __future__ import annotations

import re

BODIES: dict[str, str] = {
    "q01_order_suppliers": """
select l_orderkey order_id, l_suppkey supplier_key, s_name supplier_name
from lineitem left join supplier on s_suppkey = l_suppkey
where l_orderkey <> 0 and l_suppkey <> 0 group by l_orderkey, l_suppkey, s_name""",
    "q02_returns_by_order": """
select l_orderkey order_id, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(18,2)))) as decimal(18,2)) returned
from lineitem where l_returnflag = 'R' and l_orderkey <> 0 and l_suppkey <> 0 group by l_orderkey""",
    "q03_billing_lines": """
select substr(o_orderpriority,1,1) branch_id, o_orderkey order_id, os.supplier_key, os.supplier_name,
  c_custkey - c_custkey % 5 client_key, c_name client_name, c_custkey client_id, n_name state,
  cast(o_totalprice as decimal(18,2)) billed, r.returned, o_orderstatus status, o_orderpriority sale_type,
  o_orderdate order_date, o_orderkey % 2000 promo_code
from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey
left join q01_order_suppliers os on os.order_id = o_orderkey left join q02_returns_by_order r on r.order_id = o_orderkey""",
    "q04_billing_window": """
select * from q03_billing_lines where order_date between timestamp '1998-04-12 00:00:00' and timestamp '1998-09-21 00:00:00'
and status in ('F') and sale_type in ('1-URGENT','2-HIGH')""",
    "q05_billing_promo": """
select * from q03_billing_lines where status in ('F') and promo_code in (select p_partkey from part where p_brand = 'Brand#2')""",
    "q06_billing_unified": """
select branch_id, order_id, supplier_key, supplier_name, client_key, client_name, client_id, state, billed, returned
from (select u.*, row_number() over (partition by branch_id, order_id, client_key, supplier_key order by src_priority, client_id) rn
  from (select 0 src_priority, a.* from q04_billing_window a union all select 1 src_priority, b.* from q05_billing_promo b) u) w where rn = 1""",
    "q07_demand": """
select s_name supplier_name, s_suppkey supplier_key, c_name client_name, c_custkey - c_custkey % 5 client_key, n_name state,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(18,2)) ordered, count(l_orderkey) order_count
from lineitem join orders on o_orderkey = l_orderkey join supplier on s_suppkey = l_suppkey
join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey
group by s_name, s_suppkey, c_name, c_custkey - c_custkey % 5, n_name""",
    "q08_clean_keys": """
select c_custkey client_id, regexp_replace(regexp_replace(cast(c_custkey as string) || ',0', '[.,]0$', ''), '[^0-9]', '', 'g') from_code,
  coalesce(regexp_replace(regexp_replace(nullif(c_name, 'Customer#000000007'), '[.,]0$', ''), '[^0-9]', '', 'g'), '') from_name from customer""",
    "q09_scope_billing": """
select * from q06_billing_unified where upper(state) = upper('nation_3')""",
    "q10_scope_demand": """
select * from q07_demand where cast(client_key as string) in (select cast(client_key as string) from q09_scope_billing)""",
    "q11_reconcile_client": """
select coalesce(p.k, b.k) client_key, coalesce(p.n, b.n) client_name, cast(coalesce(p.v,0) as double) ordered,
  cast(coalesce(b.f,0) as double) billed, cast(coalesce(b.r,0) as double) returned,
  cast(coalesce(p.v,0) - coalesce(b.f,0) as double) flow_diff, cast(coalesce(b.f,0) - coalesce(b.r,0) as double) net_billed
from (select coalesce(cast(client_key as string),'') k, min(client_name) n, sum(ordered) v from q07_demand group by 1) p
full outer join (select coalesce(cast(client_key as string),'') k, min_by(client_name, client_id) n, sum(billed) f, sum(returned) r from q06_billing_unified group by 1) b on p.k = b.k""",
    "q12_reconcile_supplier": """
select coalesce(p.k, b.k) supplier_key, upper(trim(coalesce(p.n, b.n))) supplier_name, cast(coalesce(p.v,0) as double) ordered,
  cast(coalesce(b.f,0) as double) billed, cast(coalesce(b.r,0) as double) returned, cast(coalesce(p.v,0) - coalesce(b.f,0) as double) flow_diff
from (select coalesce(cast(supplier_key as string),'') k, min(supplier_name) n, sum(ordered) v from q07_demand group by 1) p
full outer join (select coalesce(cast(supplier_key as string),'') k, min(supplier_name) n, sum(billed) f, sum(returned) r from q06_billing_unified group by 1) b on p.k = b.k""",
    "q13_branch_summary": """
select branch_id, cast(sum(billed) as double) billed, cast(coalesce(sum(returned),0) as double) returned,
  cast(sum(billed) - coalesce(sum(returned),0) as double) net_billed, cast(0 as double) ordered, cast(-sum(billed) as double) flow_diff
from q06_billing_unified where branch_id is not null group by branch_id""",
    "q14_state_summary": """
select state, cast(sum(billed) as double) billed, cast(coalesce(sum(returned),0) as double) returned,
  cast(sum(billed) - coalesce(sum(returned),0) as double) net_billed, cast(0 as double) ordered, cast(-sum(billed) as double) flow_diff
from q06_billing_unified where state is not null group by state""",
    "q15_totals": """
select cast(sum(cast(ordered as decimal(18,2))) as double) ordered, cast(sum(cast(billed as decimal(18,2))) as double) billed,
  cast(sum(cast(returned as decimal(18,2))) as double) returned, cast(sum(cast(flow_diff as decimal(18,2))) as double) flow_diff from q11_reconcile_client""",
    "q16_top_clients": """
select client_name, client_key, net_billed from q11_reconcile_client where net_billed > 0 order by net_billed desc, client_key asc limit 10""",
    "q17_top_suppliers": """
select supplier_name, supplier_key, billed from q12_reconcile_supplier where billed > 0 order by billed desc, supplier_key asc limit 10""",
    "q18_client_detail": """
select client_name, client_key, ordered, billed, returned, flow_diff, net_billed from q11_reconcile_client order by flow_diff desc, client_key asc""",
    "q19_supplier_detail": """
select supplier_name, supplier_key, ordered, billed, returned, flow_diff from q12_reconcile_supplier order by flow_diff desc, supplier_key asc""",
    "q20_client_returns": """
select client_name, returned from q11_reconcile_client where returned > 0 order by returned desc, client_name asc""",
    "q21_supplier_returns": """
select supplier_name, returned from q12_reconcile_supplier where returned > 0 order by returned desc, supplier_name asc""",
    "q22_state_list": """
select state, pos from (select 'Todos' state, 0 pos union all select distinct state, 1 pos from q06_billing_unified where state is not null) t order by pos, state""",
    "q23_clients_per_state": """
select * from (with c as (select state, coalesce(regexp_replace(regexp_replace(cast(client_key as varchar), '[.,]0$', ''), '[^0-9]', '', 'g'), '') k from q06_billing_unified)
select state, count(distinct k) clients from c where state is not null group by state
union all select 'Todos' state, count(distinct k) clients from c) t""",
    "q24_client_roster": """
select case upper(trim(' ' || lower(n_name) || ' ')) when 'NATION_0' then 'BA' when 'NATION_1' then 'CE' when 'NATION_2' then 'MA'
  when 'NATION_3' then 'PE' when 'NATION_4' then 'MA' when 'NATION_5' then 'PI' else upper(trim(n_name)) end state,
  c_custkey code, c_name legal_name, cast(sum(cast(o_totalprice as decimal(18,2))) as double) total_spent,
  cast(coalesce(sum(case when month(o_orderdate) = 1 then cast(o_totalprice as decimal(18,2)) end),0) as double) m1,
  cast(coalesce(sum(case when month(o_orderdate) = 2 then cast(o_totalprice as decimal(18,2)) end),0) as double) m2,
  cast(coalesce(sum(case when month(o_orderdate) = 3 then cast(o_totalprice as decimal(18,2)) end),0) as double) m3,
  cast(coalesce(sum(case when month(o_orderdate) = 4 then cast(o_totalprice as decimal(18,2)) end),0) as double) m4,
  cast(coalesce(sum(case when month(o_orderdate) = 5 then cast(o_totalprice as decimal(18,2)) end),0) as double) m5,
  cast(coalesce(sum(case when month(o_orderdate) = 6 then cast(o_totalprice as decimal(18,2)) end),0) as double) m6,
  cast(coalesce(sum(case when month(o_orderdate) = 7 then cast(o_totalprice as decimal(18,2)) end),0) as double) m7,
  cast(coalesce(sum(case when month(o_orderdate) = 8 then cast(o_totalprice as decimal(18,2)) end),0) as double) m8,
  cast(coalesce(sum(case when month(o_orderdate) = 9 then cast(o_totalprice as decimal(18,2)) end),0) as double) m9
from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where year(o_orderdate) = 1998
group by n_name, c_custkey, c_name""",
    "q25_currency_report": """
select client_key, 'R$ ' || translate(format('{:,.2f}', flow_diff), ',.', '.,') flow_diff_text from q11_reconcile_client""",
    # The hand-off CSV round trip returns the unified billing unchanged, party keys as text
    # (the file schema never reads keys as numbers).
    "q26_csv_roundtrip": """
select branch_id, order_id, cast(supplier_key as varchar) supplier_key, supplier_name,
  cast(client_key as varchar) client_key, client_name, client_id, state, billed, returned
from q06_billing_unified""",
    # The co-located layout changes where rows lie, not what they are.
    "q27_billing_lines_colocated": "select * from q03_billing_lines",
    "q28_demand_colocated": "select * from q07_demand",
    # Shares of files, brought up to date, give what the whole inputs give.
    "q29_refreshed_reconciliation": "select * from q11_reconcile_client",
    "q30_reconcile_all_states": """
select coalesce(p.scope, b.scope) as scope, coalesce(p.k, b.k) client_key, coalesce(p.n, b.n) client_name, cast(coalesce(p.v,0) as double) ordered,
  cast(coalesce(b.f,0) as double) billed, cast(coalesce(b.r,0) as double) returned,
  cast(coalesce(p.v,0) - coalesce(b.f,0) as double) flow_diff, cast(coalesce(b.f,0) - coalesce(b.r,0) as double) net_billed
from (select scope, coalesce(cast(d.client_key as string),'') k, min(client_name) n, sum(ordered) v from q07_demand d
    join (select distinct upper(state) scope, coalesce(cast(client_key as string),'') ck from q06_billing_unified where state is not null) s
      on s.ck = coalesce(cast(d.client_key as string),'') group by 1, 2) p
full outer join (select upper(state) scope, coalesce(cast(client_key as string),'') k, min_by(client_name, client_id) n, sum(billed) f, sum(returned) r
    from q06_billing_unified where state is not null group by 1, 2) b on p.scope = b.scope and p.k = b.k""",
}

_NAME = re.compile(r"\bq\d\d_[a-z_]+\b")


def _deps(name: str, seen: list[str]) -> None:
    for dep in _NAME.findall(BODIES[name]):
        if dep != name and dep in BODIES and dep not in seen:
            _deps(dep, seen)
            seen.append(dep)


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, body in BODIES.items():
        deps: list[str] = []
        _deps(name, deps)
        if deps:
            ctes = ",\n".join(f"{d} as ({BODIES[d].strip()})" for d in deps)
            out[name] = f"with {ctes}\n{body.strip()}"
        else:
            out[name] = body.strip()
    return out
