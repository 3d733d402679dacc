"""Random canonical billing inputs: the one-pass unified billing (and q04/q05 alone) equals a
plain pandas statement of the two extracts + union + keep-first."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal as D

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.operators import billing as B

RULES = B.BillingRules(window_start="10/04/2025", window_end="12/04/2025", statuses=("F",), sale_types=("OL",),
                       origins=None, issuers=None, promo_statuses=("F",), return_op="ED")
LO, HI = dt.datetime(2025, 4, 10), dt.datetime(2025, 4, 12)
DAYS = [dt.datetime(2025, 4, d, h) for d in (9, 10, 11, 12, 13) for h in (0, 15)]

header_row = st.tuples(st.sampled_from(["1", "2", None]), st.integers(1, 5), st.sampled_from(DAYS),
                       st.sampled_from(["F", "O"]), st.sampled_from(["OL", "XX"]), st.integers(0, 3),
                       st.decimals(min_value=0, max_value=500, places=2))
move_row = st.tuples(st.integers(0, 12), st.integers(0, 4), st.sampled_from(["ED", "S"]),
                     st.decimals(min_value=0, max_value=99, places=4))


@st.composite
def inputs(draw):
    hdr = draw(st.lists(header_row, min_size=1, max_size=12))
    header = [(b, i + 1, c, v, d, s, t, p) for i, (b, c, d, s, t, p, v) in enumerate(hdr)]
    moves = draw(st.lists(move_row, max_size=30))
    promo = draw(st.lists(st.integers(0, 3), max_size=3))
    return header, moves, promo


CLIENTS = [(1, 10, "Ana", "CE"), (2, 10, "Ana B", "CE"), (3, 30, "Caio", "PI"), (4, 40, None, None)]
SUPPLIERS = [(1, "S1"), (2, "S2"), (3, None)]


def brute(header, moves, promo):
    cl = {c[0]: c for c in CLIENTS}
    sup = dict(SUPPLIERS)
    valid = [m for m in moves if m[0] != 0 and m[1] != 0]
    pairs = {}
    for o, s, _, _ in valid:
        pairs.setdefault(o, set()).add(s)
    ret = {}
    for o, s, op, v in valid:
        if op == "ED":
            ret[o] = ret.get(o, D(0)) + v
    ret = {o: v.quantize(D("0.01"), rounding=ROUND_HALF_UP) for o, v in ret.items()}
    lines = []
    for b, o, c, billed, day, status, stype, pcode in header:
        k, name, state = (cl[c][1], cl[c][2], cl[c][3]) if c in cl else (None, None, None)
        base = (b, o, k, name, c if c in cl else None, state, billed, ret.get(o), day, status, stype, pcode)
        for s in sorted(pairs.get(o, [])) or [None]:
            lines.append(base + (s, sup.get(s) if s is not None else None))
    win = [r for r in lines if LO <= r[8] <= HI and r[9] == "F" and r[10] == "OL"]
    pro = [r for r in lines if r[9] == "F" and r[11] in set(promo)]
    seen, unified = set(), []
    for r in win + pro:
        key4 = (r[0], r[1], r[2], r[12])
        if key4 not in seen:
            seen.add(key4)
            unified.append(r)

    def proj(rows):
        return sorted(((r[1], r[12], r[13], r[2], r[3], r[4], r[5], r[6], r[7], r[0]) for r in rows), key=repr)
    return proj(win), proj(pro), proj(unified)


@settings(max_examples=12, deadline=None, phases=[Phase.explicit, Phase.reuse, Phase.generate])
@given(inputs())
def test_billing_extracts_match_brute_force(spark, data):
    header, moves, promo = data
    hdr = spark.createDataFrame(header, "branch_id string, order_id long, order_client_id long, billed decimal(18,2), "
                                        "order_date timestamp_ntz, status string, sale_type string, promo_code long")
    mv = spark.createDataFrame(moves or [(0, 0, "S", D(0))], "order_id long, supplier_key long, op_code string, value decimal(20,4)")
    if not moves:
        mv = mv.where(F.lit(False))
    cli = spark.createDataFrame(CLIENTS, "client_id long, client_key long, client_name string, state string")
    sup = spark.createDataFrame(SUPPLIERS, "supplier_key long, supplier_name string")
    pr = spark.createDataFrame([(p,) for p in promo] or [(None,)], "promo_code long")
    cols = ["order_id", "supplier_key", "supplier_name", "client_key", "client_name", "client_id", "state",
            "billed", "returned", "branch_id"]

    def rows(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    want_w, want_p, want_u = brute(header, moves, promo)
    assert rows(B.billing_window(hdr, mv, cli, sup, RULES)) == want_w
    assert rows(B.billing_promo(hdr, mv, cli, sup, pr, RULES)) == want_p
    assert rows(B.billing_unified(hdr, mv, cli, sup, pr, RULES)) == want_u
