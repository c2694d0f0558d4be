from decimal import ROUND_HALF_UP, Decimal
from itertools import combinations

from chronoforest.queries import QUERIES

STATUS = {"O": 1, "F": 2}


def exact_total(orders):
    total = Decimal(0)
    for a, b in combinations(orders, 2):
        total += (Decimal(str(a["o_totalprice"])) + Decimal(str(b["o_totalprice"]))) / 1000
        pr = [int(x["o_orderpriority"][0]) for x in (a, b)]
        if a["o_orderstatus"] != b["o_orderstatus"]:
            total += sum(pr) + sum(STATUS.get(x["o_orderstatus"], 3) for x in (a, b))
        elif pr[0] != pr[1]:
            total += sum(pr)
    return total


def test_totals_of_half_a_cent_are_rounded_up(spark, tmp_path):
    """Customers whose pairs' distances sum to half a cent exactly; sums of doubles came to less on some of them."""
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").where("o_custkey IN (13459, 13595, 2523, 3388, 3617, 426, 5481, 7784, 8237, 974)")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = {}
    for r in orders.collect():
        rows.setdefault(str(r["o_custkey"]), []).append(r)
    want = {k: exact_total(v) for k, v in rows.items()}
    assert len(want) == 10 and all(v % Decimal("0.01") == Decimal("0.005") for v in want.values())
    got = {r["tree_id"]: r["total"] for r in QUERIES["order_least_deviation"](spark, str(tmp_path)).collect()}
    assert got == {k: float(v.quantize(Decimal("0.01"), ROUND_HALF_UP)) for k, v in want.items()}
