import pytest

from quernel.catalog import STAR
from quernel.plans import policy
from quernel.plans.refresh import Card, Filter, StatisticsCache, pin, refresh
from quernel.plans.service import GovernedSql
from quernel.plans.sharing import rows_shareable
from quernel.queries.relational import TABLES
from quernel.sources import register_tables


@pytest.fixture(scope="module")
def service(spark, sf):
    register_tables(spark, sf, TABLES)
    return GovernedSql(spark, STAR, timeout_s=60)


def test_refresh(spark, service):
    card = pin(service, "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
    whole, some = refresh(service, card), refresh(service, card, (Filter("orders", "o_orderstatus", ("F",)),))
    want = spark.sql("SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'").head()[0]
    assert sum(r["n"] for r in some.rows) == want < sum(r["n"] for r in whole.rows)
    assert whole.changed == [] and some.unfiltered == []
    assert refresh(service, card, (Filter("customer", "c_mktsegment", ("x",)),)).unfiltered == ["customer.c_mktsegment"]
    assert refresh(service, Card(card.sql, {"orders": "0" * 16})).changed == ["orders"]
    with pytest.raises(ValueError):
        pin(service, "SELECT s_acctbal FROM supplier")


def test_sharing(spark, service):
    check = lambda q: policy.check(spark, STAR, q).columns
    shared = {("orders", "o_orderkey")}
    assert rows_shareable(check("SELECT o_orderkey FROM orders"), STAR, shared)
    assert rows_shareable(check("SELECT COUNT(*) FROM orders"), STAR, shared)
    assert not rows_shareable(check("SELECT o_orderkey FROM orders WHERE o_totalprice > 1"), STAR, shared)
    assert not rows_shareable(check("SELECT * FROM orders"), STAR, shared)


def test_cache():
    now, calls = [0.0], []

    def compute(key):
        calls.append(key)
        if len(calls) == 3:
            raise RuntimeError
        return len(calls)

    c = StatisticsCache(compute, 10, lambda: now[0])
    assert (c.get("t"), c.get("t")) == (1, 1)
    now[0] = 11
    assert c.get("t") == 2
    now[0] = 22
    assert c.get("t") == 2 and c.get("t") == 4
