import pytest

from quernel.llm.canonical import question_key as q
from quernel.llm.canonical import statement_key as s

SAME = [
    ("What was the revenue?", "  WHAT was the\n​revenue ?!"),
    ("Compare, please.", "compare please…"),
    ("“Größe” pro Straße?", "GRÖSSE PRO STRASSE？"),
    ("a, b / c", "a ,b / c"),
    ("leave out everything under 99.9.", "leave out everything under 99.9??"),
    ("on December 1, 2025", "on December 1,: 2025"),
    ("why – is it so", "why is it so"),
    ("measure: x y; group: z; period: 2025-12-01", "Period : 2025-12-01 / group:z / measure: X  y"),
    ("measure: x | group: z", "group: z\nmeasure: x"),
    ("only above: 40; a: b", "a: b;  only\nabove :40"),
    ("l’importo", "l'importo"),
    ("> list it", "- List it!"),
    ("(list it)", "*list it*"),
    ("(a: 1; b: 2)", "b: 2 | a: 1"),
    ("*¿Cuáles son?*", "¿cuáles son?"),
    ("* one thing", "one thing"),
]
OTHER = [
    ("above -5", "above 5"),
    ("a > b", "a < b"),
    ("list (it)", "list it"),
    ("(a) or (b)", "a or b"),
    ("a - b", "a b"),
    ("a * b", "a b"),
    ("-5 or more", "5 or more"),
    ("12.5", "125"),
    ("2025-12-01", "2025 12 01"),
    ("build 4.15.615", "build 415615"),
    ("1,000", "1 000"),
    ("SO-2512-1", "SO25121"),
    ("a b", "b a"),
    ("products.sku", "products sku"),
    ("c569@v17", "c569 v17"),
    ("x: a b", "b: a x"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_question(a, b):
    assert q(a) == q(b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_question(a, b):
    assert q(a) != q(b)


def test_question_edges():
    assert q(None) is None and q("") == q("  ​") == "" == q("?!")
    long = "wort, " * 20_000
    assert q(long) == " ".join(["wort"] * 20_000)


SQL_SAME = [
    ("SELECT a, SUM(b) AS x FROM t WHERE p = 1 AND q = 'Z' GROUP BY a", 'select sum("b") as x ,\n a from t where q=\'Z\' and\tp=1 group by a;'),
    ("select `a` from t", "SELECT a FROM t -- note\n ;"),
    ("select a from t join u on t.x = u.x and t.y = u.y", "select a from t join u on t.y=u.y AND t.x=u.x"),
    ("select a from t where x between 1 and 2 and y = 3", "select a from t where y = 3 and x between 1 and 2"),
    ("select a from t where (p and q) or r", "select a from t where (q and p) or r"),
    ("select a from (select b, c from u) t", "select a from (select c, b from u) t"),
    ("select case when p and q then 1 end from t", "select case when q and p then 1 end from t"),
    ("select distinct a, b from t", "select distinct b, a from t"),
    ("select [a], t.[b] from [t] order by a", "select t.b, a from t order by a"),
    ("select a from t where exists (select b, c from u) and (p = 1)", "select a from t where exists (select c, b from u) and (p = 1)"),
    ("with x as (select a, b from t) select a from x order by a limit 1", "with x as (select b, a from t) select a from x order by a limit 1"),
    ("select a from (select b, c from u) t join (select d, e from w) v on t.b = v.d", "select a from (select c, b from u) t join (select e, d from w) v on t.b = v.d"),
]
SQL_OTHER = [
    ("select a from t where x = 'Open'", "select a from t where x = 'open'"),
    ("select a from t where x = 'a  b'", "select a from t where x = 'a b'"),
    ("select a from t group by a, b", "select a from t group by b, a"),
    ("select a from t where x between 1 and 2", "select a from t where x between 2 and 1"),
    ("select a from t where p or q", "select a from t where q or p"),
    ("select a from t where a - b > 0", "select a from t where b - a > 0"),
    ("select a from t where x > 1.5", "select a from t where x > 15"),
    ("select a from t where x <> 1", "select a from t where x != 1"),
    ("select f(a, b) from t", "select f(b, a) from t"),
    ("select a from t order by a", "select a from t order by a desc"),
    ("select count(a) from t", "select count(distinct a) from t"),
    ("select x[i] from t", "select x i from t"),
    ("select f(x)[i] from t", "select f(x) i from t"),
    ("select a, b from t order by 1", "select b, a from t order by 1"),
    ("select a, b from t order by a, 2 desc", "select b, a from t order by a, 2 desc"),
    ("select a, b from t group by 1", "select b, a from t group by 1"),
    ("select a, b from t union select c, d from u", "select b, a from t union select c, d from u"),
    ("(select a, b from t) except (select c, d from u)", "(select b, a from t) except (select c, d from u)"),
    ("select x from (select a, b from t) as v (x, y)", "select x from (select b, a from t) as v (x, y)"),
    ("with v (x, y) as (select a, b from t) select x from v", "with v (x, y) as (select b, a from t) select x from v"),
    ("select p from t where (a, b) in (select c, d from u)", "select p from t where (a, b) in (select d, c from u)"),
    ("insert into v select a, b from t", "insert into v select b, a from t"),
]


@pytest.mark.parametrize(("a", "b"), SQL_SAME)
def test_same_statement(a, b):
    assert s(a) == s(b)


@pytest.mark.parametrize(("a", "b"), SQL_OTHER)
def test_other_statement(a, b):
    assert s(a) != s(b)


def test_statement_edges():
    assert s(None) is None and s("") == s(" ; ") == ""
    assert s("select (a from t") == "select ( a from t"
    assert s("select a) from t")
    assert s("case select , and or between") is not None
