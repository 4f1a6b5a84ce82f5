import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.errors import ValidationError
from quillon.functions import search
from quillon.operators import order, predicate, projection
from quillon.plans import query as plans
from quillon.spec import CollectionSpec

SCHEMA = "id string, n double, s string, b boolean, t array<string>, m struct<x: double, y: struct<z: string>>"
ROWS = [
    ("1", 1.0, "Dune", True, ["a", "b"], (1.0, ("p",))),
    ("2", None, "dune messiah", False, [], (None, (None,))),
    ("3", -2.5, None, None, None, None),
    ("4", 10.0, "", True, ["a", None], (3.0, None)),
    ("5", 9.0, "über die Düne", False, ["c"], (9.0, ("q",))),
]
OPS = ["$eq", "$ne", "$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$startsWith", "$endsWith", "$contains", "$all", "$size", "$search"]


def same(a, b):
    return (a is None and b is None) or (type(a) in (int, float) and type(b) in (int, float) and a == b) or (type(a) is type(b) and not isinstance(a, (list, dict)) and a == b)


def leaf(v, kind, cond):
    """The meaning of a condition on one value, written apart from the compiler."""
    if not isinstance(cond, dict):
        return same(v, cond)
    for op, x in cond.items():
        number = type(x) in (int, float)
        if op == "$eq":
            ok = same(v, x)
        elif op == "$ne":
            ok = not same(v, x)
        elif op in ("$in", "$nin"):
            ok = isinstance(x, list) and any(same(v, y) for y in x) == (op == "$in")
        elif op in ("$gt", "$gte", "$lt", "$lte"):
            if v is None or kind not in ("n", "s"):
                ok = False
            elif not (number if kind == "n" else isinstance(x, str)):
                ok = True
            else:
                ok = {"$gt": v > x, "$gte": v >= x, "$lt": v < x, "$lte": v <= x}[op]
        elif op in ("$startsWith", "$endsWith") or (op == "$contains" and kind != "t"):
            ok = True if kind != "s" else v is not None and isinstance(x, str) and {"$startsWith": v.startswith, "$endsWith": v.endswith, "$contains": v.__contains__}[op](x)
        elif op == "$search":
            ok = kind != "s" or v is None or not isinstance(x, str) or all(any(t.startswith(q) for t in search.tokenize(v)) for q in search.tokenize(x))
        elif kind != "t":
            ok = True
        elif op == "$size":
            ok = v is not None and type(x) is int and len(v) == x
        else:
            wanted = [x] if op == "$contains" else x
            ok = v is not None and isinstance(wanted, list) and all(any(same(e, y) for e in v) for y in wanted)
        if not ok:
            return False
    return True


def holds(row, where):
    for k, v in where.items():
        if k in ("$or", "$and"):
            ok = (any if k == "$or" else all)(holds(row, w) for w in v)
        elif k == "$not":
            ok = not holds(row, v)
        else:
            ok = k in row and leaf(row[k], k, v)
        if not ok:
            return False
    return True


VALUES = st.sampled_from([None, 1, 1.0, -2.5, 10, "", "Dune", "du", "a", True, False, "e"])
CONDITIONS = st.one_of(VALUES, st.fixed_dictionaries({}, optional={op: st.lists(VALUES, max_size=3) if op in ("$in", "$nin", "$all") else st.integers(0, 2) if op == "$size" else VALUES.filter(lambda v: v is not None) for op in OPS}).filter(lambda d: 0 < len(d) < 3))
LEAVES = st.dictionaries(st.sampled_from(["n", "s", "b", "t", "nowhere"]), CONDITIONS, max_size=2)
WHERES = st.recursive(LEAVES, lambda w: st.one_of(st.fixed_dictionaries({"$or": st.lists(w, max_size=2)}), st.fixed_dictionaries({"$and": st.lists(w, max_size=2)}), st.fixed_dictionaries({"$not": w})), max_leaves=4)


def test_random_conditions_hold_as_in_plain_python(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cases = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(WHERES, min_size=1, max_size=3))
    def gather(wheres):
        cases.extend(wheres)

    gather()
    cases = cases[:240]
    rows = df.select("id", *[predicate.where(df.schema, w).alias(f"c{i}") for i, w in enumerate(cases)]).collect()
    plain = {r[0]: dict(zip(("id", "n", "s", "b", "t", "m"), r, strict=True)) for r in ROWS}
    for r in rows:
        for i, w in enumerate(cases):
            assert r[f"c{i}"] == holds(plain[r.id], w), (w, r.id)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_paths_shapes_and_custom_operators(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    custom = {"$near": (None, lambda c, x: F.abs(c - F.lit(x)) < 2)}
    for where, want in (
        ({"m.x": 1}, ["1"]), ({"m": {"x": {"$gt": 1}}}, ["4", "5"]), ({"m": {"y": {"z": "q"}}}, ["5"]), ({"m": {}}, ["1", "2", "3", "4", "5"]), ({"t.0": "a"}, ["1", "4"]),
        ({"n": {"$near": 9}}, ["4", "5"]), ({"$search": {"query": "dune 1"}}, ["1"]), ({"$search": {"query": " "}}, ["1", "2", "3", "4", "5"]), ({"s": {"$search": "die ber"}}, ["3", "5"]),
        ({"$or": "x"}, []), ({"t": ["a"]}, []), ({"n": {"$gt": 9, "$lt": 11}}, ["4"]),
    ):
        assert ids(df.where(predicate.where(df.schema, where, custom))) == want, where


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    out = projection.select(df.where(predicate.where(df.schema, {"n": {"$gte": 1}, "s": "Dune"})), ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(n,1.0)" in plan and "EqualTo(s,Dune)" in plan or "EqualNullSafe(s,Dune)" in plan
    assert "ReadSchema: struct<id:string,n:double,s:string>" in plan


def test_projection(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert projection.select(df, ["id", "nowhere", "m.x"]).columns == ["id"]
    assert projection.select(df, []).columns == df.columns
    assert projection.select(df, {"m": {"y": {"z": True}}, "id": True, "s": False}).schema.simpleString() == "struct<m:struct<y:struct<z:string>>,id:string>"
    out = projection.computed(df, {"n": lambda: F.col("n") + 1, "twice": lambda: F.col("n") * 2})
    assert [(r.n, r.twice) for r in out.where("id = '1'").collect()] == [(2.0, 2.0)]
    assert projection.merge_selections({"a": True, "b": {"x": True}}, {"b": {"y": True}, "c": True}) == {"a": True, "b": {"x": True, "y": True}, "c": True}


def test_cursor_pages_cover_all_rows_once(spark):
    df = spark.createDataFrame([(str(i), float(i)) for i in range(7)], "id string, n double")
    seen, after = [], None
    while True:
        page = order.cursor_page(df, {"key": "n", "limit": 3, **({"after": after} if after is not None else {})})
        seen += [r.n for r in page.items.collect()]
        after = page.end_cursor
        if not page.has_next_page:
            break
    assert seen == list(map(float, range(7)))
    back = order.cursor_page(df, {"key": "n", "limit": 2, "before": 3.0})
    assert [r.n for r in back.items.collect()] == [1.0, 2.0] and back.has_next_page and back.has_previous_page
    text = order.cursor_page(spark.createDataFrame([("a", 9.0), ("b", 10.0)], "id string, n double"), {"key": "n", "limit": 5, "after": "10"}, mode="string")
    assert [r.n for r in text.items.collect()] == [9.0]
    empty = order.cursor_page(df, {"key": "n", "limit": 2, "after": 99.0})
    assert (empty.start_cursor, empty.has_next_page, empty.has_previous_page) == (None, False, False)
    for bad in ({"key": "n", "limit": 0}, {"key": "n", "limit": 1, "after": 1, "before": 2}, {"limit": 1}, {"key": "zz", "limit": 1}):
        with pytest.raises(ValidationError):
            order.cursor_page(df, bad)
    with pytest.raises(ValidationError):
        order.cursor_page(df, {"key": "n", "limit": 1}, {"id": "asc"})


def test_order(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "A"), ("3", None), ("4", "a"), ("5", "B")], "id string, s string")
    got = lambda **k: [r.s for r in order.sort(df, **k).collect()]
    assert got(order={"s": "asc"}) == ["A", "B", "a", "b", None]
    assert got(order={"s": "desc"}) == ["b", "a", "B", "A", None]
    assert got(order={"s": "asc"}, collation="UNICODE") == ["a", "A", "b", "B", None]
    assert order.paginate(df.orderBy("id"), -2, 2.9).count() == 2 and order.paginate(df, 3, 0).count() == 0


def test_tokens_and_scores(spark):
    texts = ["Gibson, William", "über die schön -x-", "  ", None, "The Left Hand of Darkness", "dune dunes"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, s string")
    rows = df.select("id", search.tokens(F.col("s")).alias("t"), search.score(F.col("s"), "left hand dune").alias("p")).orderBy("id").collect()
    assert [r.t for r in rows] == [None if t is None else search.tokenize(t) for t in texts]
    assert rows[1].t == ["ber", "die", "schön", "x"]
    assert rows[4].p == pytest.approx(2 / 3 * (1 + 2 / 5) / math.log(6)) and rows[5].p == pytest.approx(1 / 3 * (1 + 1.5 / 2) / math.log(3)) and rows[3].p == 0
    table = search.token_table(df, "id", ["s"])
    assert ids(search.lookup(table, "id", "d o")) == ["4"]


ODD = [
    "der", "(der", "x-der", "xder der", "der-der", "  der\tder\u00a0der\u3000(der)…", "\u0085der\u0085 der", "…" * 9 + "der", "a" + "§" * 9 + "der", "d'er der's derb, DER!",
    "漢字der 漢字 der漢字", "schön schöner -schön", "\ufeffder\u2028derb\u205f_der", "", " \n ", "…", None, "der " * 200 + "den", "1.5 der... ...", "ader\nder", "der §", "§ §der§ §",
]


def test_scores_and_matches_of_odd_texts(spark):
    def points(text, query):
        got, wanted = search.tokenize(text or ""), search.tokenize(query)
        hits = sum(any(t.startswith(q) for t in got) for q in wanted)
        frequency = sum(1.0 if t == q else 0.5 for q in wanted for t in got if t.startswith(q))
        return hits / len(wanted) * (1 + frequency / len(got)) / math.log1p(len(got)) if hits else 0.0

    df = spark.createDataFrame(list(enumerate(ODD)), "id int, s string")
    s = F.col("s")
    for query in ("der", "d", "der der", "der schön", "der's", "1.5 derb", "x-d", "漢der"):
        rows = df.select("id", search.tokens(s).alias("t"), search.score(s, query).alias("p"), search.matches(s, query).alias("m"), search.matches_any([s], query).alias("a")).orderBy("id").collect()
        for r, text in zip(rows, ODD, strict=True):
            has = all(any(t.startswith(q) for t in search.tokenize(text or "")) for q in search.tokenize(query))
            assert (r.t, r.m, r.a) == (None if text is None else search.tokenize(text), has or text is None, has), (query, text)
            assert r.p == pytest.approx(points(text, query)), (query, text)


def test_search_reads_and_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i, f"the {'th ' * (i % 7)} end") for i in range(400)], 4).map(lambda r: (seen.add(1), r)[1])
    frames = {"docs": spark.createDataFrame(rows, "id int, text string")}
    specs = {"docs": CollectionSpec(frames["docs"].schema)}
    out = plans.run("docs", {"where": {"$search": {"query": "the th", "fields": ["text"]}}}, specs, frames)
    found = out.collect()
    assert seen.value == 400
    assert [(r.id, r[plans.SCORE]) for r in found] == sorted([(r.id, r[plans.SCORE]) for r in found], key=lambda x: (-x[1], x[0])) and len(found) == 400
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 1


def test_best_rows_of_a_search_need_no_shuffle_and_one_list_of_tokens(spark):
    texts = ["under order", "wonder-", "(der", "der", "x-der", "derb der", None, "un der"]
    frames = {"docs": spark.createDataFrame(list(enumerate(texts)), "id int, text string")}
    out = plans.run("docs", {"where": {"$search": {"query": "der", "fields": ["text"]}}, "limit": 10}, {"docs": CollectionSpec(frames["docs"].schema)}, frames)
    assert [r.id for r in out.collect()] == [2, 3, 5, 7]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_") == 1
    # words around the query's token are ruled out by the pattern that begins with it
    assert 0 < plan.index(r"der(?<!\wder)") < plan.index(search.BEFORE)
