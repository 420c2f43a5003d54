import decimal

import pytest
from fixtures import PEOPLE, people
from pyspark.sql import types as T

from tesseral.client import Client
from tesseral.errors import SchemaError, UnknownColumnError
from tesseral.operators.cursor import decode_cursor, encode_cursor
from tesseral.sources.catalog import MemorySource


@pytest.fixture(scope="module")
def db(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("id", T.IntegerType()), ("name", T.StringType()), ("age", T.IntegerType()), ("score", T.DecimalType(10, 2)), ("meta", T.StringType()), ("manager_id", T.IntegerType()))])
    rows = [(i, n, a, decimal.Decimal(s) if s else None, m, b) for i, n, a, s, m, b in PEOPLE]
    return Client(people(), MemorySource(spark, {"people": spark.createDataFrame(rows, schema).cache()}))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ({}, [1, 2, 3, 4, 5, 6]),
        ({"age": 25}, [3, 4]),
        ({"age": None}, [2]),
        ({"age": {"equals": None}}, []),
        ({"age": {"gte": 25, "lt": 40}}, [1, 3, 4]),
        ({"age": {"in": [25, 40]}}, [3, 4, 5]),
        ({"age": {"in": []}}, []),
        ({"age": {"notIn": [25, 40]}}, [1, 6]),
        ({"age": {"notIn": []}}, [1, 2, 3, 4, 5, 6]),
        ({"age": {"isNull": False}}, [2]),
        ({"age": {"isNotNull": True}}, [1, 3, 4, 5, 6]),
        ({"name": {"contains": "O"}}, [2, 3]),
        ({"name": {"startsWith": "a"}}, [1]),
        ({"name": {"endsWith": "L"}}, [3]),
        ({"name": {"contains": "%_"}}, [1, 2, 3, 6]),
        ({"name": {"contains": "\\"}}, [6]),
        ({"name": {"endsWith": "\\"}}, [6]),
        ({"NOT": {"age": 25}}, [1, 5, 6]),
        ({"NOT": {}}, [1, 2, 3, 4, 5, 6]),
        ({"OR": []}, [1, 2, 3, 4, 5, 6]),
        ({"OR": [{"age": 30}, {"name": "bob"}]}, [1, 2]),
        ({"AND": [{"age": 25}, {}, {"name": ""}]}, [4]),
        ({"OR": [{"age": {"in": []}}, {"id": 1}]}, [1]),
        ({"score": "2.00"}, [2, 4]),
        ({"score": {"gt": 2}}, [5]),
        ({"meta": {"hasKey": "role"}}, [1, 2, 5, 6]),
        ({"meta": {"hasAnyKeys": ["tags", "zz"]}}, [1, 2]),
        ({"meta": {"hasAllKeys": ["role", "x"]}}, [5]),
        ({"meta": {"path": {"segments": ["role"], "equals": "user"}}}, [2, 6]),
        ({"meta": {"path": {"segments": ["role') or ('1'='1"], "equals": "user"}}}, []),
        ({"meta": {"path": {"segments": ["tags", "1"], "equals": "b"}}}, [1]),
        ({"meta": {"path": {"segments": ["n"], "jsonContains": {"x": 1}}}}, [1, 6]),
        ({"meta": {"jsonContains": {"n": {"x": 1}}}}, [1, 6]),
        ({"meta": {"jsonContains": {"n": None}}}, [2]),
        ({"meta": {"jsonContains": {"tags": ["b"]}}}, [1]),
        ({"meta": {"jsonContains": ["x"]}}, [5]),
        ({"meta": {"jsonContains": "x"}}, [5]),
        ({"meta": {"jsonContains": {}}}, [1, 2, 6]),
        ({"meta": {"equals": {"n": {"y": [1, 2], "x": 1.0}, "role": "user"}}}, [6]),
        ({"manager": {"name": "Ann"}}, [2, 3]),
        ({"manager": None}, [1]),
        ({"reports": {"some": {"age": 25}}}, [1, 2]),
        ({"reports": {"none": {"age": 25}}}, [3, 4, 5, 6]),
        ({"reports": {"every": {"age": 25}}}, [1, 3, 4, 6]),
        ({"reports": {"every": {}}}, [1, 2, 3, 4, 5, 6]),
        ({"reports": {"some": {"reports": {"some": {"id": 6}}}}}, [2]),
        ({"OR": [{"id": 6}, {"reports": {"some": {"id": 3}}}]}, [1, 6]),
        ({"NOT": {"manager": {"manager": {"id": 1}}}}, [1, 2, 3, 6]),
        ({"reports": {"some": {}, "none": {"age": 40}}}, [1, 5]),
    ],
)
def test_where(db, where, expected):
    assert ids(db.people.find_many(where)) == expected
    assert db.people.count(where) == len(expected)


def test_unknown_keys_are_errors(db):
    with pytest.raises(UnknownColumnError):
        db.people.find_many({"nope": 1})
    with pytest.raises(UnknownColumnError):
        db.people.find_many(order_by={"nope": "asc"})
    with pytest.raises(AttributeError):
        db.nope.find_many()


def test_order_limit_offset(db):
    got = [r["id"] for r in db.people.find_many(order_by={"age": "asc", "id": "desc"}).collect()]
    assert got == [6, 4, 3, 1, 5, 2]
    got = [r["id"] for r in db.people.find_many(order_by={"age": "desc", "id": "asc"}, limit=3, offset=1).collect()]
    assert got == [5, 1, 3]
    assert db.people.find_many(take=2).count() == 2
    for bad in (-1, "1; drop", 1.5, True):
        with pytest.raises(SchemaError, match="limit must be"):
            db.people.find_many(limit=bad)


def test_first_unique_by_id(db):
    assert db.people.find_first(order_by={"age": "asc"}).collect()[0]["id"] == 6
    assert db.people.find_by_id(3).collect()[0]["name"] == "CAROL"
    assert db.people.find_unique({"id": 2}).count() == 1
    with pytest.raises(SchemaError, match="requires a unique"):
        db.people.find_unique({"age": 2})
    with pytest.raises(SchemaError, match="Missing primary key"):
        db.people.find_by_id({})


def test_distinct(db):
    got = [r["id"] for r in db.people.find_many(distinct=["age"], order_by={"age": "asc", "id": "desc"}).collect()]
    assert sorted(got) == [1, 2, 4, 5, 6]
    with pytest.raises(SchemaError, match="distinct requires orderBy"):
        db.people.find_many(distinct=["age"], order_by={"name": "asc"})


def test_aggregate(db):
    got = db.people.aggregate({"age": 25}, _count=True, _avg=["age"], _min=["score", "nope"], _max={"id": True}, _sum=["age"])
    assert got == {"_count": 2, "_avg": {"age": 25.0}, "_sum": {"age": 50}, "_min": {"score": decimal.Decimal("2.00")}, "_max": {"id": 4}}
    assert db.people.aggregate({"age": {"in": []}}, _count=True, _avg=["age"]) == {"_count": 0, "_avg": {"age": None}}
    with pytest.raises(SchemaError, match="at least one selector"):
        db.people.aggregate()


def test_include(db):
    rows = {r["id"]: r for r in db.people.rows(db.people.find_many(include={"manager": {"select": ["name"]}, "reports": {"orderBy": {"age": "desc"}, "limit": 1, "with": {"reports": True}}, "_count": {"reports": True}}))}
    assert rows[2]["manager"] == {"name": "Ann"}
    assert rows[1]["manager"] is None
    assert [r["id"] for r in rows[1]["reports"]] == [2]
    assert [r["id"] for r in rows[1]["reports"][0]["reports"]] == [4, 5]
    assert rows[3]["reports"] == []
    assert rows[1]["_count"] == {"reports": 2}
    assert rows[6]["_count"] == {"reports": 0}


def test_include_for_limited_parents_and_counts(db):
    got = db.people.rows(db.people.find_many(order_by={"_count": {"reports": "desc"}, "id": "asc"}, limit=2, include={"reports": True, "_count": {"reports": {"where": {"age": 25}}}}))
    assert [(r["id"], [x["id"] for x in r["reports"]]) for r in got] == [(1, [2, 3]), (2, [4, 5])]
    got = db.people.rows(db.people.find_many({"id": 1}, include={"_count": {"reports": {"where": {"age": 25}}}}))
    assert got[0]["_count"] == {"reports": 1}
    assert "manager" not in db.people.find_many(include={"manager": False}).columns


def test_paginate(db):
    seen, after, sizes = [], None, []
    while True:
        page = db.people.paginate({"id": "desc"}, 4, after=encode_cursor(after) if after else None)
        seen += [r["id"] for r in page.items]
        sizes.append((len(page.items), page.has_more))
        after = page.next_cursor
        if after is None:
            break
    assert seen == [6, 5, 4, 3, 2, 1]
    assert sizes == [(4, True), (2, False)]
    page = db.people.paginate({"age": "asc"}, 2, {"age": {"isNotNull": True}})
    assert [r["id"] for r in page.items] == [6, 3]
    page = db.people.paginate({"age": "asc"}, 3, {"age": {"isNotNull": True}}, after=page.next_cursor)
    assert [r["id"] for r in page.items] == [4, 1, 5]


def test_paginate_errors(db):
    for args, words in ((({"id": "asc"}, 0), "paginate requires take"), ((None, 1), "paginate requires orderBy"), (({"id": "asc", "age": "desc"}, 1), "share one direction"), (({"zz": "asc"}, 1), "Unknown orderBy column")):
        with pytest.raises(SchemaError, match=words):
            db.people.paginate(*args)
    with pytest.raises(SchemaError, match="Cursor missing"):
        db.people.paginate({"id": "asc"}, 1, after={})


def test_cursor_codec():
    assert decode_cursor(encode_cursor({"id": 1, "t": "é"})) == {"id": 1, "t": "é"}
    assert encode_cursor({"id": 1}) == "eyJ2IjoxLCJjIjp7ImlkIjoxfX0"
    for bad in ("***", "e30", encode_cursor({})[:-3]):
        with pytest.raises(SchemaError, match="Invalid cursor"):
            decode_cursor(bad)
