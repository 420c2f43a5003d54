import datetime as dt
import json

import pytest
from fixtures import blog

from tesseral import cli
from tesseral.client import Client
from tesseral.errors import MigrationError, QueryError, SchemaError
from tesseral.functions.ids import prefixed_id, uuid_v7
from tesseral.functions.kinds import Kind, kinds, register_kind, unregister_kind
from tesseral.plans.diff import castable, dangers, diff, resolve_dangers
from tesseral.plans.introspect import schema_source
from tesseral.plans.manifest import Manifest
from tesseral.plans.migrate import Migrations, Migrator
from tesseral.schema import bigint, camel_case, citext, column, decimal, define_schema, enum, fk, id_, int_, primary_key, snake_case, table, text, timestamp, unique, uuid
from tesseral.sources.store import VersionedStore


def test_names_and_relations():
    m = blog().to_manifest()
    assert m.table("postTags").storage == "post_tags"
    assert m.table("posts").column("authorId").storage == "author_id"
    assert {n: (r.kind, r.cardinality) for n, r in m.table("posts").relations.items()} == {"author": ("owner", "one"), "comments": ("inverse", "many"), "postTags": ("inverse", "many"), "tags": ("m2m", "many")}
    assert m.table("users").relations["profile"].cardinality == "one"
    assert Manifest.from_json(m.to_json()) == m
    assert snake_case("createdAt") == "created_at" and camel_case("created_at") == "createdAt"
    s = define_schema(t=table("t", id=id_(), someName=text().map("some_name"), other=text().map("o")))
    assert len(s.redundant_maps()) == 1


@pytest.mark.parametrize(
    "make",
    [
        lambda: define_schema(a=table("t", id=id_()), b=table("t", id=id_())),
        lambda: define_schema(a=table("t", id=id_(), x=fk("nope.id"))),
        lambda: define_schema(a=table("t", id=id_(), x=fk("t.nope"))),
        lambda: define_schema(a=table("t", id=column("nokind"))),
        lambda: define_schema(a=table("t", id=id_(), x=text().updated_at())),
        lambda: define_schema(a=table("t", primary_key("id", "zz"), id=id_())),
        lambda: fk("x", on_delete="explode") and None,
    ],
)
def test_invalid_schemas(make):
    with pytest.raises(SchemaError):
        make().to_manifest()


def test_foreign_keys_take_their_targets_type():
    m = define_schema(a=table("a", id=bigint().primary()), b=table("b", id=fk("a").primary()), c=table("c", id=id_(), bId=fk("b", as_="b"))).to_manifest()
    assert m.table("c").column("bId").data_type.simpleString() == "bigint"


def test_ids():
    a, b = uuid_v7(1000), uuid_v7(1001)
    assert a < b and a[14] == "7" and a[19] in "89ab"
    assert prefixed_id("posts").startswith("post_") and prefixed_id("categories").startswith("cate_")


def test_custom_kinds(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from tesseral.sources.catalog import MemorySource

    register_kind(Kind("money", lambda o: T.LongType(), lambda v: round(float(v) * 100), {"cheaper": lambda c, v, o: c < F.lit(v) * 100}, select=lambda c, o: c / 100))
    with pytest.raises(SchemaError, match="already registered"):
        register_kind(Kind("money", lambda o: T.LongType()))
    with pytest.raises(SchemaError):
        unregister_kind("text")
    db = Client(define_schema(t=table("t", id=int_().primary(), price=column("money"))), MemorySource(spark, {"t": spark.createDataFrame([(1, 150), (2, 900)], "id int, price long")}))
    assert [tuple(r) for r in db.t.find_many({"price": {"cheaper": 5}}).collect()] == [(1, 1.5)]
    assert db.t.count({"price": "9.00"}) == 1
    unregister_kind("money")
    assert "money" not in kinds()


def test_citext_and_spatial(spark):
    from tesseral.schema import geography, geometry
    from tesseral.sources.catalog import MemorySource

    square = '{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]]]}'
    rows = [(1, "Ann@X", '{"type":"Point","coordinates":[5,5]}'), (2, "bob", '{"type":"Point","coordinates":[12,5]}'), (3, None, None), (4, "z", '{"type":"LineString","coordinates":[[-5,5],[15,5]]}'), (5, "y", square.replace("10", "3")), (6, "w", "no json")]
    df = spark.createDataFrame([(i, e, g, g) for i, e, g in rows], "id int, email string, place string, globe string")
    db = Client(define_schema(t=table("t", id=int_().primary(), email=citext(), place=geometry("Point"), globe=geography())), MemorySource(spark, {"t": df}))
    ids = lambda where: sorted(r["id"] for r in db.t.find_many(where).collect())
    assert ids({"email": "ann@x"}) == [1]
    assert ids({"place": {"within": json.loads(square)}}) == [1, 5]
    assert ids({"place": {"intersects": square}}) == [1, 4, 5]
    assert ids({"place": {"dWithin": {"geometry": square, "distance": 2}}}) == [1, 2, 4, 5]
    assert ids({"place": {"dWithin": {"geometry": {"type": "Point", "coordinates": [5, 6]}, "distance": 1.5}}}) == [1, 4]
    assert ids({"globe": {"dWithin": {"geometry": {"type": "Point", "coordinates": [5, 6]}, "distance": 120_000}}}) == [1]
    with pytest.raises(ValueError):
        ids({"place": {"dWithin": {"geometry": square, "distance": -1}}})
    assert db.manifest.extensions == ["citext", "postgis"]


def first():
    return define_schema(users=table("users", id=id_(), email=text().not_null(), age=text(), status=enum("a", "b")), old=table("old", id=id_()))


def second():
    return define_schema(
        users=table("users", unique("email"), id=id_(), email=text().not_null().map("mail"), age=int_(), status=enum("a", "b", "c"), score=decimal(10, 2).not_null().default("1.50"), madeAt=timestamp().default_now()),
        posts=table("posts", id=uuid(), userId=fk("users", as_="user", inverse="posts")),
    )


def test_diff_and_dangers():
    changes = diff(first().to_manifest(), second().to_manifest())
    kinds_ = [c.kind for c in changes]
    assert kinds_ == ["create_table", "rename_column", "add_column", "add_column", "alter_column", "alter_column", "add_index", "drop_table"]
    assert [d.kind for d in dangers(changes)] == ["alter_column_type", "drop_table"]
    allowed, blocked = resolve_dangers(changes)
    assert len(blocked) == 2 and len(allowed) == 6
    assert resolve_dangers(changes, True)[1] == []
    back = diff(second().to_manifest(), first().to_manifest())
    assert {"alter_enum_manual", "drop_column", "drop_index", "drop_table"} <= {d.kind for d in dangers(back)}
    assert resolve_dangers(back, True)[1][0].kind == "alter_enum_manual"
    assert castable("string", "int") and castable("decimal(10,2)", "string") and not castable("boolean", "int")
    assert diff(second().to_manifest(), second().to_manifest()) == []


def test_migrations(spark, tmp_path):
    store, folder = VersionedStore(spark, str(tmp_path / "store")), Migrations(str(tmp_path / "m"))
    migrator = Migrator(store, folder)
    with pytest.raises(MigrationError, match="No migration"):
        migrator.down()
    made = folder.generate(first(), "First one!", at=dt.datetime(2026, 1, 1, tzinfo=dt.UTC))
    assert (made.state, made.name) == ("migration_created", "20260101000000_first_one")
    assert folder.generate(first()).state == "unchanged"
    assert migrator.deploy() == [made.name]
    Client(first(), store).users.create_many([{"email": "a@x", "age": "41", "status": "a"}, {"email": "b@x", "age": None}])
    blocked = folder.generate(second(), "second", at=dt.datetime(2026, 1, 2, tzinfo=dt.UTC))
    assert {d.kind for d in blocked.blocked} == {"alter_column_type", "drop_table"}
    made = folder.generate(second(), "third", accept_data_loss=True, at=dt.datetime(2026, 1, 3, tzinfo=dt.UTC))
    assert migrator.status()["pending"] == [blocked.name, made.name]
    migrator.deploy()
    db = Client(second(), store)
    rows = sorted((r["email"], r["age"], r["score"]) for r in db.users.rows(db.users.find_many()))
    assert rows == [("a@x", 41, "1.50"), ("b@x", None, "1.50")]
    with pytest.raises(QueryError):
        db.users.create({"email": "a@x"})
    assert migrator.down(2) == [made.name, blocked.name]
    assert sorted(r["age"] or "" for r in Client(first(), store).users.find_many().collect()) == ["", "41"]
    with pytest.raises(MigrationError, match="Only 1"):
        migrator.down(5)
    with pytest.raises(MigrationError, match="force"):
        migrator.reset()
    assert len(migrator.reset(force=True)) == 3
    assert db.users.count() == 0
    with pytest.raises(MigrationError, match="Invalid migration name"):
        folder.generate(first(), "../..", accept_data_loss=True)


def test_push_and_pull(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    migrator = Migrator(store)
    done, blocked = migrator.push(blog())
    assert not blocked and any("create table posts" in d for d in done)
    namespace: dict = {}
    exec(schema_source(migrator.live()), namespace)
    again = namespace["schema"].to_manifest()
    assert diff(again, migrator.live()) == [] and diff(migrator.live(), again) == []
    assert migrator.push(namespace["schema"])[0] == []
    found = Manifest.from_spark({"some_table": spark.createDataFrame([(1, 2.0, ["x"])], "a long, b double, c array<string>")})
    assert [(c.name, c.kind) for c in found.table("someTable").columns] == [("a", "bigint"), ("b", "double"), ("c", "textArray")]


def test_cli(spark, tmp_path, capsys):
    config = str(tmp_path / "tesseral.json")
    run = lambda *a: cli.main(["--config", config, *a], spark)
    assert run("init") == 0
    assert run("migrate", "dev", "--name", "start") == 0
    assert run("migrate", "status") == 0
    assert "applied: 2" in capsys.readouterr().out
    assert run("db", "push") == 0
    assert run("db", "pull") == 0
    assert '"users": table(' in capsys.readouterr().out
    assert run("migrate", "down") == 0
    assert run("migrate", "down") == 1
    assert run("migrate", "reset", "--force") == 0
    (tmp_path / "tesseral.json").write_text('{"nope": 1}')
    assert run("db", "push") == 1
