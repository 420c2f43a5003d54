import datetime as dt

import pytest
from fixtures import blog
from pyspark.sql import functions as F

from tesseral.client import Client
from tesseral.errors import ConflictError, QueryError, SchemaError
from tesseral.sources.store import Transaction, VersionedStore


@pytest.fixture
def db(spark, tmp_path):
    return Client(blog(), VersionedStore(spark, str(tmp_path)))


def seed(db):
    a = db.users.create({"email": "a@x", "name": "Alpha", "posts": {"create": [{"title": "one"}, {"title": "two"}]}})
    b = db.users.create({"email": "b@x", "name": "beta"})
    return a, b


def titles(db, where=None):
    return sorted(r["title"] for r in db.posts.find_many(where).collect())


def test_create_fills_keys_defaults_and_times(db):
    a, _ = seed(db)
    assert a["id"].startswith("user_")
    assert isinstance(a["createdAt"], dt.datetime)
    posts = db.posts.rows(db.posts.find_many({"author": {"email": "a@x"}}, order_by={"title": "asc"}))
    assert [(p["title"], p["status"], p["views"], p["published"]) for p in posts] == [("one", "draft", 0, False), ("two", "draft", 0, False)]
    assert db.users.create({"email": "c@x"}, return_created=False).keys() == {"id"}
    assert db.users.create({"email": "d@x", "posts": {"create": {"title": "x"}}}, include={"posts": {"select": ["title"]}})["posts"] == [{"title": "x"}]


def test_create_many(db):
    assert db.tags.create_many([]) == 0
    assert db.tags.create_many([{"slug": "a"}, {"id": 7, "slug": "b"}, {"slug": "c"}]) == 3
    assert sorted((r["id"], r["slug"]) for r in db.tags.find_many().collect()) == [(1, "a"), (7, "b"), (8, "c")]
    assert [r["slug"] for r in db.tags.create_many_and_return([{"slug": "z"}, {"slug": "y"}])] == ["z", "y"]
    with pytest.raises(SchemaError, match="createMany does not support"):
        db.posts.create_many([{"title": "x", "tags": {"create": []}}])


def test_bulk_insert_from_dataframe(db, spark):
    assert db.tags.create_many(spark.range(100).select(F.concat(F.lit("s"), "id").alias("slug")).repartition(3)) == 100
    assert sorted(r["id"] for r in db.tags.find_many().collect()) == list(range(1, 101))
    assert db.tags.create({"slug": "next"})["id"] == 101
    users = spark.range(5).select(F.concat(F.lit("u"), "id").alias("email"))
    assert db.users.create_many(users) == 5
    assert db.users.find_many().select("id").distinct().count() == 5
    with pytest.raises(QueryError) as e:
        db.users.create_many(users)
    assert e.value.code == "23505"


@pytest.mark.parametrize(
    ("table", "row", "code"),
    [
        ("users", {"name": "x"}, "23502"),
        ("users", {"email": "a@x"}, "23505"),
        ("posts", {"title": "x", "authorId": "nobody"}, "23503"),
        ("tags", {"slug": None}, "23502"),
    ],
)
def test_constraints(db, table, row, code):
    seed(db)
    with pytest.raises(QueryError) as e:
        db.table(table).create(row)
    assert e.value.code == code


def test_enum_check(db):
    a, _ = seed(db)
    with pytest.raises(QueryError) as e:
        db.posts.create({"title": "x", "authorId": a["id"], "status": "zzz"})
    assert e.value.code == "23514"
    assert titles(db) == ["one", "two"]


def test_update(db):
    a, b = seed(db)
    assert db.posts.update({"title": "one"}, {"views": 5, "price": "1.25"}, return_updated=True)["price"] == "1.25"
    assert db.posts.update({"title": "zzz"}, {"views": 1}) is None
    assert db.posts.update({"title": "two"}, {"views": 1}) == {}
    assert db.posts.update_many({"status": "archived"}, {"author": {"name": "Alpha"}}) == 2
    assert db.posts.update_many({"title": "same"}, {"title": {"in": []}}) == 0
    before = db.users.rows(db.users.find_by_id(a["id"]))[0]
    after = db.users.update_by_id(a["id"], {"name": "New", "updatedAt": "2001-01-01T00:00:00"}, return_updated=True)
    assert after["updatedAt"] > before["updatedAt"]
    assert after["createdAt"] == before["createdAt"]
    with pytest.raises(SchemaError, match="requires a where"):
        db.users.update({}, {"name": "x"})
    with pytest.raises(SchemaError, match="at least one scalar"):
        db.users.update({"email": "a@x"}, {"id": "zzz"})
    with pytest.raises(QueryError) as e:
        db.users.update({"email": "b@x"}, {"email": "a@x"})
    assert e.value.code == "23505"
    assert db.users.count({"email": "b@x"}) == 1


def test_update_acts_only_where_the_predicate_is_true(db):
    a, _ = seed(db)
    db.posts.update({"title": "one"}, {"body": "text"})
    assert db.posts.update_many({"views": 9}, {"body": {"notIn": ["zzz"]}}) == 1
    assert db.posts.delete_many({"NOT": {"body": "text"}}) == 0
    assert titles(db) == ["one", "two"]


def test_delete_actions(db):
    a, b = seed(db)
    with pytest.raises(QueryError) as e:
        db.users.delete({"email": "a@x"})
    assert e.value.code == "23503"
    post = db.posts.rows(db.posts.find_many({"title": "one"}))[0]
    db.comments.create({"postId": post["id"], "authorId": b["id"], "body": "hi"})
    db.profiles.create({"userId": b["id"], "bio": "b"})
    assert db.users.delete_by_id(b["id"], return_deleted=True)["email"] == "b@x"
    assert db.profiles.count() == 0
    assert db.comments.rows(db.comments.find_many())[0]["authorId"] is None
    assert db.posts.delete({"title": "one"}) == {}
    assert db.comments.count() == 0
    assert db.posts.delete({"title": "one"}) is None
    assert db.posts.delete_many() == 1
    with pytest.raises(SchemaError, match="Delete requires a where"):
        db.users.delete({})


def test_upsert_and_find_or_create(db):
    seed(db)
    made = db.users.upsert({"email": "c@x"}, {"name": "first"}, {"name": "second"})
    assert made["name"] == "first"
    again = db.users.upsert({"email": "c@x"}, {"name": "create"}, {"name": "update"})
    assert (again["name"], again["id"]) == ("create", made["id"])
    assert db.users.find_or_create({"email": "c@x"}, {"name": "no"})["created"] is False
    got = db.users.find_or_create({"email": "d@x"}, {"name": "yes"}, include={"posts": True})
    assert got["created"] and got["record"]["posts"] == []
    with pytest.raises(SchemaError, match="requires a unique"):
        db.users.upsert({"name": "x"}, {}, {})


def test_many_to_many_writes(db):
    a, _ = seed(db)
    post = db.posts.create({"title": "three", "authorId": a["id"], "tags": {"create": [{"slug": "x"}, {"slug": "y"}]}})
    db.posts.update_by_id(post["id"], {"tags": {"connectOrCreate": [{"where": {"slug": "x"}, "create": {}}, {"where": {"slug": "z"}, "create": {}}]}})
    slugs = lambda: [t["slug"] for t in db.posts.rows(db.posts.find_by_id(post["id"], include={"tags": {"orderBy": {"slug": "asc"}}}))[0]["tags"]]
    assert slugs() == ["x", "y", "z"]
    db.posts.update_by_id(post["id"], {"tags": {"disconnect": {"slug": "x"}}})
    assert slugs() == ["y", "z"]
    db.posts.update_by_id(post["id"], {"tags": {"connect": [{"slug": "x"}, {"slug": "y"}]}})
    assert slugs() == ["x", "y", "z"]
    db.posts.update_by_id(post["id"], {"tags": {"set": [{"slug": "z"}]}})
    assert slugs() == ["z"]
    assert db.tags.rows(db.tags.find_many({"slug": "z"}, include={"posts": {"select": ["title"]}}))[0]["posts"] == [{"title": "three"}]
    db.posts.update_by_id(post["id"], {"tags": {"delete": True}})
    assert slugs() == []
    assert db.tags.count() == 2
    assert db.posts.count({"tags": {"some": {}}}) == 0


def test_has_many_and_one_writes(db):
    a, b = seed(db)
    one = db.posts.rows(db.posts.find_many({"title": "one"}))[0]["id"]
    db.users.update_by_id(b["id"], {"posts": {"connect": {"id": one}, "create": {"title": "new"}}})
    assert titles(db, {"author": {"email": "b@x"}}) == ["new", "one"]
    with pytest.raises(SchemaError, match="Cannot disconnect relation"):
        db.users.update_by_id(b["id"], {"posts": {"disconnect": True}})
    db.users.update_by_id(b["id"], {"posts": {"delete": [{"id": one}]}})
    assert titles(db) == ["new", "two"]
    db.users.update_by_id(b["id"], {"profile": {"create": {"bio": "hello"}}})
    assert db.users.rows(db.users.find_by_id(b["id"], include={"profile": True}))[0]["profile"]["bio"] == "hello"
    with pytest.raises(SchemaError, match="Cannot create more than one"):
        db.users.update_by_id(a["id"], {"profile": {"create": [{"bio": "1"}, {"bio": "2"}]}})
    db.posts.update({"title": "two"}, {"author": {"connect": {"email": "b@x"}}})
    assert titles(db, {"author": {"email": "b@x"}}) == ["new", "two"]
    with pytest.raises(SchemaError, match="Cannot disconnect relation"):
        db.posts.update({"title": "two"}, {"author": {"disconnect": True}})
    c = db.comments.create({"body": "c", "post": {"connect": {"id": db.posts.rows(db.posts.find_first())[0]["id"]}}, "author": {"create": {"email": "new@x"}}})
    assert db.comments.update_by_id(c["id"], {"author": {"disconnect": True}}, return_updated=True)["authorId"] is None


def test_transactions(db):
    seed(db)
    with pytest.raises(RuntimeError), db.transaction():
        db.tags.create({"slug": "gone"})
        assert db.tags.count() == 1
        raise RuntimeError
    assert db.tags.count() == 0
    with db.transaction(isolation="serializable"):
        db.tags.create({"slug": "kept"})
        with pytest.raises(RuntimeError), db.transaction():
            db.tags.create({"slug": "inner"})
            raise RuntimeError
        with pytest.raises(QueryError):
            db.tags.create({"slug": "kept"})
        with pytest.raises(QueryError, match="nested"), db.transaction(read_only=True):
            pass
        with pytest.raises(QueryError, match="Cannot connect inside"):
            db.connect()
    assert [r["slug"] for r in db.tags.find_many().collect()] == ["kept"]
    with pytest.raises(QueryError, match="read-only"), db.transaction(read_only=True):
        db.tags.create({"slug": "no"})
    assert db.batch([lambda d: d.tags.create({"slug": "b1"})["slug"], lambda d: d.tags.count()]) == ["b1", 2]
    db.connect()
    db.disconnect()


def test_writers_conflict_and_vacuum(db):
    seed(db)
    late = Transaction(db.source)
    db.tags.create({"slug": "first"})
    late.now.notes["x"] = 1
    with pytest.raises(ConflictError):
        late.commit()
    db.posts.update({"title": "one"}, {"title": "uno"})  # leaves a file that no commit lists any longer
    before = titles(db)
    assert db.source.vacuum() > 0
    assert titles(db) == before
    assert db.source.vacuum() == 0


def test_vacuum_of_the_root_leaves_tenants_alone(spark, tmp_path):
    root, tenant = (Client(blog(), VersionedStore(spark, str(tmp_path), t)) for t in (None, "acme"))
    seed(root)
    seed(tenant)
    tenant.tags.create({"slug": "theirs"})
    root.posts.update({"title": "one"}, {"title": "uno"})
    assert root.source.vacuum() > 0
    assert titles(root) == ["two", "uno"]
    assert titles(tenant) == ["one", "two"]
    assert [r["slug"] for r in tenant.tags.find_many().collect()] == ["theirs"]
    assert root.tags.count() == 0
    tenant.posts.update({"title": "two"}, {"title": "due"})
    assert tenant.source.vacuum() > 0
    assert (titles(tenant), titles(root)) == (["due", "one"], ["two", "uno"])


def test_paths_with_odd_characters(spark, tmp_path):
    db = Client(blog(), VersionedStore(spark, f"{tmp_path}/a store #1 50%"))
    seed(db)
    assert db.posts.update_many({"title": "new"}, {"title": "one"}) == 1
    assert db.posts.delete_many({"title": "two"}) == 1
    assert titles(db) == ["new"]


def test_two_writers_and_no_half_commits(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    first, second = Transaction(store), Transaction(store)
    first.now.notes["by"] = "first"
    second.now.notes["by"] = "second"
    first.commit()
    with pytest.raises(ConflictError):
        second.commit()
    assert store.state().notes == {"by": "first"}
    assert [f for f in (tmp_path / "_commits").iterdir() if f.suffix == ".tmp"] == []


def test_updates_rewrite_only_files_with_matches(db):
    seed(db)
    table = db.manifest.table("users")
    old = set(db.source.state().files[table.storage])
    db.users.update({"email": "a@x"}, {"name": "changed"})
    new = set(db.source.state().files[table.storage])
    assert len(old & new) == 1


def test_raw_sql_and_builder(db):
    seed(db)
    from tesseral.operators.rawsql import identifier, sql

    assert [r[0] for r in db.sql("SELECT title FROM posts WHERE title = {}", "one").collect()] == ["one"]
    assert db.sql("SELECT * FROM {} WHERE {}", identifier("users"), sql("email = {} OR email = {}", "a@x", "'; DROP TABLE users; --")).count() == 1
    assert db.execute("SELECT '$1' AS lit, $2 AS b, $1 AS a", ["x", 5]).collect()[0].asDict() == {"lit": "$1", "b": 5, "a": "x"}
    got = db.select_from("posts").inner_join("users", "posts.author_id", "users.id").select("users.email", "posts.title").order_by("posts.title", "desc").frame().collect()
    assert [tuple(r) for r in got] == [("a@x", "two"), ("a@x", "one")]
    got = db.select_from("users").left_join("posts", "users.id", "posts.author_id").group_by("users.email").agg(n=F.count("posts.id")).order_by("email").frame().collect()
    assert [tuple(r) for r in got] == [("a@x", 2), ("b@x", 0)]
