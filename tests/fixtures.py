"""Schemas and rows that the tests share."""

from tesseral.schema import bool_, decimal, define_schema, enum, fk, id_, index, int_, jsonb, many_to_many, primary_key, serial, table, text, timestamp


def blog():
    return define_schema(
        many_to_many("posts", "tags", "postTags", "tags", "posts"),
        users=table("users", id=id_(), email=text().not_null().unique(), name=text(), createdAt=timestamp().not_null().default_now(), updatedAt=timestamp().not_null().default_now().updated_at()),
        profiles=table("profiles", id=id_(), userId=fk("users.id", as_="user", inverse="profile", unique=True, nullable=False, on_delete="cascade"), bio=text(), avatarUrl=text()),
        posts=table(
            "posts",
            index("authorId"),
            id=id_(),
            authorId=fk("users.id", as_="author", inverse="posts", nullable=False, on_delete="restrict"),
            title=text().not_null(),
            body=text(),
            published=bool_().not_null().default(False),
            views=int_().not_null().default(0),
            status=enum("draft", "published", "archived").not_null().default("draft"),
            metadata=jsonb(),
            price=decimal(10, 2),
        ),
        comments=table("comments", id=id_(), postId=fk("posts.id", as_="post", inverse="comments", nullable=False, on_delete="cascade"), authorId=fk("users.id", as_="author", inverse="comments", nullable=True, on_delete="set null"), body=text().not_null()),
        tags=table("tags", id=serial().primary(), slug=text().not_null().unique()),
        postTags=table("post_tags", primary_key("postId", "tagId"), postId=fk("posts.id", as_="post", inverse="postTags", on_delete="cascade"), tagId=fk("tags.id", as_="tag", inverse="postTags", on_delete="cascade"), assignedBy=text()),
    )


def people():
    return define_schema(
        people=table("people", id=int_().primary(), name=text(), age=int_(), score=decimal(10, 2), meta=jsonb(), managerId=fk("people.id", as_="manager", inverse="reports")),
    )


PEOPLE = [
    (1, "Ann", 30, "1.50", '{"role":"admin","tags":["a","b"],"n":{"x":1}}', None),
    (2, "bob", None, "2.00", '{"role":"user","tags":[],"n":null}', 1),
    (3, "CAROL", 25, None, None, 1),
    (4, "", 25, "2.00", "null", 2),
    (5, None, 40, "9.99", '["role","x"]', 2),
    (6, "50%_\\", 10, "0.00", '{"role":"user","n":{"x":1.0,"y":[1,2]}}', 5),
]
