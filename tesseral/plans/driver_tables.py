"""Schema of the synthetic star, event and text tables, for examples, tests and benchmarks."""

from __future__ import annotations

from ..schema import Schema, array, bigint, define_schema, double, fk, int_, jsonb, many_to_many, primary_key, table, text, timestamp


def driver_schema() -> Schema:
    """``lineitem`` has no key: its (order, line) pairs repeat."""
    return define_schema(
        many_to_many("part", "supplier", "lineitem", "suppliers", "parts", "part", "supplier"),
        many_to_many("orders", "part", "lineitem", "parts", "orders", "order", "part"),
        naming="camelCase",
        region=table("region", r_regionkey=int_().primary(), r_name=text()),
        nation=table("nation", n_nationkey=int_().primary(), n_name=text(), n_regionkey=fk("region", as_="region", inverse="nations")),
        customer=table("customer", c_custkey=bigint().primary(), c_name=text(), c_nationkey=fk("nation", as_="nation", inverse="customers"), c_acctbal=double(), c_mktsegment=text()),
        supplier=table("supplier", s_suppkey=bigint().primary(), s_name=text(), s_nationkey=fk("nation", as_="nation", inverse="suppliers"), s_acctbal=double()),
        part=table("part", p_partkey=bigint().primary(), p_name=text(), p_brand=text(), p_type=text(), p_size=int_(), p_retailprice=double()),
        orders=table("orders", o_orderkey=bigint().primary(), o_custkey=fk("customer", as_="customer", inverse="orders"), o_orderstatus=text(), o_totalprice=double(), o_orderdate=timestamp(tz=False), o_orderpriority=text()),
        lineitem=table(
            "lineitem",
            l_orderkey=fk("orders", as_="order", inverse="lineitems"),
            l_partkey=fk("part", as_="part", inverse="lineitems"),
            l_suppkey=fk("supplier", as_="supplier", inverse="lineitems"),
            l_linenumber=int_(),
            l_quantity=double(),
            l_extendedprice=double(),
            l_discount=double(),
            l_tax=double(),
            l_returnflag=text(),
            l_linestatus=text(),
            l_shipdate=timestamp(tz=False),
        ),
        events=table("events", event_id=bigint().primary(), ts=timestamp(tz=False), user_id=bigint(), event_type=text(), value=double(), props=jsonb()),
        documents=table("documents", doc_id=bigint().primary(), text=text(), lang=text(), source=text(), n_chars=bigint()),
        labels=table("labels", doc_id=fk("documents", as_="document", inverse="label", unique=True), quality=int_(), toxic=int_()),
        conversations=table("conversations", primary_key("conv_id", "turn"), conv_id=bigint(), turn=bigint(), role=text(), text=text()),
        embeddings=table("embeddings", vec_id=bigint().primary(), embedding=array("float"), label=int_()),
        pages=table("pages", page_id=bigint().primary(), url=text(), html=text()),
        benchmark=table("benchmark", item_id=bigint().primary(), text=text()),
    )
