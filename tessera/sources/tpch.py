"""The catalog over a folder of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from tessera.sources.catalog import Catalog, Children, Link, Source

#: Columns by table, as Spark's type names.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
KEYS = {"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",), "labels": ("doc_id",), "embeddings": ("vec_id",), "pages": ("page_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn")}
#: Tables in which every column has a value.
REQUIRED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
LINKS = {
    "nation": {"region": Link("region", ("n_regionkey",))},
    "customer": {"nation": Link("nation", ("c_nationkey",))},
    "supplier": {"nation": Link("nation", ("s_nationkey",))},
    "orders": {"customer": Link("customer", ("o_custkey",))},
    "lineitem": {"order": Link("orders", ("l_orderkey",)), "part": Link("part", ("l_partkey",)), "supplier": Link("supplier", ("l_suppkey",))},
    "events": {"customer": Link("customer", ("user_id",))},
    "labels": {"document": Link("documents", ("doc_id",))},
    "documents": {"label": Link("labels", ("doc_id",))},
}
CHILDREN = {
    "region": {"nations": Children("nation", ("n_regionkey",))},
    "nation": {"customers": Children("customer", ("c_nationkey",)), "suppliers": Children("supplier", ("s_nationkey",))},
    "customer": {"orders": Children("orders", ("o_custkey",))},
    "orders": {"lineitems": Children("lineitem", ("l_orderkey",))},
    "part": {"lineitems": Children("lineitem", ("l_partkey",))},
    "supplier": {"lineitems": Children("lineitem", ("l_suppkey",))},
}


def catalog(folder: str) -> Catalog:
    """Every table of the folder; `purchase` and `failure` are kinds of events."""

    def source(name: str) -> Source:
        schema = T.StructType.fromDDL(SCHEMAS[name])
        for f in schema:
            f.nullable = f.name not in KEYS.get(name, ()) and name not in REQUIRED

        def read(spark: SparkSession):
            return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

        return Source(name, read, schema, key=KEYS.get(name, ()), links=LINKS.get(name, {}), children=CHILDREN.get(name, {}))

    made = [source(n) for n in SCHEMAS]
    events = next(s for s in made if s.name == "events")
    kinds = [Source(n, events.read, events.schema, key=events.key, links=events.links, base="events", discriminator=("event_type", (v,))) for n, v in (("purchase", "purchase"), ("failure", "error"))]
    return Catalog(*made, *kinds)
