"""The driver's tables as a code graph: a fixed binding, so that every graph operator has rows to run over.

``Graph`` has the DataFrames, ``SQL`` the same tables as common table expressions for DuckDB.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import narrow
from ..operators.traverse import cut
from ..schema import digest_id

EFFECT_CONFIDENCE = {"1-URGENT": 0.99, "2-HIGH": 0.95, "3-MEDIUM": 0.9, "4-NOT SPECIFIED": 0.85, "5-LOW": 0.75}


def _line(key: str) -> Column:
    return F.when(F.col(key) % 11 != 0, F.col(key) + 1)


class Graph:
    """Lazily bound tables of one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        """Nations with their file; 25 rows."""
        region = self.table("region")
        path = F.concat(F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit(".clj"))
        return self.table("nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "n_regionkey", "r_name", path.alias("path"), F.concat(F.lit("file:"), path).alias("file_id"))

    @cached_property
    def files(self) -> DataFrame:
        sizes = self.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("size"))
        return self.nations.join(sizes, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
            F.col("file_id").alias("id"), "path", F.col("r_name").alias("language"), F.concat(F.lit("sha256:"), F.sha2("n_name", 256)).alias("content_hash"),
            F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.col("n_nationkey").cast("long").alias("modified_at"),
        )

    def _symbols(self, df: DataFrame, src: str, key: str, kind: str, name: Column, qualified: Column, platform: str, scope: str, role: str, signature: Column, doc: Column) -> DataFrame:
        return df.select(
            digest_id("symbol", F.lit(platform), F.col("file_id"), F.lit(kind), qualified, F.lit("")).alias("id"),
            name.alias("name"), qualified.alias("qualified_name"), F.lit(kind).alias("kind"), "file_id", F.lit(platform).alias("platform"), F.lit("binding").alias("analyzer"),
            F.lit(scope).alias("scope"), F.lit(role).alias("role"), F.lit(kind != "namespace").alias("indexable"), signature.alias("signature"), doc.alias("doc"),
            _line(key).cast("long").alias("start_line"), (F.col(key) + 1 + F.col(key) % 7).cast("long").alias("end_line"),
            F.lit(src).alias("src"), F.col(key).cast("long").alias("key"),
        )

    @cached_property
    def namespaces(self) -> DataFrame:
        name = F.lower("n_name")
        return self._symbols(self.nations, "nation", "n_nationkey", "namespace", name, name, "clj", "namespace", "namespace", F.lit(None).cast("string"), F.col("r_name"))

    @cached_property
    def customers(self) -> DataFrame:
        df = self.table("customer").join(F.broadcast(self.nations), F.col("c_nationkey") == F.col("n_nationkey"))
        return self._symbols(df, "customer", "c_custkey", "function", F.col("c_name"), F.concat_ws("/", F.lower("n_name"), "c_name"), "clj", "top-level", "definition", F.concat(F.lit("["), F.col("c_mktsegment"), F.lit("]")), F.lit(None).cast("string"))

    @cached_property
    def suppliers(self) -> DataFrame:
        df = self.table("supplier").join(F.broadcast(self.nations), F.col("s_nationkey") == F.col("n_nationkey"))
        return self._symbols(df, "supplier", "s_suppkey", "type", F.col("s_name"), F.concat_ws("/", F.lower("n_name"), "s_name"), "cljs", "top-level", "definition", F.lit(None).cast("string"), F.lit(None).cast("string"))

    @cached_property
    def parts(self) -> DataFrame:
        name = F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.col("p_partkey"))
        df = self.table("part").join(F.broadcast(self.nations), F.col("p_partkey") % 25 == F.col("n_nationkey"))
        return self._symbols(df, "part", "p_partkey", "function", name, F.concat_ws("/", F.lower("n_name"), name), "cljs", "top-level", "definition", F.concat(F.lit("["), F.col("p_brand"), F.lit("]")), F.col("p_type"))

    @cached_property
    def orders(self) -> DataFrame:
        name = F.concat(F.lit("order-"), F.col("o_orderkey"))
        own = self.table("customer").select("c_custkey", "c_nationkey")
        df = self.table("orders").join(own, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nations), F.col("c_nationkey") == F.col("n_nationkey"))
        return self._symbols(df, "order", "o_orderkey", "method", name, F.concat_ws("/", F.lower("n_name"), name), "clj", "method", "method", F.lit(None).cast("string"), F.lit(None).cast("string"))

    @cached_property
    def keyed_symbols(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.namespaces, self.customers, self.suppliers, self.parts, self.orders])

    @cached_property
    def symbols(self) -> DataFrame:
        return self.keyed_symbols.drop("src", "key")

    @cached_property
    def topics(self) -> DataFrame:
        """One per event type."""
        kinds = self.table("events").select("event_type").distinct()
        return kinds.select(digest_id("topic", F.lit("event"), F.col("event_type"), F.lit("cljs")).alias("id"), F.lit("event").alias("kind"), F.col("event_type").alias("key"), F.lit("cljs").alias("platform"))

    def _edges(self, pairs: DataFrame, kind: str, source: DataFrame, target: DataFrame, evidence: str) -> DataFrame:
        """pairs: distinct (a, b), keys of source and target."""
        s = source.select(F.col("key").alias("a_key"), F.col("id").alias("from_id"), F.col("start_line").alias("line"))
        t = target.select(F.col("key").alias("b_key"), F.col("id").alias("to_id"), F.col("qualified_name").alias("target_text"))
        df = pairs.join(s, F.col("a") == F.col("a_key")).join(t, F.col("b") == F.col("b_key"))
        return self._edge_rows(df, kind, "symbol", evidence)

    @staticmethod
    def _edge_rows(df: DataFrame, kind: str, to_type: str, evidence: str) -> DataFrame:
        return df.select(
            digest_id("edge", F.lit(kind), F.col("from_id"), F.col("to_id"), F.col("line")).alias("id"), F.lit(kind).alias("kind"), "from_id", "to_id", F.lit(to_type).alias("to_type"), "target_text",
            F.lit("exact").alias("resolution"), F.lit(1.0).alias("confidence"), F.lit(evidence).alias("evidence"), "line",
        )

    @cached_property
    def contains(self) -> DataFrame:
        c = self.table("customer").select(F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("b"))
        s = self.table("supplier").select(F.col("s_nationkey").alias("a"), F.col("s_suppkey").alias("b"))
        return self._edges(c, "contains", self.namespaces, self.customers, "customer").unionByName(self._edges(s, "contains", self.namespaces, self.suppliers, "supplier"))

    @cached_property
    def part_calls(self) -> DataFrame:
        part = self.table("part")
        p = part.select(F.col("p_partkey").alias("a"), ((F.col("p_partkey") * 7 + 1) % F.lit(part.count())).alias("b"))
        return self._edges(p, "calls", self.parts, self.parts, "part")

    @cached_property
    def user_calls(self) -> DataFrame:
        m = self.table("customer").count()
        users = self.table("events").where("event_type = 'purchase'").select("user_id").distinct()
        u = users.select(F.col("user_id").alias("a"), ((F.col("user_id") * 7 + 3) % F.lit(m)).alias("b"))
        return self._edges(u, "calls", self.customers, self.customers, "events")

    @cached_property
    def calls(self) -> DataFrame:
        o = self.table("orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"))
        li = self.table("lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
        return reduce(DataFrame.unionByName, [
            self._edges(o, "calls", self.customers, self.orders, "orders"),
            self._edges(li, "calls", self.orders, self.parts, "lineitem"),
            self.part_calls,
            self.user_calls,
        ])

    @cached_property
    def dispatches(self) -> DataFrame:
        seen = self.table("events").select("user_id", "event_type").distinct()
        source = self.customers.select(F.col("key").alias("a_key"), F.col("id").alias("from_id"), F.col("start_line").alias("line"))
        topic = self.topics.select(F.col("key").alias("target_text"), F.col("id").alias("to_id"))
        df = seen.join(source, F.col("user_id") == F.col("a_key")).join(topic, F.col("event_type") == F.col("target_text"))
        return self._edge_rows(df, "event-dispatches", "topic", "events")

    @cached_property
    def imports(self) -> DataFrame:
        n = self.nations.select("n_nationkey", "n_regionkey")
        nxt = n.alias("x").join(n.alias("y"), F.expr("x.n_regionkey = y.n_regionkey and x.n_nationkey < y.n_nationkey")).groupBy(F.col("x.n_nationkey").alias("a")).agg(F.min("y.n_nationkey").alias("b"))
        return self._edges(nxt, "imports", self.namespaces, self.namespaces, "nation")

    @cached_property
    def edges(self) -> DataFrame:
        refs = self.table("lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
        return reduce(DataFrame.unionByName, [self.contains, self.calls, self._edges(refs, "references", self.parts, self.suppliers, "lineitem"), self.imports, self.dispatches])

    @cached_property
    def references(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").distinct()
        own = self.orders.select(F.col("key").alias("o_key"), F.col("id").alias("symbol_id"), F.col("start_line").alias("line"))
        names = self.table("part").select(F.col("p_partkey").alias("pk"), F.col("p_name").alias("target_text"))
        df = li.join(own, F.col("l_orderkey") == F.col("o_key")).join(names, F.col("l_partkey") == F.col("pk"))
        return self._reference_rows(df)

    @staticmethod
    def _reference_rows(df: DataFrame) -> DataFrame:
        kind = F.when(F.col("l_returnflag") == "R", "external").when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_linestatus") == "O", "unresolved").otherwise("dynamic")
        return df.select(
            digest_id("reference", F.col("symbol_id"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_linestatus")).alias("id"),
            "symbol_id", F.lit("calls").alias("kind"), "target_text", kind.alias("classification"), F.lit("lineitem").alias("evidence"), "line",
        )

    @cached_property
    def effects(self) -> DataFrame:
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        own = self.customers.select(F.col("key").alias("c_key"), F.col("id").alias("symbol_id"), F.col("start_line").alias("line"))
        return self._effect_rows(o.join(own, F.col("o_custkey") == F.col("c_key")))

    @staticmethod
    def _effect_rows(df: DataFrame) -> DataFrame:
        sure = F.create_map(*[F.lit(x) for kv in EFFECT_CONFIDENCE.items() for x in kv])
        return df.select(digest_id("effect", F.col("symbol_id"), F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("kind"), "symbol_id", F.concat(F.lit("order-"), F.col("o_orderkey")).alias("detail"), sure[F.col("o_orderpriority")].alias("confidence"), "line")

    @cached_property
    def members(self) -> DataFrame:
        """Line items with their 0-based place in their order, by all that tells them apart."""
        from pyspark.sql import Window

        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_discount", "l_tax", "l_shipdate")
        return self.table("lineitem").withColumn("ordinal", F.row_number().over(order).cast("long") - 1)

    @cached_property
    def aggregates(self) -> DataFrame:
        n = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("member_count"))
        own = self.table("orders").select("o_orderkey", "o_orderstatus")
        return self._aggregate_rows(self.orders.join(own, F.col("key") == F.col("o_orderkey")).join(n, F.col("key") == F.col("l_orderkey"), "left"))

    @staticmethod
    def _aggregate_rows(df: DataFrame) -> DataFrame:
        done = F.when(F.col("o_orderstatus") == "F", "complete-static").when(F.col("o_orderstatus") == "O", "partial-static").otherwise("dynamic")
        return df.select(
            digest_id("aggregate", F.col("id"), F.lit("order")).alias("id"), "name", F.lit("literal-set").alias("kind"), F.col("id").alias("owner_id"), "file_id", done.alias("completeness"),
            F.coalesce("member_count", F.lit(0)).cast("long").alias("member_count"), F.lit("number").alias("member_kind"), F.lit("binding").alias("analyzer"), F.concat_ws(" ", "name", F.lit("members"), done).alias("search_text"),
            "start_line", "end_line", "key",
        )

    @cached_property
    def memberships(self) -> DataFrame:
        agg = self.aggregates.select(F.col("key").alias("a_key"), F.col("id").alias("aggregate_id"))
        return self._membership_rows(self.members.join(agg, F.col("l_orderkey") == F.col("a_key")))

    @staticmethod
    def _membership_rows(df: DataFrame) -> DataFrame:
        return df.select(digest_id("membership", F.col("aggregate_id"), F.col("ordinal")).alias("id"), "aggregate_id", F.col("l_partkey").cast("string").alias("value"), F.lit("number").alias("value_kind"), "ordinal", F.lit("literal").alias("evidence"))

    def stored(self) -> Stored:
        """The same tables written once to the shared folder, for queries that read them many times."""
        return stored_graph(self.spark, self.sf_dir)

    def lean(self) -> Lean:
        """The same tables with ids made as they are read, for audits that read whole tables once a rule."""
        return lean_graph(self.spark, self.sf_dir)

    def tables(self) -> dict[str, DataFrame]:
        return {"files": self.files, "symbols": self.symbols, "edges": self.edges, "references": self.references, "topics": self.topics, "effects": self.effects, "aggregates": self.aggregates.drop("key"), "memberships": self.memberships}


class Stored(Graph):
    """The same graph, each table written to the shared folder when it is first asked for, and read back from then on."""

    def stored(self) -> Stored:
        return self

    @cached_property
    def keyed_symbols(self) -> DataFrame:
        return cut(Graph(self.spark, self.sf_dir).keyed_symbols)

    def _of(self, src: str) -> DataFrame:
        return self.keyed_symbols.where(F.col("src") == src)

    namespaces = cached_property(lambda self: self._of("nation"))
    customers = cached_property(lambda self: self._of("customer"))
    suppliers = cached_property(lambda self: self._of("supplier"))
    parts = cached_property(lambda self: self._of("part"))
    orders = cached_property(lambda self: self._of("order"))


def _written(name: str) -> cached_property:
    made = cached_property(lambda self: cut(Graph.__dict__[name].func(self)))
    made.__set_name__(Stored, name)
    return made


for _name in ("files", "topics", "edges", "references", "effects", "aggregates", "memberships"):
    setattr(Stored, _name, _written(_name))

class Lean(Graph):
    """The same graph, where what ids and names are made of is written once, in keys and short strings, and ids are made as it is read.

    No table needs a shuffle when it is read, and the three ids of an edge take no disk.
    """

    nations = cached_property(lambda self: narrow.settle(Graph.__dict__["nations"].func(self)))
    files = cached_property(lambda self: narrow.settle(Graph.__dict__["files"].func(self)))
    topics = cached_property(lambda self: narrow.settle(Graph.__dict__["topics"].func(self)))

    def lean(self) -> Lean:
        return self

    @cached_property
    def placed(self) -> DataFrame:
        """Orders with their customer's name and nation and how many line items they have."""
        n = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("member_count"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        own = self.table("customer").select("c_custkey", "c_name", "c_nationkey")
        df = o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(own, F.col("o_custkey") == F.col("c_custkey"))
        return narrow.settle(df.drop("l_orderkey", "c_custkey"))

    @cached_property
    def lines(self) -> DataFrame:
        """Line items of orders with their place, whether they are the first of their order and part and of all that a reference has, and their parts' names."""
        from pyspark.sql import Window

        told = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
        place, pair = Window.partitionBy("l_orderkey").orderBy(*told), Window.partitionBy("l_orderkey", "l_partkey").orderBy("ordinal")
        same = F.lag(F.struct(*told)).over(place)
        df = self.table("lineitem").select("l_orderkey", *told).withColumns({"ordinal": F.row_number().over(place).cast("long") - 1, "first_use": ~same.eqNullSafe(F.struct(*told))})
        df = df.withColumn("first_pair", F.row_number().over(pair) == 1)
        own = self.placed.select("o_orderkey", F.col("c_nationkey").alias("o_nationkey"))
        df = df.join(own, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
        return narrow.settle(df.join(self._named_parts, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey"))

    @property
    def _named_parts(self) -> DataFrame:
        """Keys of parts with their names, and the ids and qualified names of their symbols where their nation is there."""
        n = F.broadcast(self.nations.select("n_nationkey", "n_name", "file_id"))
        df = self.table("part").join(n, F.col("p_partkey") % 25 == F.col("n_nationkey"), "left")
        text = F.concat_ws("/", F.lower("n_name"), F.concat_ws("-", F.regexp_replace("p_name", " ", "-"), F.col("p_partkey")))
        made = F.when(F.col("file_id").isNotNull(), digest_id("symbol", F.lit("cljs"), F.col("file_id"), F.lit("function"), text, F.lit("")))
        return df.groupBy("p_partkey").agg(F.collect_list(F.struct("p_name", made.alias("id"), text.alias("text"))).alias("parts"))

    @cached_property
    def supplied(self) -> DataFrame:
        """Distinct parts and suppliers of line items that are there, with the ids and qualified names of their symbols."""
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
        sellers = narrow.settle(self.suppliers.select(F.col("key").alias("s_suppkey"), F.col("id").alias("to_id"), F.col("qualified_name").alias("to_text")))
        named = pairs.join(self._named_parts, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
        return narrow.settle(named.join(narrow.few(sellers) or sellers, F.col("l_suppkey") == F.col("s_suppkey")).drop("s_suppkey"))

    @cached_property
    def fewer_edges(self) -> DataFrame:
        return narrow.settle(reduce(DataFrame.unionByName, [self.contains, self.part_calls, self.user_calls, self.imports, self.dispatches]))

    @cached_property
    def orders(self) -> DataFrame:
        name = F.concat(F.lit("order-"), F.col("o_orderkey"))
        df = self.placed.join(F.broadcast(self.nations), F.col("c_nationkey") == F.col("n_nationkey"))
        return self._symbols(df, "order", "o_orderkey", "method", name, F.concat_ws("/", F.lower("n_name"), name), "clj", "method", "method", F.lit(None).cast("string"), F.lit(None).cast("string"))

    def _end(self, df: DataFrame, side: str, kind: str, key: str, nation: Column, name: Column, platform: str) -> DataFrame:
        """df with {side}_id, {side}_text, {side}_file and {side}_line of the symbol of a key, where its nation is there."""
        n = self.nations.select(F.col("n_nationkey").alias(f"{side}_nation"), F.lower("n_name").alias(f"{side}_space"), F.col("file_id").alias(f"{side}_file"))
        text = F.concat_ws("/", f"{side}_space", name)
        made = digest_id("symbol", F.lit(platform), F.col(f"{side}_file"), F.lit(kind), text, F.lit(""))
        return df.join(F.broadcast(n), nation == F.col(f"{side}_nation")).withColumns({f"{side}_id": made, f"{side}_text": text, f"{side}_line": _line(key).cast("long")})

    def _customer(self, df: DataFrame, side: str) -> DataFrame:
        return self._end(df, side, "function", "o_custkey", F.col("c_nationkey"), F.col("c_name"), "clj")

    def _order(self, df: DataFrame, side: str, key: str, nation: str) -> DataFrame:
        return self._end(df, side, "method", key, F.col(nation), F.concat(F.lit("order-"), F.col(key)), "clj")

    @staticmethod
    def _part(df: DataFrame, side: str) -> DataFrame:
        """df with the parts of l_partkey, one row for each whose symbol is there."""
        df = df.withColumn("part", F.explode("parts")).where("part.id is not null")
        return df.withColumns({f"{side}_id": F.col("part.id"), f"{side}_text": F.col("part.text"), f"{side}_line": _line("l_partkey").cast("long")})

    def _between(self, df: DataFrame, kind: str, evidence: str) -> DataFrame:
        return self._edge_rows(df.select("from_id", "to_id", F.col("to_text").alias("target_text"), F.col("from_line").alias("line")), kind, "symbol", evidence)

    @cached_property
    def edges(self) -> DataFrame:
        o = self._order(self._customer(self.placed, "from"), "to", "o_orderkey", "c_nationkey")
        li = self._part(self._order(self.lines.where("first_pair"), "from", "l_orderkey", "o_nationkey"), "to")
        refs = self._part(self.supplied, "from")
        return reduce(DataFrame.unionByName, [self._between(o, "calls", "orders"), self._between(li, "calls", "lineitem"), self._between(refs, "references", "lineitem"), self.fewer_edges])

    @cached_property
    def references(self) -> DataFrame:
        df = self._order(self.lines.where("first_use"), "own", "l_orderkey", "o_nationkey").withColumn("part", F.explode("parts"))
        return self._reference_rows(df.select("l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("own_id").alias("symbol_id"), F.col("part.p_name").alias("target_text"), F.col("own_line").alias("line")))

    @cached_property
    def effects(self) -> DataFrame:
        return self._effect_rows(self._customer(self.placed, "own").select("o_orderkey", "o_orderpriority", F.col("own_id").alias("symbol_id"), F.col("own_line").alias("line")))

    @cached_property
    def aggregates(self) -> DataFrame:
        name, key = F.concat(F.lit("order-"), F.col("o_orderkey")), F.col("o_orderkey").cast("long")
        df = self._order(self.placed, "own", "o_orderkey", "c_nationkey")
        df = df.select(F.col("own_id").alias("id"), name.alias("name"), F.col("own_file").alias("file_id"), F.col("own_line").alias("start_line"), (key + 1 + key % 7).alias("end_line"), key.alias("key"), "o_orderstatus", "member_count")
        return self._aggregate_rows(df)

    @cached_property
    def memberships(self) -> DataFrame:
        df = self._order(self.lines, "own", "l_orderkey", "o_nationkey")
        return self._membership_rows(df.withColumn("aggregate_id", digest_id("aggregate", F.col("own_id"), F.lit("order"))))


_stored: dict[tuple[str, str], Stored] = {}
_lean: dict[tuple[str, str], Lean] = {}


def lean_graph(spark: SparkSession, sf_dir: str) -> Lean:
    return _lean.setdefault((spark.sparkContext.applicationId, sf_dir), Lean(spark, sf_dir))



def stored_graph(spark: SparkSession, sf_dir: str) -> Stored:
    """One stored graph for each application and input folder, as a store is built once and then asked many times."""
    return _stored.setdefault((spark.sparkContext.applicationId, sf_dir), Stored(spark, sf_dir))


def _id(prefix: str, *parts: str) -> str:
    joined = "||chr(31)||".join(f"coalesce(cast({p} as varchar),'')" for p in parts)
    return f"'{prefix}:'||substr(sha256({joined}),1,32)"


def _symbols_sql(src: str, key: str, kind: str, name: str, qualified: str, platform: str, scope: str, role: str, signature: str, doc: str, body: str) -> str:
    return f"""select {_id("symbol", f"'{platform}'", "file_id", f"'{kind}'", qualified, "''")} as id, {name} as name, {qualified} as qualified_name, '{kind}' as kind, file_id, '{platform}' as platform,
    'binding' as analyzer, '{scope}' as scope, '{role}' as role, {"false" if kind == "namespace" else "true"} as indexable, {signature} as signature, {doc} as doc,
    cast(case when {key} % 11 <> 0 then {key} + 1 end as bigint) as start_line, cast({key} + 1 + {key} % 7 as bigint) as end_line, '{src}' as src, cast({key} as bigint) as key from {body}"""


def _edges_sql(kind: str, pairs: str, source: str, target: str, evidence: str) -> str:
    return f"""select {_id("edge", f"'{kind}'", "s.id", "t.id", "s.start_line")} as id, '{kind}' as kind, s.id as from_id, t.id as to_id, 'symbol' as to_type, t.qualified_name as target_text,
    'exact' as resolution, 1.0::double as confidence, '{evidence}' as evidence, s.start_line as line from ({pairs}) p join keyed s on s.src='{source}' and s.key=p.a join keyed t on t.src='{target}' and t.key=p.b"""


_NULL = "cast(null as varchar)"
_PART_NAME = "replace(p_name,' ','-')||'-'||p_partkey"
SQL = f"""
nations as (select n_nationkey, n_name, n_regionkey, r_name, lower(r_name)||'/'||lower(n_name)||'.clj' as path, 'file:'||lower(r_name)||'/'||lower(n_name)||'.clj' as file_id from nation join region on n_regionkey=r_regionkey),
files as (select file_id as id, path, r_name as language, 'sha256:'||sha256(n_name) as content_hash, cast(coalesce(c,0) as bigint) as size, cast(n_nationkey as bigint) as modified_at from nations left join (select c_nationkey, count(*) c from customer group by 1) on c_nationkey=n_nationkey),
keyed as (
{_symbols_sql("nation", "n_nationkey", "namespace", "lower(n_name)", "lower(n_name)", "clj", "namespace", "namespace", _NULL, "r_name", "nations")}
union all {_symbols_sql("customer", "c_custkey", "function", "c_name", "lower(n_name)||'/'||c_name", "clj", "top-level", "definition", "'['||c_mktsegment||']'", _NULL, "customer join nations on c_nationkey=n_nationkey")}
union all {_symbols_sql("supplier", "s_suppkey", "type", "s_name", "lower(n_name)||'/'||s_name", "cljs", "top-level", "definition", _NULL, _NULL, "supplier join nations on s_nationkey=n_nationkey")}
union all {_symbols_sql("part", "p_partkey", "function", _PART_NAME, f"lower(n_name)||'/'||{_PART_NAME}", "cljs", "top-level", "definition", "'['||p_brand||']'", "p_type", "part join nations on p_partkey%25=n_nationkey")}
union all {_symbols_sql("order", "o_orderkey", "method", "'order-'||o_orderkey", "lower(n_name)||'/order-'||o_orderkey", "clj", "method", "method", _NULL, _NULL, "orders join customer on o_custkey=c_custkey join nations on c_nationkey=n_nationkey")}
),
symbols as (select * exclude (src, key) from keyed),
topics as (select {_id("topic", "'event'", "event_type", "'cljs'")} as id, 'event' as kind, event_type as key, 'cljs' as platform from (select distinct event_type from events)),
calls as (
{_edges_sql("calls", "select o_custkey a, o_orderkey b from orders", "customer", "order", "orders")}
union all {_edges_sql("calls", "select distinct l_orderkey a, l_partkey b from lineitem", "order", "part", "lineitem")}
union all {_edges_sql("calls", "select p_partkey a, (p_partkey*7+1)%(select count(*) from part) b from part", "part", "part", "part")}
union all {_edges_sql("calls", "select distinct user_id a, (user_id*7+3)%(select count(*) from customer) b from events where event_type='purchase'", "customer", "customer", "events")}
),
edges as (
{_edges_sql("contains", "select c_nationkey a, c_custkey b from customer", "nation", "customer", "customer")}
union all {_edges_sql("contains", "select s_nationkey a, s_suppkey b from supplier", "nation", "supplier", "supplier")}
union all select * from calls
union all {_edges_sql("references", "select distinct l_partkey a, l_suppkey b from lineitem", "part", "supplier", "lineitem")}
union all {_edges_sql("imports", "select x.n_nationkey a, min(y.n_nationkey) b from nation x join nation y on x.n_regionkey=y.n_regionkey and x.n_nationkey<y.n_nationkey group by 1", "nation", "nation", "nation")}
union all select {_id("edge", "'event-dispatches'", "s.id", "t.id", "s.start_line")} as id, 'event-dispatches' as kind, s.id as from_id, t.id as to_id, 'topic' as to_type, t.key as target_text, 'exact' as resolution, 1.0::double as confidence, 'events' as evidence, s.start_line as line
  from (select distinct user_id, event_type from events) p join keyed s on s.src='customer' and s.key=p.user_id join topics t on t.key=p.event_type
),
refs as (select {_id("reference", "s.id", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")} as id, s.id as symbol_id, 'calls' as kind, p_name as target_text,
  case when l_returnflag='R' then 'external' when l_returnflag='A' then 'ambiguous' when l_linestatus='O' then 'unresolved' else 'dynamic' end as classification, 'lineitem' as evidence, s.start_line as line
  from (select distinct l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus from lineitem) join keyed s on s.src='order' and s.key=l_orderkey join part on p_partkey=l_partkey),
effects as (select {_id("effect", "s.id", "o_orderkey")} as id, o_orderpriority as kind, s.id as symbol_id, 'order-'||o_orderkey as detail,
  case o_orderpriority {" ".join(f"when '{k}' then {v}::double" for k, v in EFFECT_CONFIDENCE.items())} end as confidence, s.start_line as line from orders join keyed s on s.src='customer' and s.key=o_custkey),
aggs as (select {_id("aggregate", "s.id", "'order'")} as id, s.name, 'literal-set' as kind, s.id as owner_id, s.file_id, case o_orderstatus when 'F' then 'complete-static' when 'O' then 'partial-static' else 'dynamic' end as completeness,
  cast(coalesce(c,0) as bigint) as member_count, 'number' as member_kind, 'binding' as analyzer, s.name||' members '||(case o_orderstatus when 'F' then 'complete-static' when 'O' then 'partial-static' else 'dynamic' end) as search_text, s.start_line, s.end_line, s.key
  from keyed s join orders on s.src='order' and s.key=o_orderkey left join (select l_orderkey, count(*) c from lineitem group by 1) on l_orderkey=o_orderkey),
members as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus, l_discount, l_tax, l_shipdate) - 1 as ordinal from lineitem),
memberships as (select {_id("membership", "a.id", "ordinal")} as id, a.id as aggregate_id, cast(l_partkey as varchar) as value, 'number' as value_kind, ordinal, 'literal' as evidence from members join aggs a on a.key=l_orderkey)
"""


def sql(body: str) -> str:
    """body over the bound tables (files, symbols, keyed, edges, calls, refs, topics, effects, aggs, memberships)."""
    return f"with recursive {SQL.strip()}{',' if body.lstrip().startswith('+') else ''} {body.lstrip().removeprefix('+')}"
