"""From observations to the graph's tables: symbols, edges, classified references, effects, topics, literal aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SCHEMAS, content_hash, digest_id
from .reads import owner_intervals
from .traverse import cut

# Forms of the language itself, whose use makes no relation.
SUPPRESSED = ("def", "defn", "defn-", "defmacro", "defonce", "defmulti", "defmethod", "defprotocol", "defrecord", "deftype", "fn", "let", "loop", "if", "when", "cond", "case", "do", "and", "or", "not", "ns", "->", "->>", "for", "doseq", "recur")

# What calls of some names do, by language; a pattern holds for the whole target.
EFFECT_RULES = {
    "clj": (
        (r"(?:clojure\.core/)?slurp", "file-read", 0.99),
        (r"(?:clojure\.core/)?spit", "file-write", 0.99),
        (r"(?:clojure\.core/)?(?:println|print|prn)", "logging", 0.98),
        (r"(?:clojure\.java\.shell/)?sh", "process", 0.97),
        (r"(?:next\.jdbc/)?execute!", "database-write", 0.75),
    ),
    "cljs": (
        (r"(?:cljs\.core/)?(?:swap!|reset!)", "global-mutation", 0.99),
        (r"(?:cljs\.core/)?(?:println|print|prn)", "logging", 0.98),
        (r"(?:js/)?fetch", "network", 0.9),
    ),
    "cljc": (
        (r"(?:(?:clojure|cljs)\.core/)?(?:swap!|reset!)", "global-mutation", 0.99),
        (r"(?:(?:clojure|cljs)\.core/)?(?:println|print|prn)", "logging", 0.98),
    ),
    "janet": (
        (r"slurp", "file-read", 0.99),
        (r"(?:spit|file/write)", "file-write", 0.99),
        (r"file/read", "file-read", 0.99),
        (r"(?:print|printf|prin|prinf|pp|eprint|eprintf)", "logging", 0.96),
        (r"(?:os/spawn|os/execute|file/popen)", "process", 0.98),
        (r"net/(?:connect|listen|accept|read|write)", "network", 0.9),
    ),
}
# Calls whose first argument names a topic, of what kind, and the relation they make.
TOPIC_APIS = {
    "re-frame.core/reg-event-db": ("event", "topic-registers"),
    "re-frame.core/reg-event-fx": ("event", "topic-registers"),
    "re-frame.core/reg-event-ctx": ("event", "topic-registers"),
    "re-frame.core/reg-sub": ("subscription", "topic-registers"),
    "re-frame.core/reg-fx": ("effect", "topic-registers"),
    "re-frame.core/reg-cofx": ("coeffect", "topic-registers"),
    "re-frame.core/dispatch": ("event", "event-dispatches"),
    "re-frame.core/dispatch-sync": ("event", "event-dispatches"),
    "re-frame.core/subscribe": ("subscription", "subscribes"),
}


def _detail(i: int) -> Column:
    return F.element_at(F.split("detail", "\x1f", -1), i)


def files_table(files: DataFrame) -> DataFrame:
    """files (path, language, text, size, modified_at)."""
    return files.select(F.concat(F.lit("file:"), "path").alias("id"), "path", "language", content_hash(F.coalesce("text", F.lit(""))).alias("content_hash"), F.col("size").cast("long"), F.col("modified_at").cast("long"))


def symbols_table(observed: DataFrame) -> DataFrame:
    """Namespaces and effective definitions: of several definitions of a name in a file the last; a declare is none."""
    file = F.concat(F.lit("file:"), "path")
    ns = observed.where("kind = 'namespace'").groupBy("path", "platform", F.col("ns").alias("name")).agg(F.min_by(F.struct("detail", "start_line", "end_line"), "start_byte").alias("r"))
    kind = F.when(F.col("platform") == "janet", "module").otherwise("namespace")
    spaces = ns.select(
        digest_id("symbol", F.col("platform"), file, kind, F.col("name"), F.lit("")).alias("id"), "name", F.col("name").alias("qualified_name"), kind.alias("kind"), file.alias("file_id"), "platform", F.lit("reader").alias("analyzer"),
        kind.alias("scope"), kind.alias("role"), F.lit(False).alias("indexable"), F.lit(None).cast("string").alias("signature"), F.col("r.detail").alias("doc"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"), F.col("name").alias("ns"), F.lit("").alias("protocol"),
    )
    v = observed.where("kind = 'var'").groupBy("path", "platform", "ns", "name", F.coalesce("target", F.lit("")).alias("protocol")).agg(F.max_by(F.struct("detail", "start_line", "end_line"), "start_byte").alias("r")).withColumn("detail", F.col("r.detail"))
    q = F.concat("ns", F.lit("/"), "name")
    vars_ = v.select(
        digest_id("symbol", F.col("platform"), file, _detail(1), q, F.col("protocol")).alias("id"), "name", q.alias("qualified_name"), _detail(1).alias("kind"), file.alias("file_id"), "platform", F.lit("reader").alias("analyzer"),
        F.when(F.col("protocol") != "", "method").otherwise("top-level").alias("scope"), F.when(F.col("protocol") != "", "method").otherwise("definition").alias("role"), F.lit(True).alias("indexable"),
        F.nullif(_detail(3), F.lit("")).alias("signature"), F.nullif(_detail(4), F.lit("")).alias("doc"), F.col("r.start_line").alias("start_line"), F.col("r.end_line").alias("end_line"), "ns", "protocol",
    )
    return spaces.unionByName(vars_)


def _owned(observed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Uses with from_id: the symbol around them in their file and platform, else the file's namespace."""
    key = F.concat_ws("|", F.concat(F.lit("file:"), "path"), "platform")
    uses = observed.where(F.col("kind").isin("usage", "local-call", "require", "java", "protocol-impl", "topic")).withColumn("point_id", F.sha2(F.concat_ws("|", "path", "platform", "kind", "start_byte", F.coalesce("target_ns", F.lit("")), F.coalesce("target", F.lit(""))), 256)).withColumn("spot", key)
    spans = symbols.where(~F.col("kind").isin("namespace", "module")).select("id", F.concat_ws("|", "file_id", "platform").alias("file_id"), "start_line", "end_line")
    owners = owner_intervals(uses.select("point_id", F.col("spot").alias("file_id"), F.col("start_line").alias("line")), spans)
    home = symbols.where(F.col("kind").isin("namespace", "module")).groupBy(F.concat_ws("|", "file_id", "platform").alias("home_spot")).agg(F.min("id").alias("home"))
    return uses.join(owners, "point_id", "left").join(home, F.col("spot") == F.col("home_spot"), "left").withColumn("from_id", F.coalesce("owner", "home")).where("from_id is not null").drop("owner", "home", "home_spot")


def relations(uses: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, references) of uses with their owners. One definition of a target makes an exact edge, several an ambiguous reference, none an
    unresolved one in a namespace of the project, else an external one; a call through a local is dynamic."""
    u = uses.where("kind = 'usage'").where(~F.col("target").isin(*SUPPRESSED))
    defs = symbols.where(~F.col("kind").isin("namespace", "module"))
    d = defs.groupBy(F.col("platform").alias("d_platform"), F.col("ns").alias("d_ns"), F.col("name").alias("d_name")).agg(F.countDistinct("id").alias("n"), F.min("id").alias("to_id"), F.min_by("kind", "id").alias("to_kind"))
    known = symbols.select(F.col("platform").alias("k_platform"), F.col("ns").alias("k_ns")).distinct().withColumn("known", F.lit(True))
    j = u.join(d, (F.col("platform") == F.col("d_platform")) & (F.col("target_ns") == F.col("d_ns")) & (F.col("target") == F.col("d_name")), "left")
    j = j.join(known, (F.col("platform") == F.col("k_platform")) & (F.col("target_ns") == F.col("k_ns")), "left")
    plain = _detail(2) == "plain"
    core = F.when(F.col("platform") == "janet", "janet").when(F.col("platform") == "cljs", "cljs.core").otherwise("clojure.core")
    full = F.concat(F.when(plain & F.col("n").isNull(), core).otherwise(F.col("target_ns")), F.lit("/"), "target")
    kind = F.when(_detail(1) == "call", F.when(F.col("to_kind") == "macro", "macro-invokes").otherwise("calls")).otherwise("references")
    state = F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").when(plain, "external").when(F.col("known"), "unresolved").otherwise("external")
    j = j.withColumn("full", full).withColumn("rel", kind).withColumn("state", state).withColumn("line", F.col("start_line"))
    r = uses.where("kind = 'require'").withColumn("line", F.col("start_line"))
    spaces = symbols.where(F.col("kind").isin("namespace", "module")).groupBy(F.col("platform").alias("d_platform"), F.col("qualified_name").alias("d_ns")).agg(F.count("*").alias("n"), F.min("id").alias("to_id"))
    imports = r.join(spaces, (F.col("platform") == F.col("d_platform")) & (F.col("target_ns") == F.col("d_ns")), "left").withColumn("full", F.col("target_ns")).withColumn("rel", F.lit("imports")).withColumn("state", F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("external"))
    local = uses.where("kind = 'local-call'").withColumn("full", F.col("target")).withColumn("rel", F.lit("calls")).withColumn("state", F.lit("dynamic")).withColumn("line", F.col("start_line")).withColumn("to_id", F.lit(None).cast("string"))
    java = uses.where("kind = 'java'").withColumn("full", F.col("target")).withColumn("rel", _detail(1)).withColumn("state", _detail(2)).withColumn("line", F.col("start_line")).withColumn("to_id", F.lit(None).cast("string"))
    methods = symbols.where("protocol <> ''").groupBy(F.col("platform").alias("d_platform"), F.col("ns").alias("d_ns"), F.col("name").alias("d_name"), "protocol").agg(F.countDistinct("id").alias("n"), F.min("id").alias("to_id"))
    impl = uses.where("kind = 'protocol-impl'").join(methods, (F.col("platform") == F.col("d_platform")) & (F.col("target_ns") == F.col("d_ns")) & (F.col("target") == F.col("d_name")) & (F.col("detail") == F.col("protocol")), "left")
    impl = impl.withColumn("full", F.concat("target_ns", F.lit("/"), "target")).withColumn("rel", F.lit("protocol-implements")).withColumn("state", F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("external")).withColumn("line", F.col("start_line"))
    cols = ["from_id", "to_id", "rel", "state", "full", "line"]
    every = cut(reduce(DataFrame.unionByName, [x.select(*cols) for x in (j, imports, local, java, impl)]))
    home = symbols.where(F.col("kind").isin("namespace", "module")).select(F.col("id").alias("from_id"), F.col("ns").alias("c_ns"), F.col("file_id").alias("c_file"), F.col("platform").alias("c_platform"), F.col("start_line").alias("line"))
    held = defs.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("full"), "ns", "file_id", "platform")
    inside = held.join(home, (F.col("ns") == F.col("c_ns")) & (F.col("file_id") == F.col("c_file")) & (F.col("platform") == F.col("c_platform"))).select("from_id", "to_id", F.lit("contains").alias("rel"), F.lit("exact").alias("state"), "full", "line")
    exact = every.where("state = 'exact'").unionByName(inside)
    edges = exact.select(
        digest_id("edge", F.col("rel"), F.col("from_id"), F.col("to_id"), F.col("line")).alias("id"), F.col("rel").alias("kind"), "from_id", "to_id", F.lit("symbol").alias("to_type"), F.col("full").alias("target_text"),
        F.lit("exact").alias("resolution"), F.lit(1.0).alias("confidence"), F.lit("reader").alias("evidence"), "line",
    ).dropDuplicates(["id"])
    refs = every.where("state <> 'exact'").select(
        digest_id("reference", F.col("from_id"), F.col("rel"), F.col("full"), F.col("state"), F.col("line")).alias("id"), F.col("from_id").alias("symbol_id"), F.col("rel").alias("kind"), F.col("full").alias("target_text"), F.col("state").alias("classification"), F.lit("reader").alias("evidence"), "line",
    ).dropDuplicates(["id"])
    return edges, refs


def effects_of(edges: DataFrame, references: DataFrame, symbols: DataFrame) -> DataFrame:
    """Effects of calls by the first rule of their language that their whole target matches; others have none."""
    calls = edges.where("kind = 'calls'").select(F.col("from_id").alias("symbol_id"), "target_text", "line").unionByName(references.where("kind = 'calls'").select("symbol_id", "target_text", "line"))
    language = F.when(F.col("file_id").endswith(".cljc"), "cljc").otherwise(F.col("platform"))
    calls = calls.join(symbols.select(F.col("id").alias("s_id"), language.alias("language")), F.col("symbol_id") == F.col("s_id"))
    target = F.regexp_replace("target_text", r"\s+", "")
    target = F.when(F.col("language") == "cljs", F.regexp_replace(target, r"^clojure\.core/", "cljs.core/")).when(F.col("language") == "janet", F.regexp_replace(target, r"^janet\.core/", "")).otherwise(target)
    kind = confidence = F.when(F.lit(False), None)
    for name, rules in EFFECT_RULES.items():
        for pattern, k, c in rules:
            hit = (F.col("language") == name) & target.rlike(f"^(?:{pattern})$")
            kind, confidence = kind.when(hit, k), confidence.when(hit, c)
    e = calls.withColumn("kind", kind.cast("string")).withColumn("confidence", confidence.cast("double")).where("kind is not null")
    return e.select(digest_id("effect", F.col("symbol_id"), F.col("kind"), F.col("target_text"), F.col("line")).alias("id"), "kind", "symbol_id", F.col("target_text").alias("detail"), "confidence", "line").dropDuplicates(["id"])


def aggregates_of(observed: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aggregates, memberships) of vars whose value is a literal map, vector or set."""
    from pyspark.sql import Window

    s = symbols.where(F.col("kind").isin("variable", "constant")).select(F.col("id").alias("owner_id"), "file_id", F.col("platform").alias("s_platform"), F.col("name").alias("s_name"), F.col("ns").alias("s_ns"))
    own = (F.concat(F.lit("file:"), "path") == F.col("file_id")) & (F.col("platform") == F.col("s_platform")) & (F.col("ns") == F.col("s_ns")) & (F.col("name") == F.col("s_name"))
    last = observed.where("kind = 'aggregate'").groupBy("path", "platform", "ns", "name").agg(F.max_by(F.struct("detail", "start_line", "end_line", "start_byte", "end_byte"), "start_byte").alias("a"))
    a = last.join(s, own).withColumn("aggregate_id", digest_id("aggregate", F.col("owner_id"), F.col("a.detail")))
    m = observed.where("kind = 'member'").join(a.select("path", "platform", "ns", "name", "aggregate_id", "a"), ["path", "platform", "ns", "name"]).where("start_byte >= a.start_byte and end_byte <= a.end_byte")
    key = F.when(F.col("a.detail") == "map", _detail(3)).when(F.col("a.detail") == "set", F.col("target")).otherwise(F.lpad("start_byte", 12, "0"))
    m = m.withColumn("ordinal", F.row_number().over(Window.partitionBy("aggregate_id").orderBy(key, "start_byte")).cast("long") - 1)
    members = m.select(digest_id("membership", F.col("aggregate_id"), F.col("ordinal")).alias("id"), "aggregate_id", F.col("target").alias("value"), _detail(2).alias("value_kind"), "ordinal", _detail(1).alias("evidence"))
    facts = members.groupBy("aggregate_id").agg(F.count("*").alias("member_count"), F.bool_and(F.col("evidence") == "literal").alias("whole"), F.min("value_kind").alias("low"), F.max("value_kind").alias("high"), F.array_join(F.array_sort(F.collect_set("value")), " ").alias("values"))
    out = a.join(facts, "aggregate_id", "left").select(
        F.col("aggregate_id").alias("id"), "name", F.concat(F.lit("literal-"), "a.detail").alias("kind"), "owner_id", "file_id", F.when(F.coalesce("whole", F.lit(True)), "complete-static").otherwise("partial-static").alias("completeness"),
        F.coalesce("member_count", F.lit(0)).cast("long").alias("member_count"), F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("member_kind"), F.lit("reader").alias("analyzer"), F.concat_ws(" ", "name", "values").alias("search_text"),
        F.col("a.start_line").alias("start_line"), F.col("a.end_line").alias("end_line"),
    )
    return out, members


def topics_of(uses: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, edges to them, references). A call of a topic API with a literal key names that topic; with a computed one it
    is a dynamic reference. A plain name counts as the language's own only where the namespace has no such definition."""
    defs = symbols.select(F.col("platform").alias("d_platform"), F.col("ns").alias("d_ns"), F.col("name").alias("d_name"))
    plain = (_detail(5) == "plain") & (F.col("platform") == F.col("d_platform")) & (F.col("target_ns") == F.col("d_ns")) & (F.col("target") == F.col("d_name"))
    calls = uses.where("kind = 'topic' and platform = 'cljs'").join(defs, plain, "left_anti")
    names = F.create_map(*[F.lit(x) for k, te in TOPIC_APIS.items() for x in (k, F.array(*map(F.lit, te)))])
    api = names[F.concat("target_ns", F.lit("/"), "target")]
    t = cut(calls.select(
        F.col("from_id").alias("symbol_id"), "platform", F.col("start_line").alias("line"), "start_byte", F.coalesce(F.nullif(_detail(2), F.lit("")), api[0]).alias("topic_kind"),
        F.coalesce(F.nullif(_detail(1), F.lit("")), api[1]).alias("edge_kind"), F.nullif(_detail(3), F.lit("")).alias("key"), _detail(4).alias("said"),
    ).where("edge_kind is not null"))
    topic_id = digest_id("topic", F.col("topic_kind"), F.col("key"), F.col("platform"))
    known = t.where("key is not null")
    topics = known.select(topic_id.alias("id"), F.col("topic_kind").alias("kind"), "key", "platform").distinct()
    out = known.select(
        digest_id("edge", F.col("edge_kind"), F.col("symbol_id"), topic_id, F.col("line")).alias("id"), F.col("edge_kind").alias("kind"), F.col("symbol_id").alias("from_id"), topic_id.alias("to_id"), F.lit("topic").alias("to_type"), F.col("key").alias("target_text"),
        F.lit("exact").alias("resolution"), F.lit(1.0).alias("confidence"), F.lit("literal-form").alias("evidence"), "line",
    ).dropDuplicates(["id"])
    refs = t.where("key is null").select(
        digest_id("reference", F.col("symbol_id"), F.col("edge_kind"), F.col("said"), F.lit("dynamic"), F.col("line")).alias("id"), "symbol_id", F.col("edge_kind").alias("kind"), F.col("said").alias("target_text"),
        F.lit("dynamic").alias("classification"), F.lit("computed-topic").alias("evidence"), "line",
    ).dropDuplicates(["id"])
    return topics, out, refs


def materialize(files: DataFrame, observed: DataFrame) -> dict[str, DataFrame]:
    """All tables of the model from files (path, language, text, size, modified_at) and their observations.

    What feeds several tables is written once to the shared folder: observations, symbols, owned uses, relations, topics.
    """
    observed = cut(observed)
    with_ns = cut(symbols_table(observed))
    uses = cut(_owned(observed, with_ns))
    edges, refs = relations(uses, with_ns)
    aggregates, memberships = (cut(x) for x in aggregates_of(observed, with_ns))
    topics, topic_edges, computed = topics_of(uses, with_ns)
    out = {
        "files": files_table(files), "symbols": with_ns.drop("ns", "protocol"), "edges": edges.unionByName(topic_edges), "references": refs.unionByName(computed), "topics": topics,
        "effects": effects_of(edges, refs, with_ns), "aggregates": aggregates, "memberships": memberships,
    }
    return {name: df.select(*[c.split()[0] for c in SCHEMAS[name].split(", ")]) for name, df in out.items()}


def sources(spark, root: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """A project's source files to analyse, decoded."""
    from ..sources import files as S

    return S.decoded(S.discover(S.listing(spark, root), include, exclude).where("skipped is null"))


def observed_of(found: DataFrame, cache=None) -> DataFrame:
    """Observations of source files; with a cache (sources.manifest) only of those that it doesn't know."""
    from ..sources.lisp import observe

    code = found.where("language <> 'edn'").select("path", "text", "content_hash")
    return cache.observed(code, observe) if cache else observe(code)


def analyze(spark, root: str, include: list[str] | None = None, exclude: list[str] | None = None, cache=None) -> dict[str, DataFrame]:
    """A project's graph from its source files: discover, decode, observe, materialize."""
    found = sources(spark, root, include, exclude)
    return materialize(found, observed_of(found, cache))
