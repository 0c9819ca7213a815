import pytest

from weftgraph import schema
from weftgraph.operators import extract, reads, traverse
from weftgraph.sources import lisp, store

A = '''(ns shop.core "Docs." (:require [shop.db :as db :refer [save!]] [clojure.string :as str]))
(declare later)
(def modes #{:rail :river})
(defn- helper [x] (str/trim x))
(defn ^:export run "Runs." [order]
  (let [f (fn [y] (inc y)) z (helper order)]
    (f z)
    (save! z)
    (println z)
    (missing-one z)
    (db/nothing z)))
(defn later [] (run 1))
(defmacro twice [x] `(do ~x ~x))
(defn user [] (twice (later)))
#_(defn hidden [] 1)
'''
B = '''(ns shop.db)
(defprotocol Store (put [this x]))
(defn save! [x] (swap! state assoc :x x))
(def state (atom {}))
'''
C = '''(ns ui.events (:require [re-frame.core :as rf]))
(rf/reg-event-db ::add (fn [db _] db))
(defn click [] (rf/dispatch [::add 1]))
#?(:cljs (defn only [] (click)) :clj (defn other [] 1))
'''
J = '''(import ./lib/util :as u)
# a comment (not code
(def table @{:a 1})
(defn main [x] (u/go x) (print `long "string`))
'''


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("src/shop/core.clj", "clojure", A), ("src/shop/db.clj", "clojure", B), ("src/ui/events.cljc", "clojure-common", C), ("main.janet", "janet", J), ("lib/util.janet", "janet", "(defn go [x] x)"), ("bad.clj", "clojure", "(ns bad) (defn x [")]
    files = spark.createDataFrame([(p, lang, t, len(t), 1) for p, lang, t in rows], "path string, language string, text string, size long, modified_at long")
    return extract.materialize(files, lisp.observe(files))


def test_reader():
    forms = lisp.Reader('(a #{1} #"re\\"x" \\( ^:m b #_ (x y) @c \'d) [1 2]').forms()
    assert [f.kind for f in forms] == ["list", "vector"] and len(forms[0].children) == 7
    for bad in ("(a", "a)", '"x', "[1}", "'"):
        with pytest.raises(lisp.Malformed):
            lisp.Reader(bad).forms()


def test_symbols(tables):
    s = {(r.qualified_name, r.platform): r for r in tables["symbols"].collect()}
    assert s["shop.core/run", "clj"].signature == "[order]" and s["shop.core/run", "clj"].doc == "Runs." and s["shop.core/run", "clj"].kind == "function"
    assert s["shop.core/twice", "clj"].kind == "macro" and s["shop.db/put", "clj"].role == "method" and s["shop.core", "clj"].doc == "Docs."
    assert ("ui.events/only", "cljs") in s and ("ui.events/other", "clj") in s and ("ui.events/only", "clj") not in s
    assert ("main/main", "janet") in s and ("shop.core/hidden", "clj") not in s and not any(q.startswith("bad") for q, _ in s)


def test_relations(tables):
    name = {r.id: r.qualified_name for r in tables["symbols"].collect()}
    e = {(name[r.from_id], r.kind, name.get(r.to_id, r.target_text)) for r in tables["edges"].collect()}
    assert {("shop.core/run", "calls", "shop.core/helper"), ("shop.core/run", "calls", "shop.db/save!"), ("shop.core/later", "calls", "shop.core/run"), ("shop.core/user", "macro-invokes", "shop.core/twice"), ("shop.core", "imports", "shop.db"), ("shop.core", "contains", "shop.core/run"), ("main/main", "calls", "lib/util/go"), ("main", "imports", "lib/util"), ("shop.db/save!", "references", "shop.db/state")} <= e
    r = {(name[x.symbol_id], x.target_text, x.classification) for x in tables["references"].collect()}
    assert {("shop.core/helper", "clojure.string/trim", "external"), ("shop.core/run", "f", "dynamic"), ("shop.core/run", "shop.db/nothing", "unresolved"), ("shop.core/run", "clojure.core/println", "external"), ("shop.core", "clojure.string", "external")} <= r
    assert not any(t.endswith("/let") for _, t, _ in r)


def test_effects_topics_aggregates(tables):
    name = {r.id: r.qualified_name for r in tables["symbols"].collect()}
    fx = {(name[r.symbol_id], r.kind) for r in tables["effects"].collect()}
    assert ("shop.core/run", "logging") in fx and not any(k == "global-mutation" and n.startswith("shop.") for n, k in fx)
    topics = {r.id: r.key for r in tables["topics"].collect()}
    assert set(topics.values()) == {":ui.events/add"}
    te = {(name[r.from_id], r.kind) for r in tables["edges"].where("to_type = 'topic'").collect()}
    assert te == {("ui.events", "topic-registers"), ("ui.events/click", "event-dispatches")}
    agg = {name[r.owner_id]: r for r in tables["aggregates"].collect()}
    assert agg["shop.core/modes"].completeness == "complete-static" and agg["shop.core/modes"].member_count == 2
    m = sorted((r.ordinal, r.value) for r in tables["memberships"].where(f"aggregate_id = '{agg['shop.core/modes'].id}'").collect())
    assert m == [(0, ":rail"), (1, ":river")]


def test_graph_is_sound_and_can_be_stored(spark, tables, tmp_path):
    schema.check(tables)
    g = store.Store(spark, f"file://{tmp_path}/s").write(tables)
    run = g.symbols.where("qualified_name = 'shop.core/run'")
    assert [r.qualified_name for r in reads.callers(g, run).collect()] == ["shop.core/later"]
    assert {r.qualified_name for r in traverse.trace(g, g.symbols.where("qualified_name = 'shop.core/user'")).results.collect()} >= {"shop.core/later", "shop.core/run", "shop.db/save!"}


def test_analyze(spark, tmp_path):
    (tmp_path / "src/shop").mkdir(parents=True)
    (tmp_path / "src/shop/core.clj").write_text(A)
    (tmp_path / "src/shop/db.clj").write_text(B)
    t = extract.analyze(spark, str(tmp_path))
    assert {r.path for r in t["files"].collect()} == {"src/shop/core.clj", "src/shop/db.clj"} and t["edges"].count() > 5


T = '''(ns ui.state (:require [re-frame.core :as rf :refer [reg-fx]] [ui.names :as names]))
(def state (atom {}))
(def plain {})
(rf/reg-event-db ::save (fn [db [_ x]] (assoc db :saved x)))
(reg-fx :http (fn [_] 1))
(rf/reg-sub ::names/all (fn [db _] (get db :hidden)))
(defn go [k] (rf/dispatch [k 1]) (rf/dispatch-sync [::save]))
(defn read-it [] (get-in @state [:a :b]) (get plain :none) (get @state k))
(defn write-it [] (swap! state assoc :path 1) (reset! state {}))
(defn mine [get] (get state :shadowed))
'''
U = '''(ns ui.own)
(def box (atom nil))
(defn swap! [a f] a)
(defn use-it [] (swap! box inc))
'''
V = '''(ns net.box (:require [shop.db :as db]) (:import [java.io File] java.util.Date))
(defrecord Box [items]
  db/Store
  (put [this x] (helper x items))
  Object
  (toString [_] "box"))
(defn helper [x y] x)
(extend-type File db/Store (put [this x] (.getName this)))
(extend-protocol db/Store Date (put [d x] (Math/abs x)))
(defn make [p] (File. p) (reify db/Store (put [_ x] (File/createTempFile p x))))
'''


@pytest.fixture(scope="module")
def more(spark):
    rows = [("src/ui/state.cljs", T), ("src/ui/own.cljs", U), ("src/net/box.clj", V), ("src/shop/db.clj", B)]
    files = spark.createDataFrame([(p, "clojure", t, len(t), 1) for p, t in rows], "path string, language string, text string, size long, modified_at long")
    t = extract.materialize(files, lisp.observe(files))
    schema.check(t)
    return t


def test_topics_and_state(more):
    name = {r.id: r.qualified_name for r in more["symbols"].collect()}
    topic = {r.id: (r.kind, r.key) for r in more["topics"].collect()}
    got = {(name[r.from_id], r.kind, *topic[r.to_id]) for r in more["edges"].where("to_type = 'topic'").collect()}
    assert got == {
        ("ui.state", "topic-registers", "event", ":ui.state/save"), ("ui.state", "state-writes", "state-key", ":saved"), ("ui.state", "topic-registers", "effect", ":http"),
        ("ui.state", "topic-registers", "subscription", ":ui.names/all"), ("ui.state/go", "event-dispatches", "event", ":ui.state/save"), ("ui.state/read-it", "state-reads", "state-key", "[:a :b]"),
        ("ui.state/read-it", "state-reads", "state-key", "atom:state"), ("ui.state/write-it", "state-writes", "state-key", "atom:state"), ("ui.state/write-it", "state-writes", "state-key", ":path"),
    }
    computed = {(name[r.symbol_id], r.kind, r.target_text) for r in more["references"].where("evidence = 'computed-topic'").collect()}
    assert computed == {("ui.state/go", "event-dispatches", "[k 1]"), ("ui.state/read-it", "state-reads", "k")}


def test_protocols_and_java(more):
    name = {r.id: r.qualified_name for r in more["symbols"].collect()}
    done = sorted((name[r.from_id], name[r.to_id]) for r in more["edges"].where("kind = 'protocol-implements'").collect())
    assert done == [("net.box", "shop.db/put"), ("net.box", "shop.db/put"), ("net.box/Box", "shop.db/put"), ("net.box/make", "shop.db/put")]
    calls = {(name[r.from_id], name[r.to_id]) for r in more["edges"].where("kind = 'calls'").collect()}
    assert ("net.box/Box", "net.box/helper") in calls and not any(t == "shop.db/put" for _, t in calls)
    java = {(name[r.symbol_id], r.kind, r.target_text, r.classification) for r in more["references"].collect() if r.target_text.startswith((".", "java."))}
    assert {("net.box", "references", "java.io.File", "external"), ("net.box", "references", "java.util.Date", "external"), ("net.box", "calls", ".getName", "dynamic"), ("net.box", "calls", "java.lang.Math/abs", "dynamic"), ("net.box/make", "references", "java.io.File", "external"), ("net.box/make", "calls", "java.io.File/createTempFile", "dynamic")} == java
    assert ("net.box/Box", "protocol-implements", "net.box/toString", "external") in {(name[r.symbol_id], r.kind, r.target_text, r.classification) for r in more["references"].collect()}


def test_offsets_in_a_long_file():
    text = "(ns a)\n" + "(def é \"ü\")\n(f é)\n" * 20_000
    rows = lisp.Observer("a.clj", text, "clj").run()
    last = max(r[12] for r in rows)
    assert text.encode()[last:].decode().rstrip() == "é)" and len(rows) > 60_000
