import math

import pytest
from pyspark.sql import functions as F

from lodestone.config import EngineConfig
from lodestone.engine import Engine
from lodestone.operators import indexing, synonyms
from lodestone.operators import search as sr
from lodestone.sources.llm_port import completion_client
from lodestone.sources.posts import POSTS, one_query

CAFE = {"timings": ["hours", "opening"]}


def frame(spark, rows):
    """rows of (id, type, status, title, content)."""
    from datetime import datetime, timedelta

    full = [(i, kind, status, title, content, "", "me", f"slug-{i}", f"https://e.com/{i}", datetime(2024, 1, 1) + timedelta(minutes=i)) for i, kind, status, title, content in rows]
    return spark.createDataFrame(full, POSTS)


ESPRESSO = [(1, "post", "publish", "Espresso Catering", "Espresso espresso catering bar for weddings and private events."), (2, "post", "publish", "Contact Our Team", "Reach us for general questions about the business.")]


def indexed(posts, config=EngineConfig()):
    tokens = indexing.tokenized(posts, config)
    return indexing.index_terms(tokens), indexing.index_docs(tokens)


def test_espresso_golden_scores(spark):
    terms, docs = indexed(frame(spark, ESPRESSO))
    assert {r.post_id: r.doc_length for r in docs.collect()} == {1: 16, 2: 12}
    for intent, score in (("support", 2.820135), ("informational", 3.666175)):
        hits = sr.search(one_query(spark, "espresso catering", ["post"], 2, intent), terms, docs).collect()
        assert [(h.post_id, h.score) for h in hits] == [(1, score)]


def test_synonyms_find_and_late_content_is_indexed(spark):
    late = "<p>filler words here</p>" * 120 + "<h2>Our Hours</h2><p>Tuesday 7:00 AM</p>"
    posts = frame(spark, [(1, "page", "publish", "Visit Our Cafe", "Our cafe opening hours are 8am to 5pm every weekday."), (2, "page", "publish", "Long", late), *[(i, "post", "publish", "Other", "nothing") for i in (3, 4)]])
    terms, docs = indexed(posts)
    query = one_query(spark, "cafe timings")
    assert [h.post_id for h in sr.search(query, terms, docs).collect()] == [1]
    expand = synonyms.expander(CAFE)
    batch = sr.prepared(query, expand)
    hits = sr.matched_terms(sr.ranked(batch, sr.of_tables(terms, docs, batch)), batch, terms)
    found = {r.post_id: r for r in sr.hydrate(hits, posts, batch).collect()}
    assert set(found) == {1, 2} and "Our HoursTuesday 7:00 AM" in found[2].excerpt and found[2].excerpt.startswith("...")


def test_batch_equals_single_queries_and_scores_grow_with_frequency(spark):
    rows = [(i, "post" if i % 3 else "page", "publish", f"title {i}", "alpha " * (i % 5) + "beta " * (i % 7) + "gamma") for i in range(1, 40)]
    terms, docs = indexed(frame(spark, rows))
    words = ["alpha", "beta gamma", "alpha beta", "none"]
    batch = spark.createDataFrame([(i, w, [], 7, "support") for i, w in enumerate(words)], "query_id long, query string, types array<string>, limit int, intent string")
    together = {(r.query_id, r.rank): (r.post_id, r.score) for r in sr.search(batch, terms, docs).collect()}
    alone = {(i, r.rank): (r.post_id, r.score) for i, w in enumerate(words) for r in sr.search(one_query(spark, w, [], 7, "support"), terms, docs).collect()}
    assert together == alone and len(together) == 21
    best = [together[0, r][1] for r in range(1, 8)]
    assert best == sorted(best, reverse=True)


def test_frequencies_count_types_but_totals_do_not(spark):
    rows = [(1, "post", "publish", "kiwi", "kiwi"), (2, "page", "publish", "kiwi", "kiwi"), (3, "page", "publish", "pear", "pear")]
    terms, docs = indexed(frame(spark, rows))
    score = sr.search(one_query(spark, "kiwi", ["post"], 5, "support"), terms, docs).first().score
    tf, idf = 3 + 2 + 1, math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert score == round(idf * tf * 2.5 / (tf + 1.5), 6)


def test_search_plan_is_native(spark):
    terms, docs = indexed(frame(spark, ESPRESSO))
    plan = sr.search(one_query(spark, "espresso"), terms, docs)._jdf.queryExecution().toString()
    # the names of operators: HTML has references like LeftArrow, which the plan holds as constants
    assert not any(x in plan for x in ("PythonUDF", "EvalPython", "InArrow", "InPandas")) and "WindowGroupLimit" in plan


@pytest.fixture
def engine(spark, tmp_path):
    rows = ESPRESSO + [(3, "page", "publish", "Contact", "Write to us any day."), (4, "post", "draft", "Espresso secret", "espresso")]
    state = {"posts": frame(spark, rows)}
    made = Engine(spark, str(tmp_path / "store"), lambda: state["posts"], EngineConfig(rebuild_batch_size=2))
    made.state = state
    return made


def test_rebuild_index_remove_and_pruned_scan(spark, engine):
    assert engine.status()["total_docs"] == 0 and engine.search("espresso") == []
    progress = engine.rebuild()
    assert progress["status"] == "complete" and progress["processed"] == progress["total"] == 3 and progress["finished_at"]
    assert [r.post_id for r in engine.search("espresso catering", limit=2)] == [1]
    plan = engine.store.terms(["espresso"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "In(term" in plan or "EqualTo(term" in plan
    engine.index(frame(spark, [(2, "post", "publish", "Espresso too", "espresso"), (1, "post", "draft", "x", "espresso")]))
    assert [r.post_id for r in engine.search("espresso")] == [2]
    engine.remove([2])
    assert engine.search("espresso") == [] and engine.status()["total_docs"] == 1


def test_incremental_maintenance_equals_a_rebuild(spark):
    rows = [(i, "post", "publish", f"t{i} word", f"alpha{i % 4} beta") for i in range(30)]
    new = [(i, "post", "publish" if i % 4 else "draft", f"t{i} other", f"alpha{i % 3} delta") for i in range(0, 30, 3)]
    terms, docs = indexed(frame(spark, rows))
    got = indexing.upsert(terms, docs, frame(spark, new).withColumns({"seq": F.lit(1), "op": F.lit("save")}))
    now = {r[0]: r for r in rows} | {r[0]: r for r in new}
    want = indexed(frame(spark, list(now.values())))
    assert sorted(map(tuple, got[0].collect())) == sorted(map(tuple, want[0].collect()))
    assert sorted(map(tuple, got[1].drop("indexed_at", "terms").collect())) == sorted(map(tuple, want[1].drop("indexed_at", "terms").collect()))


def test_frequencies_and_totals_follow_every_change(spark, engine, monkeypatch):
    """What is kept with the segments equals a full recount after each kind of change, and through a merge."""
    from lodestone.sources import store

    monkeypatch.setattr(store, "SEGMENTS", 3)

    def recounted():
        terms, docs = engine.store.terms(), engine.store.docs()
        df = {(r.term, r.post_type): r["count"] for r in terms.groupBy("term", "post_type").count().collect()}
        assert {(r.term, r.post_type): r.df for r in engine.store.frequencies().collect()} == df
        assert engine.store.totals() == (docs.count(), docs.agg(F.coalesce(F.sum("doc_length"), F.lit(0))).first()[0])
        assert indexing.status_of(engine.store).first().asDict() == indexing.index_status(terms, docs).first().asDict()

    recounted()
    engine.rebuild()
    recounted()
    for n in range(5):
        engine.index(frame(spark, [(2, ["post", "page"][n % 2], "publish", f"round {n}", "espresso"), (1, "post", ["publish", "draft"][n % 2], "x", "catering"), (10 + n, "post", "publish", "new", "bar")]))
        recounted()
    engine.remove([10, 11, 999])
    recounted()
    assert {r.df for r in engine.store.frequencies(["bar"]).collect()} == {3}


def test_registered_search_reads_its_terms_only(spark):
    """Ranking reads the stored postings and frequencies of its terms' buckets; no documents, and no job to plan it but one for the terms."""
    import os

    from lodestone.plans import queries
    from lodestone.sources.store import TERM_BUCKETS

    sf = "/root/testdata/sf0.001"
    queries.store(spark, sf)
    df = queries.bm25_search(spark, sf)
    files = [f for f in df.inputFiles() if "/terms-" in f or "/df-" in f or "/docs-" in f]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert files and not any("/docs-" in f for f in files)
    buckets = {os.path.basename(os.path.dirname(f)) for f in files}
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and ("/terms-" in line or "/df-" in line)]
    assert len(scans) == 2 and all("PartitionFilters: [" in s and "array_contains" in s and "In(term" in s for s in scans)
    read = spark.read.parquet(f"{queries.store(spark, sf).path}/terms-1").where(F.col("term").isin(queries.FLAGSHIP.split())).select("bucket").distinct().count()
    assert read <= 3 < TERM_BUCKETS and len(buckets) <= TERM_BUCKETS
    assert "BroadcastNestedLoopJoin" not in plan and "Cartesian" not in plan


def test_search_requests_are_guarded_and_limited(engine):
    engine.rebuild()
    engine.config = EngineConfig(search_rate_limit=2)
    assert engine.handle_search("", "1.2.3.4")["status"] == 400
    assert engine.handle_search("x" * 201, "1.2.3.4")["status"] == 400
    assert [engine.handle_search("espresso", "1.2.3.4")["status"] for _ in range(3)] == [200, 200, 429]
    assert engine.handle_search("espresso", "5.6.7.8")["results"][0]["id"] == 1


def test_fallbacks_and_a_turn(engine):
    engine.rebuild()
    engine.update_options(name="Cafe", url="https://e.com", description="We serve espresso.", ctas=[{"label": "Contact", "url": "https://e.com/3"}])
    record = engine.build_snapshot()
    assert record["quality_tier"] == "minimal" and record["site_mode"] == "personal_blog"
    assert [c["url"] for c in record["ctas_catalog"]] == ["https://e.com/2", "https://e.com/3"]
    assert engine.top_k("wedding", 1)[0].id == "1"
    assert engine.top_k("eddings", 1)[0].source == "overlap"
    assert engine.top_k("the", 2)[0].source == "recent"
    failed = engine.ask("Do you cater?", client="a")
    assert failed["answer"].startswith("The assistant is temporarily unavailable") and failed["needs_human"]
    prompts = []

    def model(prompt):
        prompts.append(prompt)
        if "intent" in prompt:
            return "transactional"
        return '{"answer":"Yes","ctas":[{"label":"","url":"https://e.com/3"},{"label":"x","url":"https://evil"}],"sources":[{"title":"","url":"https://e.com/1"}]}'

    engine.llm = model
    first = engine.ask("Do you offer catering?", client="a")
    assert first["answer"] == "Yes" and first["ctas"] == [{"label": "Contact", "url": "https://e.com/3"}] and first["sources"][0]["title"] == "Espresso Catering"
    engine.ask("And when?", first["conversation_id"], "a")
    assert "User: Do you offer catering?\nAssistant: Yes" in prompts[-1] and "=== SITE BRIEF (v: " in prompts[-1]
    assert engine.ask("x" * 501)["status"] == 400 and engine.ask(" ")["status"] == 400
    engine.config = EngineConfig(ip_rate_limit=2)
    assert engine.ask("More?", client="a")["throttled"]


def test_synonym_store_and_status(engine):
    engine.rebuild()
    assert engine.update_synonyms({"Gluten Free": "gf, celiac,gluten"}) == {"gluten": ["gf", "celiac"]}
    assert engine.synonyms()["gluten"] == ["gf", "celiac"]
    engine.llm = lambda prompt: '```json\n{"synonyms":{"coffee":["espresso"]}}\n```'
    assert engine.suggest_synonyms("llm") == {"coffee": ["espresso"], "espresso": ["coffee"]}
    engine.build_snapshot()
    status = engine.knowledge_status()
    assert status["corpus_count"] == 3 and [i["id"] for i in status["tier_checklist"]] == ["description", "content_count"]


def test_conversations_are_compacted(engine):
    engine._conversations["c"] = {"messages": [("user", f"m{i}") for i in range(13)], "summary": "", "last_seen": 0}
    engine.compact("c")
    assert len(engine._conversations["c"]["messages"]) == 13
    engine.llm = lambda prompt: " They asked. "
    engine.compact("c")
    assert engine._conversations["c"]["summary"] == "They asked." and engine._conversations["c"]["messages"] == [["user", f"m{i}"] for i in range(9, 13)]


def test_engines_share_limits_and_conversations(spark, engine):
    """Two engines of one path: what one counts or is told, the other knows."""
    engine.rebuild()
    engine.build_snapshot()
    prompts = []
    model = lambda prompt: prompts.append(prompt) or ("informational" if "intent" in prompt else '{"answer":"Yes"}')
    config = EngineConfig(search_rate_limit=2, breaker_threshold=2)
    one, other = (Engine(spark, engine.store.path, engine.posts, config, llm=model) for _ in range(2))
    assert [e.handle_search("espresso", "1.2.3.4")["status"] for e in (one, other, one, other)] == [200, 200, 429, 429]
    first = one.ask("Do you cater?", client="a")
    other.ask("And when?", first["conversation_id"], "b")
    assert "User: Do you cater?\nAssistant: Yes" in prompts[-1]
    one.llm = other.llm = lambda prompt: None
    assert [e.ask("Hello?", client="c")["breaker_open"] for e in (one, other)] == [False, True]


def test_shared_values_expire_and_lose_no_change(spark, tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from lodestone.sources import shared

    at = [100.0]
    values = [shared.SharedValues(spark, str(tmp_path / "v"), 10, lambda: at[0]) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda v: [v.update("k", lambda n: (n or 0) + 1) for _ in range(5)], values))
    assert values[0]["k"] == 20 and dict(values[1]) == {"k": 20}
    values[0]["other"] = {"x": [1]}
    at[0] += 5
    values[1]["other"] = {"x": [2]}
    at[0] += 6
    assert "k" not in values[2] and values[2].get("other") == {"x": [2]} and values[3].sweep() == 1
    monkeypatch.setattr(shared, "PATIENCE", 0.1)
    folder = values[0]._folder("other")
    values[0]._claimed(folder, 3)  # of a writer that died
    assert values[1].update("other", lambda v: v["x"]) == [2] and values[0]["other"] == [2]
    del values[0]["other"]
    assert len(values[1]) == 0


def test_completion_client():
    replies = {
        "a": (200, '{"status":"Success","payload":{"choices":[{"text":"x"}]}}'), "b": (200, '{"payload":{"text":"y"}}'), "c": (500, "{}"), "d": (200, "no json"), "e": (200, "[]"),
        "f": (200, '{"status":"Failure","payload":{"text":"oops"}}'), "g": (200, '{"choices":[{"text":"outside"}]}'), "h": (200, '{"payload":{"choices":[{"text":""}],"text":"z"}}'), "i": (200, '{"payload":{}}'),
    }
    ask = completion_client(lambda body: replies[body["prompt"]], "token", "site")
    assert [ask(p) for p in "abcdefghi"] == ["x", "y", None, None, None, None, None, "z", None]


def test_batch_rebuild_tracks_progress(engine):
    assert engine.rebuild_progress()["status"] == "idle"
    engine.start_rebuild()
    progress = engine.rebuild_progress()
    assert (progress["status"], progress["total"], progress["processed"]) == ("running", 3, 0) and engine.status()["limited_mode"]
    engine.process_rebuild_batch()
    assert engine.rebuild_progress()["processed"] == 2 and engine.status()["total_docs"] == 2
    progress = engine.process_rebuild_batch()
    assert (progress["status"], progress["processed"]) == ("complete", 3) and progress["finished_at"] and not engine.status()["limited_mode"]
    assert engine.process_rebuild_batch()["page"] == progress["page"]
    assert [r.post_id for r in engine.search("espresso catering", limit=2)] == [1]


def test_segments_hide_what_was_touched_and_merge(spark, engine, monkeypatch):
    from lodestone.sources import store

    monkeypatch.setattr(store, "SEGMENTS", 3)
    engine.rebuild()
    for n, word in enumerate(["kiwi", "plum", "pear", "fig", "lime"]):
        engine.index(frame(spark, [(2, "post", "publish", f"round {n}", "espresso"), (10 + n, "post", "publish", "new", word)]))
        assert len(engine.store.state()["segments"]) <= 4
    assert engine.status()["total_docs"] == 8 and [r.post_id for r in engine.search("round")] == [2]
    assert [r.post_id for r in engine.store.terms(["plum"]).collect()] == [11]  # from before the segments were merged


def test_pointer_survives_a_torn_write(spark, engine):
    engine.rebuild()
    before = engine.store.state()
    engine.store._fs.create(engine.store._path(f"{engine.store.path}/.index.torn"), True).close()
    assert engine.store.state() == before
    engine.store.put("x", 1)
    engine.store.put("x", 2)
    engine.store.put("x", 3)
    assert engine.store.get("x") == 3 and len(engine.store._versions("x")) == 2


def test_upkeep_feed_improve_and_prefill(spark, engine):
    at = [1000.0]
    engine.clock = lambda: at[0]
    assert engine.tick() == []
    engine.update_options(name="Cafe", phone="555", sections=["Menu", "Team"])
    engine.update_options(email="a@b.c")
    assert engine.tick() == []
    at[0] += 31
    assert engine.tick() == ["snapshot"] and engine.tick() == []
    assert engine.prefill()["facts"] == "Phone: 555\nEmail: a@b.c" and engine.prefill()["description"].startswith("Cafe")
    engine.index(frame(spark, [(20, "post", "publish", "Fresh roast", "beans"), (1, "post", "draft", "x", "y")]))
    assert [r.post_id for r in engine._corpus().orderBy("corpus_rank").collect()][-1] == 20 and engine._corpus().where("post_id = 1").isEmpty()
    engine.remove([20])
    assert engine._corpus().where("post_id = 20").isEmpty()
    assert engine.improve() == {"status": 502, "error": "ai_service_error"}
    engine.llm = lambda prompt: " We roast <b>coffee</b>. Come by. "
    assert engine.improve()["suggested_description"] == "We roast coffee. Come by." and engine.prefill()["description"] == "We roast coffee. Come by."
    engine._conversations["c"] = {"messages": [], "summary": "", "last_seen": 0}
    at[0] += 90_000
    assert engine.tick() == ["daily", "snapshot"] and engine._conversations == {}


def test_a_provider_and_a_retriever_stand_in(spark, engine):
    calls = []

    class Provider:
        def search(self, queries):
            return queries.selectExpr("query_id", "1 AS rank", "7L AS post_id")

        def index(self, posts):
            calls.append("index")

        def remove(self, post_ids):
            calls.append("remove")

        def rebuild(self, posts):
            calls.append("rebuild")
            return {"status": "complete"}

    class Found:
        def top_k(self, question, k=3):
            return [question] * k

    engine.provider, engine.retriever = Provider(), Found()
    engine.index(frame(spark, ESPRESSO))
    engine.remove([1])
    assert engine.rebuild() == {"status": "complete"} and calls == ["index", "remove", "rebuild"]
    assert engine.search("espresso")[0].post_id == 7 and engine.top_k("q", 2) == ["q", "q"]
    assert engine.store.state()["segments"] == []


def test_terms_are_counted_inside_a_post_without_a_sort_or_a_shuffle(spark):
    """an aggregate over exploded terms sorted all of them, in tasks whose memory grew with their files."""
    rows = [(1, "page", ["b", "a", "b"], ["a"], ["a0", "a", "b", "a0", "a0"]), (2, "post", [], [], []), (3, "post", [], [], ["z"])]
    tokens = spark.createDataFrame(rows, "post_id long, post_type string, title array<string>, excerpt array<string>, content array<string>")
    found = indexing.index_terms(tokens, once=True)
    want = [("a", 1, 1, 1, 1, "page", 9), ("a0", 1, 0, 0, 3, "page", 9), ("b", 1, 2, 0, 1, "page", 9), ("z", 3, 0, 0, 1, "post", 1)]
    assert sorted(map(tuple, found.collect())) == want
    assert sorted(map(tuple, indexing.index_terms(tokens).collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    assert indexing.single(tokens) and not indexing.single(tokens.unionByName(tokens))
    doubled = indexing.index_terms(tokens.unionByName(tokens)).where("term = 'a0'").first()
    assert (doubled.tf_title, doubled.tf_content) == (0, 6)


def test_batches_of_a_rebuild_by_one_write_are_those_of_many(spark, tmp_path):
    """a write and a look at the whole table for each batch took more time than there was."""
    rows = [(i, "post", "publish" if i % 4 else "draft", f"Title {i}" if i % 3 else "", "Seasonal menu." if i % 3 else "", "", "a", "s", "u", None) for i in range(1, 24)]
    posts = spark.createDataFrame(rows, POSTS)
    engines = [Engine(spark, str(tmp_path / n), lambda: posts, EngineConfig(rebuild_batch_size=5)) for n in "ab"]
    for engine in engines:
        engine.start_rebuild()
        engine.process_rebuild_batch()  # a rebuild may be taken on from anywhere
    each = []
    while engines[0].rebuild_progress()["status"] == "running":
        p = engines[0].process_rebuild_batch()
        each.append((p["page"], p["processed"], p["total"], p["status"], engines[0].status()["total_docs"]))
    writes = []
    append = engines[1].store.append
    engines[1].store.append = lambda *tables: (writes.append(1), append(*tables))
    at_once = engines[1].process_rebuild_batches()
    assert sorted(map(tuple, at_once.select("page", "processed", "total", "status", "total_docs").collect())) == each
    assert len(each) > 2 and len(writes) == 1
    a, b = (e.rebuild_progress() for e in engines)
    assert [(a[k], bool(a["finished_at"])) for k in ("status", "processed", "page", "total")] == [(b[k], bool(b["finished_at"])) for k in ("status", "processed", "page", "total")]
    assert sorted(map(tuple, engines[0].store.terms().collect())) == sorted(map(tuple, engines[1].store.terms().collect()))
    assert engines[1].process_rebuild_batches().isEmpty()


def test_changes_are_tokenized_once_and_sorted_only_if_a_post_repeats(spark):
    """F8, F9: both index tables tokenized the changes, and each sorted whole posts to find a post's last change."""
    rows = [(i, "post", "publish", f"Title {i}", "Seasonal menu.", "", "a", "s", "u", None, 1, "save") for i in range(4)]
    changes = spark.createDataFrame(rows, POSTS.simpleString()[7:-1].replace(":", " ") + ", seq int, op string")
    once = indexing.changed(changes)
    for table in once[:2]:
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "max_by" not in plan
    later = changes.where("post_id = 2").withColumn("op", F.lit("delete")).withColumn("seq", F.lit(2))
    terms, docs, touched = indexing.changed(changes.unionByName(later))
    assert sorted(r.post_id for r in docs.collect()) == [0, 1, 3] and touched.count() == 4
    assert {tuple(r) for r in terms.collect()} == {tuple(r) for r in once[0].where("post_id <> 2").collect()}


def test_matched_terms_rank_once(spark):
    """the ranking's plan stood twice in that of its matched terms."""
    tokens = spark.createDataFrame([(1, "page", ["menu"], ["menu"], ["menu", "bread"]), (2, "post", ["bread"], [], ["x1"])], "post_id long, post_type string, title array<string>, excerpt array<string>, content array<string>")
    terms, docs = indexing.index_terms(tokens), indexing.index_docs(tokens)
    batch = sr.prepared(one_query(spark, "bread menu"))
    hits = sr.ranked(batch, sr.of_tables(terms, docs, batch))
    found = sr.matched_terms(hits, batch, terms)
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.post_id: r.terms for r in found.collect()} == {1: ["bread", "menu"], 2: ["bread"]}


def test_a_batch_asked_once_ranks_posts_as_the_index_does(spark, tmp_path):
    from lodestone.sources.store import IndexStore

    rows = [(i, "post" if i % 3 else "page", "draft" if i % 11 == 0 else "publish", f"Title alpha{i}", "alpha " * (i % 5) + "Beta " * (i % 7) + "gammaDelta 12 " + "other " * 700 * (i % 2)) for i in range(1, 40)]
    posts = frame(spark, [*rows, rows[6], (50, "post", "publish", "", "")])
    words = ["alpha", "beta gamma", "delta alpha beta", "none", "other title", ""]
    asked = spark.createDataFrame([(i, w, ["page"] if i == 2 else [], 7, "support") for i, w in enumerate(words)], "query_id long, query string, types array<string>, limit int, intent string")
    batch = sr.prepared(asked)
    store = IndexStore(spark, str(tmp_path))
    store.write(*indexed(posts))
    shown = lambda found: sorted(map(tuple, sr.matched_terms(sr.ranked(batch, found), batch, found.terms).collect()), key=str)
    direct = sr.of_posts(posts, batch)
    assert shown(direct) == shown(sr.stored(store, batch)) and len(shown(direct)) > 20
    assert {r.term for r in direct.terms.select("term").collect()} <= set(batch.terms)
    nothing = sr.prepared(asked.where("query = ''"))
    assert sr.ranked(nothing, sr.of_posts(posts, nothing)).count() == 0
    assert sr.ranked(batch, sr.of_posts(posts.where("false"), batch)).count() == 0


def test_retrieval_of_one_batch_makes_no_index(spark, monkeypatch):
    from lodestone.plans import queries

    sf, name = "/root/testdata/sf0.001", ["query_id", "rank", "source", "id", "title", "url"]
    monkeypatch.setattr(queries, "_INDEXES", {})
    monkeypatch.setattr(queries, "_SUBSTRINGS", {})
    alone = sorted(map(tuple, queries.queries()["retrieve_topk"](spark, sf).select(name).collect()))
    assert not queries._INDEXES and not queries._SUBSTRINGS
    queries.store(spark, sf), queries.platform(spark, sf)
    assert alone == sorted(map(tuple, queries.queries()["retrieve_topk"](spark, sf).select(name).collect())) and alone


def test_a_merge_leaves_a_larger_segment_as_it_is(spark, tmp_path, monkeypatch):
    """Small writes after a large one are merged among themselves; the index stays the one of the last rows."""
    from lodestone.sources import store as st
    from lodestone.streaming.index import apply_changes

    monkeypatch.setattr(st, "SEGMENTS", 3)
    store = st.IndexStore(spark, str(tmp_path))
    now = {i: (i, "post", "publish", f"title {i}", " ".join(f"word{j}x" for j in range(i % 40, i % 40 + 20))) for i in range(60)}
    posts = frame(spark, list(now.values()))
    tokens = indexing.tokenized(posts)
    store.write(indexing.index_terms(tokens), indexing.index_docs(tokens))
    base = store.state()["segments"]
    for n in range(6):
        new = [(n, "page", "publish", f"again {n}", "fresh word"), (100 + n, "post", "publish", f"new {n}", "fresh"), (3, "post", "draft" if n % 2 else "publish", "third", "round")]
        now |= {r[0]: r for r in new}
        apply_changes(store, frame(spark, new).withColumns({"seq": F.lit(1), "op": F.lit("save")}))
        assert store.state()["segments"][:1] == base and len(store.state()["segments"]) <= 4
    touched = {r.post_id for n in store.state()["segments"][1:] for r in spark.read.schema(st.TOUCHED).parquet(f"{tmp_path}/touched-{n}").collect()}
    assert touched == {0, 1, 2, 3, 4, 5}  # those of the touched posts that were in the index before
    terms, docs = indexed(frame(spark, list(now.values())))
    assert sorted(map(tuple, store.terms().collect())) == sorted(map(tuple, terms.collect()))
    assert {(r.term, r.post_type): r.df for r in store.frequencies().collect()} == {(r.term, r.post_type): r["count"] for r in terms.groupBy("term", "post_type").count().collect()}
    assert store.totals() == docs.agg(F.count("*"), F.sum("doc_length")).first()
