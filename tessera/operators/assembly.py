"""Operators that put records together: vocabulary expansion, facts of answers, tags, outlines, manuscripts, trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.planning import long_tokens
from tessera.functions.text import evidence_token
from tessera.operators import graph
from tessera.session import kept

#: A fact's category with its confidence and its importance.
CATEGORIES = {
    "scientific_question": (0.90, 1.00), "hypothesis": (0.82, 0.95), "prediction": (0.72, 0.75), "objective": (0.85, 0.90), "work_package": (0.78, 0.82),
    "analysis_plan": (0.80, 0.82), "reproducibility": (0.85, 0.80), "assumption": (0.60, 0.72), "limitation": (0.75, 0.78), "risk": (0.78, 0.86),
    "safety": (0.92, 1.00), "evidence_gap": (0.88, 0.88), "user_preference": (1.0, 0.95), "chosen_direction": (1.0, 1.0),
}
#: Where an answer's JSON holds facts, in order (part, field, category, whether it is a list).
FACT_FIELDS = [
    ("question_agent", "scientific_question", "scientific_question", False), ("question_agent", "hypothesis", "hypothesis", False),
    ("question_agent", "predictions", "prediction", True), ("question_agent", "assumptions", "assumption", True), ("question_agent", "evidence_gaps", "evidence_gap", True),
    ("experiment_agent", "design_summary", "objective", False), ("experiment_agent", "objectives", "objective", True), ("experiment_agent", "analysis_plan", "analysis_plan", True),
    ("experiment_agent", "reproducibility_plan", "reproducibility", True), ("experiment_agent", "evidence_gaps", "evidence_gap", True), ("experiment_agent", "safety_flags", "safety", True),
    ("experiment_agent", "work_packages", "work_package", True), ("critic_agent", "limitations", "limitation", True), ("critic_agent", "feasibility_risks", "risk", True),
    ("critic_agent", "fatal_flaws", "risk", True), ("critic_agent", "safety_flags", "safety", True), ("coordinator", "safety_flags", "safety", True),
]
#: Headings of a summary, in order.
HEADINGS = {
    "scientific_question": "科学问题", "hypothesis": "核心假设", "objective": "研究目标", "work_package": "实验工作包", "analysis_plan": "分析计划", "reproducibility": "可重复性",
    "limitation": "局限", "risk": "风险", "safety": "安全与伦理", "evidence_gap": "证据缺口", "user_preference": "用户实验偏好", "chosen_direction": "已选研究方向",
}


def expanded(queries: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = 4) -> DataFrame:
    """(key, expanded, added): queries with up to ``most`` labels that share a word's first four letters with them and add a word.

    Labels with more pairs of like words go first, ties by name. They meet the
    queries by those letters, and each of ``most`` rounds gives every query its
    next label, so that no query's labels are gathered. Null texts stay null,
    without labels.
    """
    q = queries.select(key, text, long_tokens(F.col(text)).alias("_known"))
    names = labels.select(F.trim(label).alias("_label")).where("_label <> ''").distinct().withColumn("_words", F.array_distinct(F.split(F.lower("_label"), r"\s+")))
    stems = lambda words: F.explode(F.transform(words, lambda w: F.substring(w, 1, 4))).alias("_stem")
    left = q.select(key, stems(F.col("_known"))).groupBy(key, "_stem").agg(F.count("*").alias("_a"))
    right = names.select("_label", stems(long_tokens(F.col("_label")))).groupBy("_label", "_stem").agg(F.count("*").alias("_b"))
    pairs = kept(left.join(right, "_stem").groupBy(key, "_label").agg(F.sum(F.col("_a") * F.col("_b")).alias("_overlap")).join(names, "_label"))
    none = F.array().cast("array<string>")
    state = q.select(key, text, F.coalesce("_known", none).alias("_known"), none.alias("_added"))
    for _ in range(most):
        fresh = pairs.join(state.select(key, "_known"), key).where(F.size(F.array_except("_words", "_known")) > 0)
        best = fresh.groupBy(key).agg(F.min(F.struct(-F.col("_overlap"), F.lower("_label"), "_label", "_words")).alias("_best"))
        state = state.join(best, key, "left").select(
            key, text,
            F.when(F.col("_best").isNull(), F.col("_known")).otherwise(F.array_union("_known", "_best._words")).alias("_known"),
            F.when(F.col("_best").isNull(), F.col("_added")).otherwise(F.array_append("_added", F.col("_best._label"))).alias("_added"),
        )
    added = F.array_join("_added", " ")
    return state.select(key, F.when(F.size("_added") > 0, F.concat(F.col(text), F.lit(" "), added)).otherwise(F.col(text)).alias("expanded"), F.col("_added").alias("added"))


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def payload_facts(answers: DataFrame, key: str, payload: str, most: int = 80) -> DataFrame:
    """(key, place, category, statement, field_path, evidence_ids, confidence, importance): facts of each answer's JSON payload.

    The same statement of a category, in lower case, counts once, where it
    comes first; ``most`` facts an answer. Unreadable payloads have none. Each
    row is an answer of its own, whose facts are found in the row.
    """
    parts: dict[str, dict[str, str]] = {}
    for part, field, category, many in FACT_FIELDS:
        parts.setdefault(part, {})[field] = "array<string>" if many else "string"
    schema = ", ".join(f"{p} struct<{', '.join(f'{f}: {k}' for f, k in fields.items())}>" for p, fields in parts.items())
    parsed = answers.select(key, F.from_json(payload, f"{schema}, selected_direction_id string, preference_profile map<string, variant>").alias("_p"))
    no_ids = F.array().cast("array<string>")

    def fact(category: str, statement: Column, path: Column, ids: Column = no_ids) -> Column:
        return F.struct(F.lit(category).alias("category"), statement.alias("statement"), path.alias("field_path"), F.coalesce(ids, no_ids).alias("evidence_ids"))

    def each(items: Column, category: str, path: str, statement, ids=lambda x: no_ids) -> Column:
        found = F.transform(items, lambda x, i: fact(category, statement(x), F.concat(F.lit(f"{path}["), i.cast("string"), F.lit("]")), ids(x)))
        return F.coalesce(found, F.array())

    found = []
    for part, field, category, many in FACT_FIELDS:
        value = F.col(f"_p.{part}.{field}")
        if category == "work_package":
            text = lambda x: F.array_join(F.filter(F.array(_plain(x["title"]), _plain(x["purpose"]), _plain(x["approach"])), lambda v: v != ""), " — ")
            # each by itself, so that one that is no object doesn't spoil the others
            packages = F.transform(value, lambda x: F.from_json(x, "title string, purpose string, approach string, evidence_ids array<string>"))
            found.append(each(packages, category, f"{part}.{field}", text, lambda x: x["evidence_ids"]))
        elif many:
            found.append(each(value, category, f"{part}.{field}", _plain))
        else:
            found.append(F.array(fact(category, _plain(value), F.lit(f"{part}.{field}"))))
    found.append(F.array(fact("chosen_direction", _plain(F.col("_p.selected_direction_id")), F.lit("selected_direction_id"))))
    stated = F.transform(F.map_entries("_p.preference_profile"), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    stated = F.filter(stated, lambda e: e["v"].isNotNull() & ~e["v"].isin("null", '""', "[]"))
    found.append(F.coalesce(F.transform(stated, lambda e: fact("user_preference", F.concat(e["k"], F.lit(": "), e["v"]), F.concat(F.lit("preference_profile."), e["k"]))), F.array()))

    listed = parsed.select(key, F.filter(F.concat(*found), lambda f: f["statement"] != "").alias("_all"))
    # no category has a character 0
    low = listed.withColumn("_low", F.transform("_all", lambda f: F.concat(f["category"], F.lit("\0"), F.lower(f["statement"]))))
    first = low.select(key, "_all", "_low", F.posexplode(F.slice(F.array_distinct("_low"), 1, most)).alias("_at", "_one"))
    placed = first.select(key, (F.col("_at") + 1).alias("place"), F.element_at("_all", F.array_position("_low", F.col("_one")).cast("int")).alias("_f")).select(key, "place", "_f.*")
    table = lambda at: F.create_map(*[F.lit(x) for c, v in CATEGORIES.items() for x in (c, v[at])])[F.col("category")]
    return placed.select(key, "place", "category", "statement", "field_path", "evidence_ids", table(0).alias("confidence"), table(1).alias("importance"))


def session_summaries(facts: DataFrame, sessions: DataFrame, key: str, each: int = 8) -> DataFrame:
    """(key, summary, fact_count): sessions(key, title, turn_number) as Markdown, with up to ``each`` statements of a category under its heading.

    Facts have a place in their session, as ``payload_facts`` limits them.
    """
    order = F.create_map(*[F.lit(x) for i, c in enumerate(HEADINGS) for x in (c, i)])
    names = F.create_map(*[F.lit(x) for c, h in HEADINGS.items() for x in (c, h)])
    nth = F.row_number().over(Window.partitionBy(key, "category").orderBy("place"))
    shown = (F.col("_n") <= each) & F.col("category").isin(list(HEADINGS))
    line = F.concat(F.when(F.col("_n") == 1, F.concat(F.lit("\n## "), names[F.col("category")], F.lit("\n"))).otherwise(""), F.lit("- "), F.col("statement"))
    lines = F.collect_list(F.when(shown, F.struct(order[F.col("category")].alias("o"), F.col("_n").alias("n"), line.alias("line"))))
    body = facts.withColumn("_n", nth).groupBy(key).agg(F.sort_array(lines).alias("_lines"), F.count("*").alias("fact_count"))
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n截至第 "), F.col("turn_number").cast("string"), F.lit(" 轮的确定性摘要。"))
    text = F.concat_ws("\n", head, F.transform("_lines", lambda x: x["line"]))
    return sessions.join(body, key, "left").select(key, text.alias("summary"), F.coalesce("fact_count", F.lit(0)).alias("fact_count"))


def context_packs(summaries: DataFrame, facts: DataFrame, recalled: DataFrame, key: str, most_facts: int = 20, most_recalled: int = 8) -> DataFrame:
    """(key, pack): the summary, the weightiest facts and the best recalled items(key, item, score) of each session as one text.

    Facts go by importance, confidence, latest update, recalled items by score;
    ties by text. Sections without lines are left out.
    """

    def lines(rows: DataFrame, order: list[Column], text: str, most: int, heading: str, name: str) -> DataFrame:
        best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order, text))).where(F.col("_n") <= most)
        listed = F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(text).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"]))
        return best.groupBy(key).agg(F.concat(F.lit(f"## {heading}\n"), F.array_join(listed, "\n")).alias(name))

    f = lines(facts, [F.desc("importance"), F.desc("confidence"), F.desc("updated_at")], "statement", most_facts, "Facts", "_facts")
    r = lines(recalled, [F.desc("score")], "item", most_recalled, "Recalled", "_recalled")
    return summaries.join(f, key, "left").join(r, key, "left").select(key, F.concat_ws("\n\n", "summary", "_facts", "_recalled").alias("pack"))


def auto_tags(papers: DataFrame, terms: DataFrame, assets: DataFrame, existing: DataFrame) -> DataFrame:
    """(paper_id, name, kind, origin): the tags of papers(paper_id, publication_types, curated) after tagging by rule.

    Wanted are eight terms(paper_id, label, major), major ones first, four
    publication types, and what assets(paper_id, source, depth) say; a name
    once, in lower case. They replace tags of origin auto, but for keywords of
    PDFs; a tag that is already there by hand isn't doubled. Curated papers
    keep the tags that they have.
    """
    def row(name, kind: str, place: Column) -> list[Column]:
        return [F.col("paper_id"), (F.col(name) if isinstance(name, str) else name).alias("name"), F.lit(kind).alias("kind"), place.cast("int").alias("place")]

    by = Window.partitionBy("paper_id").orderBy(F.desc("major"), "label")
    wanted = terms.withColumn("n", F.row_number().over(by)).where("n <= 8").select(*row("label", "mesh", F.col("n")))
    types = papers.select("paper_id", F.posexplode(F.slice("publication_types", 1, 4)).alias("n", "type"))
    held = assets.groupBy("paper_id").agg(*[F.bool_or(F.coalesce(F.col(c) == v, F.lit(False))).alias(n) for c, v, n in (("source", "user_pdf", "pdf"), ("depth", "fulltext_xml", "full"), ("depth", "abstract", "abstract"))])
    depth = F.when(F.col("full"), "Open Full Text").when(F.col("abstract"), "Abstract")
    wanted = wanted.union(types.select(*row("type", "publication_type", F.col("n") + 100))).union(held.where("pdf").select(*row(F.lit("User PDF"), "source", F.lit(200)))).union(held.select(*row(depth, "evidence_depth", F.lit(300))))
    low = F.lower(F.trim("name"))
    once = wanted.where(low != "").groupBy("paper_id", low.alias("low")).agg(F.min(F.struct("place", F.trim("name").alias("name"), "kind")).alias("m")).select("paper_id", "m.name", "m.kind", F.lit("auto").alias("origin"))
    by_hand = papers.where("curated").select("paper_id")
    stay = existing.join(by_hand.withColumn("_c", F.lit(True)), "paper_id", "left").where("_c or origin <> 'auto' or kind = 'pdf_keyword'").select("paper_id", "name", "kind", "origin")
    fresh = once.join(papers.where("not coalesce(curated, false)").select("paper_id"), "paper_id", "left_semi").join(stay.select("paper_id", "name", "kind"), ["paper_id", "name", "kind"], "left_anti")
    return stay.union(fresh)


def audit_trail(collections: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """(key, kind, place, record): the rows of several collections, each kind numbered in its own order within a run; record is JSON."""
    out = None
    for kind, (rows, order) in collections.items():
        place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
        each = rows.select(key, F.lit(kind).alias("kind"), place.alias("place"), F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("record"))
        out = each if out is None else out.union(each)
    return out


def outline_changes(outline: DataFrame, existing: DataFrame, session: str) -> DataFrame:
    """(session, section_key, ordinal, title, parent_key, action): a new outline(session, ordinal, section_key, parent_key, title) against existing(session, section_key).

    Keys become letters, digits, _ and -, 96 of them at most; one that is
    taken, or nothing, gets its number. Parents are renamed alike, the last
    section of a name counting, and are null where there is none. Sections are
    inserted, updated or deleted.
    """
    slug = F.left(F.regexp_replace(F.regexp_replace("section_key", "[^a-zA-Z0-9_-]+", "-"), "^-+|-+$", ""), F.lit(96))
    listed = outline.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.coalesce(slug, F.lit("")).alias("slug"), "section_key", "parent_key", "title"))).alias("_all"))

    def step(keys: Column, x: Column) -> Column:
        number = (x["ordinal"] + 1).cast("string")
        name = F.when(x["slug"] == "", F.concat(F.lit("section-"), number)).otherwise(x["slug"])
        return F.array_append(keys, F.when(F.array_contains(keys, name), F.concat(name, F.lit("-"), number)).otherwise(name))

    # an outline is one document's list of headings
    keyed = listed.withColumn("_keys", F.aggregate("_all", F.array().cast("array<string>"), step)).select(session, F.explode(F.arrays_zip("_all", "_keys")).alias("z")).select(session, "z._all.*", F.col("z._keys").alias("key"))
    named = keyed.groupBy(F.col(session).alias("_in"), F.col("section_key").alias("_raw")).agg(F.max_by("key", "ordinal").alias("_renamed"))
    known = keyed.select(F.col(session).alias("_at"), F.col("key").alias("_parent")).distinct()
    up = keyed.join(named, (F.col(session) == F.col("_in")) & (F.col("parent_key") == F.col("_raw")), "left").withColumn("_up", F.coalesce("_renamed", F.nullif("parent_key", F.lit(""))))
    up = up.join(known, (F.col(session) == F.col("_at")) & (F.col("_up") == F.col("_parent")), "left").select(session, F.col("key").alias("section_key"), "ordinal", "title", F.col("_parent").alias("parent_key"))
    old = existing.select(session, "section_key", F.lit(True).alias("_old")).distinct()
    action = F.when(F.col("ordinal").isNull(), "delete").when(F.col("_old"), "update").otherwise("insert")
    return up.join(old, [session, "section_key"], "full").select(session, "section_key", "ordinal", "title", "parent_key", action.alias("action"))


def manuscripts(sections: DataFrame, titles: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """(key, markdown, evidence_ids): each document of sections(key, ordinal, draft, evidence_ids, source_ids) under its title.

    Drafts stand in order, empty ones left out; evidence ids once, in order of
    use; at the end the used sources(source_id, filename) that exist, by id.
    """
    used = sections.select(key, F.explode("source_ids").alias("source_id")).distinct().join(sources, "source_id")
    line = F.concat(F.lit("- [SRC:"), F.col("source_id").cast("string"), F.lit("] "), F.col("filename"))
    listed = used.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_id", line.alias("t")))), lambda x: x["t"]), "\n").alias("_sources"))
    body = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.trim("draft").alias("draft"), "evidence_ids"))).alias("_s"))
    drafts = F.array_join(F.filter(F.transform("_s", lambda x: x["draft"]), lambda d: d != ""), "\n\n")
    ids = F.array_distinct(F.flatten(F.filter(F.transform("_s", lambda x: x["evidence_ids"]), lambda e: e.isNotNull())))
    whole = F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.nullif(drafts, F.lit("")), F.concat(F.lit("## 本地资料来源\n\n"), F.col("_sources"))), F.lit("\n"))
    return titles.join(body, key, "left").join(listed, key, "left").select(key, whole.alias("markdown"), F.coalesce(ids, F.array().cast("array<string>")).alias("evidence_ids"))


def snapshot_sources(notes: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """(key, digest, content, copies): the first note of each text, by hash, of every session."""
    named = notes.where(F.col(content).isNotNull()).withColumn("digest", F.sha2(content, 256))
    return named.groupBy(key, "digest").agg(F.min_by(F.col(content), order).alias(content), F.count("*").alias("copies"))


def drift(edges: DataFrame, labels: DataFrame, seeds: DataFrame, depth: int, limit: int, most: int = 8) -> DataFrame:
    """(id, score, distance, rank): a local search from all members of the ``most`` communities that hold most of seeds(id), ties by name.

    labels(id, community); seeds without a community stand for themselves.
    """
    mine = seeds.select("id").distinct().join(labels, "id", "left")
    best = mine.where("community is not null").groupBy("community").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "community").limit(most)
    wide = labels.join(F.broadcast(best), "community", "left_semi").select("id").union(mine.where("community is null").select("id")).distinct()
    return graph.local_search(edges, wide, depth, limit)


#: Groups of routes with their weights that an ablation compares, and which of them rerank.
ABLATIONS = {
    "G0_pure_dense": {"dense_original": 1.0},
    "G1_pure_lexical": {"fts_english": 1.0, "simple": 0.5},
    "G2_naive_hybrid": {"dense_original": 1.0, "fts_english": 1.0},
    "G3_with_query_planning": {"dense_original": 1.0, "dense_translated": 0.9, "fts_english": 1.0},
    "G4_with_mesh_expansion": {"dense_original": 1.0, "dense_translated": 0.9, "fts_english": 1.0, "mesh": 0.7},
    "G5_7_route_weighted_rrf": {"exact": 1.2, "dense_original": 1.0, "dense_translated": 0.9, "fts_english": 0.8, "mesh": 0.7, "metadata": 0.6, "graph_local": 0.3},
    "G6_full_with_reranker": {"exact": 1.2, "dense_original": 1.0, "dense_translated": 0.9, "fts_english": 0.8, "mesh": 0.7, "metadata": 0.6, "graph_local": 0.3},
}
RERANKED = ["G6_full_with_reranker"]


def ablations(routes: DataFrame, item: str, groups: dict[str, dict[str, float]] | None = None, reranks: DataFrame | None = None, share: float = 0.65, k: int = 60, keep: int | None = None, parts: int | None = None) -> DataFrame:
    """(config, query_id, item, score, rank): routes(query_id, route, item, rank) fused by the weights of each group, all groups in one pass.

    In the groups of RERANKED, reranks(query_id, item, relevance), from 0 to 1,
    are blended in by ``share`` with scores over the query's best. Routes
    without a weight in a group take no part in it; of an item's relevances
    the largest counts. Queries are dealt out to ``parts`` tasks; routes that
    are dealt out so already stay where they are.
    """
    groups = ABLATIONS if groups is None else groups
    route = dict(routes.dtypes)["route"]
    rows = routes.select("query_id", item, "route", "rank", F.lit(None).cast("double").alias("relevance"))
    if reranks is not None:
        rows = rows.union(reranks.select("query_id", item, F.lit(None).cast(route), F.lit(None).cast(dict(routes.dtypes)["rank"]), F.col("relevance").cast("double")))
    # an item's scores in all groups are sums of one row, which is laid out by groups where it was summed
    part = lambda some: F.sum(F.coalesce(*[F.when(F.col("route") == r, F.lit(float(w)) / (k + F.col("rank"))) for r, w in some.items()]))
    summed = rows.groupBy("query_id", item).agg(F.max("relevance").alias("relevance"), *[part(some).alias(f"_g{i}") for i, some in enumerate(groups.values())])
    dealt = summed.repartition(*([parts] if parts else []), "query_id")
    each = F.array(*[F.struct(F.lit(g).alias("config"), F.col(f"_g{i}").alias("score")) for i, g in enumerate(groups)])
    fused = dealt.select("query_id", item, "relevance", F.inline(each)).where("score IS NOT NULL")
    if reranks is not None:
        relative = F.col("score") / F.max("score").over(Window.partitionBy("config", "query_id"))
        blended = F.coalesce(share * F.col("relevance"), F.lit(0.0)) + (1 - share) * relative
        fused = fused.withColumn("score", F.when(F.col("config").isin(RERANKED), blended).otherwise(F.col("score")))
    rank = F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc(F.round("score", 12)), item))
    out = fused.select("config", "query_id", item, "score").withColumn("rank", rank)
    return out if keep is None else out.where(F.col("rank") <= keep)


def replayed(requests: DataFrame, stored: DataFrame, key: bytes) -> DataFrame:
    """(request_id, digest, hit, position, item, token): stored(digest, revision, position, item) results of requests(request_id, workflow, digest, revision).

    A result of another revision is no hit; tokens are signed anew for the
    request's own workflow. A miss is one row without an item.
    """
    found = requests.join(stored, ["digest", "revision"], "left")
    token = F.when(F.col("item").isNotNull(), evidence_token(key, F.col("workflow").cast("string"), F.col("item").cast("string")))
    return found.select("request_id", "digest", F.col("item").isNotNull().alias("hit"), "position", "item", token.alias("token"))


def graph_snapshot(edges: DataFrame, nodes: DataFrame, communities: DataFrame, limit: int, node: Column | None = None) -> DataFrame:
    """(part, place, id, other): up to ``limit`` (1 to 500) edges (src, dst), at ``node`` if given, the nodes(id) they join, and communities(key, level), deepest level first."""
    most = max(1, min(limit, 500))
    near = edges if node is None else edges.where((F.col("src") == node) | (F.col("dst") == node))
    shown = near.select("src", "dst").orderBy("src", "dst").limit(most)
    ends = shown.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    some = nodes.join(F.broadcast(ends), "id", "left_semi").select("id").orderBy("id").limit(most)
    groups = communities.orderBy(F.desc("level"), "key").limit(most)

    def part(rows: DataFrame, name: str, order: list, id_: str, other: Column) -> DataFrame:
        # of at most 500 rows
        place = F.row_number().over(Window.orderBy(*order))
        return rows.select(F.lit(name).alias("part"), place.alias("place"), F.col(id_).cast("string").alias("id"), other.cast("string").alias("other"))

    return part(shown, "edge", ["src", "dst"], "src", F.col("dst")).union(part(some, "node", ["id"], "id", F.lit(None))).union(part(groups, "community", [F.desc("level"), "key"], "key", F.col("level")))
