"""The flow map: entrypoints from all evidence, traces by quota, clusters, flows with their meaning, and their checks.

Every step is joins on names and windows with a group limit: an entry keeps one service, the first few collaborators
and repositories, and no list grows with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import base_name, collaborator_role, flow_actor, flow_type, listener_kind, slugify, step_role
from quarry.operators.durable import saved
from quarry.operators.linking import contains_either, contains_pairs
from quarry.operators.relational import cascade_match, top_k, unique_by

_ENTRY = ["entry_id", "app", "kind", "name", "trigger", "target", "notes", "n_evidence", "rank", "ord"]
#: Entrypoint kinds by annotation of a method or its type.
METHOD_KINDS = [("kafka-listener", "KafkaListener"), ("rabbit-listener", "RabbitListener"), ("jms-listener", "JmsListener"), ("mdb-listener", "MessageDriven"), ("event-handler", "EventListener"), ("spring-scheduled", "Scheduled")]
RUNNERS = "CommandLineRunner|ApplicationRunner"
#: How many steps of a role a trace takes; roles that dependencies add; roles that helpers have.
COLLABORATORS, REPOSITORIES = 6, 3
DEPENDENCY_ROLES, HELPER_ROLES = ("event-publisher", "external-client"), ("helper", "validator", "mapper")
EVIDENCE_MOST = 16


def _any(column: str, pattern: str) -> Column:
    return F.coalesce(F.exists(column, lambda a: a.rlike(f"(?i){pattern}")), F.lit(False))


def _entries(df: DataFrame, rank: int, entry_id: Column, app: Column, kind: Column, name: Column, trigger: Column, target: Column, notes: Column, n: Column | None = None) -> DataFrame:
    values = [entry_id, app, kind, name, trigger, target, notes, (F.lit(1) if n is None else n).cast("long"), F.lit(rank), F.col("ord").cast("long")]
    return df.select(*(v.alias(c) for v, c in zip(values, _ENTRY, strict=True)))


def discover_entrypoints(endpoints: DataFrame, jobs: DataFrame, listeners: DataFrame, triggers: DataFrame, methods: DataFrame, types: DataFrame, catalog: DataFrame, default_app: str = "default") -> DataFrame:
    """(entry_id, app, kind, name, trigger, target, notes, n_evidence, rank, ord), the first of equal ids.

    endpoints(app, method, path, type_name, file, ord); jobs(name, schedule, model, purpose, ord); listeners(name, purpose,
    ord) with triggers(listener, event, source, ord); methods(app, file, type_name, method, return_type, annotations, ord),
    the annotations being those of the type and the method; types(app, file, type_name, annotations, ord); catalog(app,
    fqn, name, kind, annotations, interfaces, ord), types of a structure scan, which add what the others lack."""
    target = F.coalesce("type_name", base_name("file"))
    label = F.concat_ws(" ", "method", "path")
    web = F.when(F.col("path").rlike("(?i)webhook"), "webhook-endpoint").when(F.col("path").rlike("(?i)callback"), "callback-endpoint").otherwise("rest-endpoint")
    parts = [_entries(endpoints, 0, F.concat_ws(":", F.lit("http"), "method", "path"), F.col("app"), web, label, label, target, F.lit(""))]

    timed = F.when(F.col("model").rlike("(?i)quartz"), "quartz-job").when(F.col("schedule").rlike("(?i)@scheduled|cron|every|daily"), "spring-scheduled").otherwise("scheduler")
    parts.append(_entries(jobs, 1, F.concat(F.lit("scheduled:"), slugify("name")), F.lit(default_app), timed, F.col("name"), F.col("schedule"), F.col("name"), F.concat_ws(" ", "model", "purpose")))

    in_order = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("ord", x.alias("v")))), lambda s: s["v"])
    said = triggers.groupBy(F.col("listener").alias("name")).agg(F.count("*").alias("n"), in_order(F.col("event")).alias("events"), in_order(F.concat_ws(" ", "event", "source")).alias("said"))
    heard = listeners.join(said, "name", "left")
    kind = listener_kind(F.concat_ws(" ", "name", "purpose", "said"))
    parts.append(_entries(heard, 2, F.concat(F.lit("listener:"), slugify("name")), F.lit(default_app), kind, F.col("name"), F.coalesce(F.nullif(F.array_join("events", " | "), F.lit("")), F.col("name")), F.col("name"), F.coalesce("purpose", F.lit("")), F.coalesce("n", F.lit(1))))

    runner = lambda c: F.coalesce(F.col(c).rlike(RUNNERS), F.lit(False))
    run = F.col("method") == "run"
    rules = [F.when(_any("annotations", p), F.lit(k)) for k, p in METHOD_KINDS]
    rules += [F.when(((runner("return_type") | runner("type_name")) & run) | (runner("return_type") & _any("annotations", "^@?Bean$")), F.lit("startup-runner")), F.when(F.col("type_name").rlike("(?i)Job|Batch") & run, F.lit("batch-job"))]
    marked = methods.withColumn("k", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())))
    marked = marked.unionByName(types.where(_any("annotations", "WebService|Endpoint")).withColumn("k", F.lit("soap-endpoint")), allowMissingColumns=True)
    name = F.concat_ws(".", "type_name", "method")
    parts.append(_entries(marked, 3, F.concat_ws(":", F.col("k"), slugify("file"), slugify(name)), F.col("app"), F.col("k"), name, F.concat_ws(" ", "k", name), name, F.array_join("annotations", " ")))
    found = saved(reduce(DataFrame.unionByName, parts), "entrypoints")

    redis = F.coalesce(F.exists("interfaces", lambda i: i.rlike("MessageListener")), F.lit(False))
    controller = F.when(_any("annotations", "graphql|queryMapping|mutationMapping"), "graphql-endpoint").when(_any("annotations", "webservice|endpoint"), "soap-endpoint").otherwise("rest-endpoint")
    listener = F.when(redis, "redis-listener").when(_any("annotations", "kafka"), "kafka-listener").when(_any("annotations", "rabbit"), "rabbit-listener").otherwise("event-handler")
    is_kind = lambda k: F.coalesce(F.col("kind") == k, F.lit(False))
    chosen = F.when(is_kind("controller"), F.struct(F.lit("controller").alias("as"), controller.alias("k"))).when(is_kind("listener") | redis, F.struct(F.lit("listener").alias("as"), listener.alias("k"))).when(is_kind("job"), F.struct(F.lit("job").alias("as"), F.lit("spring-scheduled").alias("k")))
    more = catalog.withColumn("c", chosen).where("c IS NOT NULL AND name <> ''").join(found.select(F.col("target").alias("name")).distinct(), "name", "left_anti")
    more = unique_by(more, ["name"], ["ord"])
    extra = _entries(more, 4, F.concat_ws(":", F.lit("jqa"), "c.as", "name"), F.col("app"), F.col("c.k"), F.col("name"), F.col("name"), F.col("name"), F.array_join("annotations", " "))
    return unique_by(found.unionByName(extra), ["entry_id"], ["rank", "ord", "name"])


def _stem(x: str) -> Column:
    return F.regexp_replace(x, "Repository$", "")


def _near_repositories(callees: DataFrame, repositories: DataFrame) -> DataFrame:
    """(callee, name, place) of repositories that a callee's name holds, or whose name holds the callee's."""
    names = repositories.select("name", F.col("ord").alias("place"), _stem("name").alias("stem"))
    whole = contains_pairs(names.select("name").distinct(), callees.select("callee").distinct(), "name", "callee").where(F.contains("name", F.col("callee")))
    stems = contains_pairs(callees.select("callee").distinct(), names.select("stem").where("stem <> ''").distinct(), "callee", "stem").where(F.contains("callee", F.col("stem"))).join(names, "stem").select("name", "callee")
    return whole.select("name", "callee").union(stems).distinct().join(names.select("name", "place"), "name").select("callee", "name", "place")


def service_repositories(services: DataFrame, repositories: DataFrame, calls: DataFrame, deps: DataFrame) -> DataFrame:
    """(service, operation, node, place): repositories of services(service, operation), from the first evidence that has
    any: calls(src, dst, ord) of the service, its deps(src, dst, ord), words of its and the operation's name."""
    asked = services.select("service", "operation").distinct()
    tiers = []
    for links in (calls, deps):
        # Read several times: written, so that the links are read once.
        near = saved(asked.join(links.select(F.col("src").alias("service"), F.col("dst").alias("callee")).where("callee <> ''").distinct(), "service"), "flow-callees")
        tiers.append(near.join(_near_repositories(near, repositories), "callee").select("service", "operation", F.col("name").alias("node"), "place").distinct())
    said = asked.withColumn("__said", F.lower(F.concat_ws(" ", "service", "operation")))
    low = F.lower(_stem("name"))
    stems = repositories.select("name", F.col("ord").alias("place"), F.explode(F.array_distinct(F.concat(F.array(low), F.split(low, "_")))).alias("word")).where("word <> ''")
    tiers.append(contains_pairs(said, stems.select("word").distinct(), "__said", "word").join(stems, "word").select("service", "operation", F.col("name").alias("node"), "place").distinct())
    ranked = cascade_match([t.withColumn("key", F.struct("service", "operation")) for t in tiers], "key").drop("key", "tier")
    return top_k(ranked, ["service", "operation"], ["place", "node"], REPOSITORIES)


def _named_in(texts: DataFrame, repositories: DataFrame) -> DataFrame:
    """(entry_id, place, node): the first repository that a text(entry_id, place, text) names as a whole word."""
    words = texts.select("entry_id", "place", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^a-z0-9_]+"))).alias("word"))
    known = repositories.select(F.lower("name").alias("word"), F.col("name").alias("node"), F.col("ord").alias("at"))
    return words.join(known, "word").groupBy("entry_id", "place").agg(F.min_by("node", "at").alias("node"))


def trace_flows(entries: DataFrame, primary: DataFrame, operations: DataFrame, repositories: DataFrame, calls: DataFrame, deps: DataFrame, kinds: DataFrame, triggers: DataFrame, jobs: DataFrame) -> DataFrame:
    """(entry_id, step_ord, role, node) of each entry: the entry's target, its best service (primary(entry_id, service,
    operation)), up to six collaborators of the operation, up to three repositories of the service, publishers and clients
    that it depends on, and repositories that the effects of a listener's triggers or of a job name. Of equal (role, node)
    the first stays.

    operations(service, operation, collaborators, side_effects), the lists in order; repositories(name, ord); calls and
    deps(src, dst, ord); kinds(name, kind) by annotation; triggers(listener, effect, ord); jobs(name, effects, ord)."""
    step = lambda df, part: df.select("entry_id", F.lit(part).alias("part"), F.col("place").cast("long").alias("place"), "role", "node")
    known = kinds.groupBy(F.col("name").alias("node")).agg(F.min("kind").alias("known"))
    first = step(entries.select("entry_id", F.lit(0).alias("place"), step_role("kind").alias("role"), F.col("target").alias("node")), 0)
    service = primary.select("entry_id", F.lit(0).alias("place"), F.lit("service").alias("role"), F.col("service").alias("node"))
    op = operations.groupBy("service", "operation").agg(F.min(F.struct("collaborators", "side_effects")).alias("o")).select("service", "operation", "o.*")
    event = F.coalesce(F.exists("side_effects", lambda x: F.contains(x, F.lit("event"))), F.lit(False))
    helpers = op.select("service", "operation", event.alias("event"), F.posexplode(F.slice("collaborators", 1, COLLABORATORS)).alias("place", "node"))
    # Roles and repositories are found once for each service and operation, not for each entry.
    helpers = helpers.join(known, "node", "left").select("service", "operation", "place", collaborator_role("node", "known", F.col("event")).alias("role"), "node")
    wanted = saved(primary.select("service", "operation").distinct(), "flow-operations")
    stores = service_repositories(wanted, repositories, calls, deps).select("service", "operation", "place", F.lit("repository").alias("role"), "node")
    by_op = lambda df, part: step(primary.select("entry_id", "service", "operation").join(df, ["service", "operation"]), part)
    steps = [first, step(service, 1), by_op(helpers, 2), by_op(stores, 3)]

    added = deps.join(wanted.select(F.col("service").alias("src")).distinct(), "src", "left_semi").groupBy("src", F.col("dst").alias("node")).agg(F.min("ord").alias("place")).join(known, "node", "left")
    added = added.select(F.col("src").alias("service"), "place", collaborator_role("node", "known").alias("role"), "node").where(F.col("role").isin(*DEPENDENCY_ROLES))
    added = primary.select("entry_id", "service").join(added, "service")
    heard = entries.where(F.col("kind").rlike("listener|^event-handler$")).join(triggers, F.col("target") == F.col("listener")).select("entry_id", triggers["ord"].alias("place"), F.col("effect").alias("text"))
    timed = entries.where(step_role("kind") == "scheduler").join(jobs.groupBy(F.col("name").alias("target")).agg(F.min_by("effects", "ord").alias("effects")), "target").select("entry_id", F.lit(0).alias("place"), F.col("effects").alias("text"))
    named = [step(_named_in(t, repositories).withColumn("role", F.lit("repository")), part) for part, t in ((5, heard), (6, timed))]
    # One exchange by entry serves all that follows; an entry has few steps. The number of parts is given, as Spark would
    # put parts together by their compressed size, and steps repeat.
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = reduce(DataFrame.unionByName, [*steps, step(added, 4), *named]).where("node IS NOT NULL").repartition(n, "entry_id")
    once = unique_by(every, ["entry_id", "node", "role"], ["part", "place"])
    # What dependencies add is new: no step before has the node.
    once = once.withColumn("since", F.min("part").over(Window.partitionBy("entry_id", "node"))).where("part <> 4 OR since = 4")
    order = Window.partitionBy("entry_id").orderBy("part", "place", "role", "node")
    return once.withColumn("step_ord", F.row_number().over(order)).select("entry_id", "step_ord", "role", "node")


def _anchored(entries: DataFrame, primary: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Entries with their cluster and anchor; starts(entry_id, start), if known, go before the target."""
    joined = entries.join(primary.select("entry_id", "service"), "entry_id", "left")
    joined = joined if starts is None else joined.join(starts, "entry_id", "left")
    anchor = F.coalesce("service", *([] if starts is None else ["start"]), "target", "entry_id")
    proof = F.col("n_evidence") + F.col("service").isNotNull().cast("long")
    return joined.select("app", slugify(anchor, 80).alias("cluster"), anchor.alias("anchor"), "entry_id", "kind", F.struct("rank", "ord", "entry_id").alias("at"), proof.alias("proof"))


def _led(rows: DataFrame) -> DataFrame:
    return rows.groupBy("app", "cluster").agg(F.min_by("anchor", "at").alias("anchor"), flow_type(F.min_by("kind", "at")).alias("flow_type"), F.min_by("entry_id", "at").alias("first_entry"), F.count("*").alias("n_entries"), F.least(F.sum("proof"), F.lit(EVIDENCE_MOST).cast("long")).alias("n_evidence"))


def lead_flows(entries: DataFrame, primary: DataFrame) -> DataFrame:
    """(app, cluster, anchor, flow_type, first_entry, n_entries, n_evidence) of cluster_flows, before anything is traced: a
    trace starts at the entry's target, and one without service has no other controller, listener or scheduler."""
    return saved(_led(_anchored(entries, primary)), "flow-leads")


def cluster_flows(entries: DataFrame, primary: DataFrame, steps: DataFrame) -> DataFrame:
    """(app, cluster, anchor, flow_type, first_entry, n_entries, n_evidence, entry_ids, helpers): entries of an application
    by anchor: the service, else the first controller, listener or scheduler step, else the target. Lists have the first
    sixteen; rows beyond never meet."""
    starts = steps.where(F.col("role").isin("controller", "listener", "scheduler")).groupBy("entry_id").agg(F.min_by("node", "step_ord").alias("start"))
    rows = saved(_anchored(entries, primary, starts), "flow-clusters")
    key, out = ["app", "cluster"], _led(rows)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    ids = top_k(rows, key, ["at"], EVIDENCE_MOST).groupBy(*key).agg(ordered("entry_id").alias("entry_ids"))
    named = rows.join(steps.where(F.col("role").isin(*HELPER_ROLES)).select("entry_id", "node", "step_ord"), "entry_id").groupBy(*key, "node").agg(F.min(F.struct("at", "step_ord")).alias("at"))
    helpers = top_k(named, key, ["at", "node"], EVIDENCE_MOST).groupBy(*key).agg(ordered("node").alias("helpers"))
    none = F.array().cast("array<string>")
    return out.join(ids, key).join(helpers, key, "left").withColumn("helpers", F.coalesce("helpers", none))


def known_flows(entries: DataFrame, known: DataFrame) -> DataFrame:
    """(entry_id, known_ord): the first of known(known_ord, name, trigger) that an entry matches: by its trigger, or by one
    name that the other holds."""
    k = known.select("known_ord", F.col("name").alias("known_name"), F.col("trigger").alias("known_trigger"))
    e = entries.select("entry_id", "name", "trigger", "target")
    by_trigger = contains_pairs(k.select("known_ord", "known_trigger"), e.select("trigger").where("trigger <> ''").distinct(), "known_trigger", "trigger").where(F.contains("known_trigger", F.col("trigger"))).join(e.select("entry_id", "trigger"), "trigger")
    by_target = contains_pairs(k.select("known_ord", "known_name"), e.select("target").where("target <> ''").distinct(), "known_name", "target").join(e.select("entry_id", "target"), "target")
    by_name = contains_pairs(e.select("entry_id", "name"), k.select("known_name").where("known_name <> ''").distinct(), "name", "known_name").join(k.select("known_ord", "known_name"), "known_name")
    pairs = [p.select("entry_id", "known_ord") for p in (by_trigger, by_target, by_name)]
    return reduce(DataFrame.union, pairs).groupBy("entry_id").agg(F.min("known_ord").alias("known_ord"))


def flow_name(name: Column, kind: Column) -> Column:
    """Words of a name with capitals, and what kind of flow it is."""
    label = F.trim(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[._/-]+", " "))
    words = F.transform(F.split(label, r"(?<=[^A-Za-z0-9_])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.concat_ws(" ", F.array_join(words, ""), F.when(kind == "api", "flow").otherwise(kind))


def interpret_flows(clusters: DataFrame, entries: DataFrame, primary: DataFrame, operations: DataFrame, steps: DataFrame, known: DataFrame) -> DataFrame:
    """One flow per cluster, told by its first entry: name, type, trigger, actor, meaning, path, outcome, confidence.
    known(known_ord, name, trigger, summary, last_step) are described flows: they come first. operations(service,
    operation, purpose)."""
    lead = clusters.select("app", "cluster", "anchor", "flow_type", "n_evidence", F.col("first_entry").alias("entry_id"))
    e = entries.join(lead.select("entry_id"), "entry_id", "left_semi")
    met = known_flows(e, known).join(known.select("known_ord", F.col("name").alias("known_name"), "summary", "last_step"), "known_ord")
    purposes = operations.groupBy("service", "operation").agg(F.min("purpose").alias("purpose"))
    detail = primary.join(purposes, ["service", "operation"], "left").select("entry_id", "service", F.concat(F.col("operation"), F.lit(": "), F.coalesce("purpose", F.lit(""))).alias("detail"))
    own = steps.join(lead.select("entry_id"), "entry_id", "left_semi").groupBy("entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_ord", "role", "node"))), lambda x: F.concat_ws(":", x["role"], x["node"])), " -> ").alias("path"), F.max_by("node", "step_ord").alias("last"))
    rows = lead.join(e.select("entry_id", "kind", "trigger"), "entry_id").join(met, "entry_id", "left").join(detail, "entry_id", "left").join(own, "entry_id", "left")
    kind = flow_type("kind")
    return rows.select(
        "app", F.concat(F.lit("flow:"), slugify(F.concat_ws(":", "app", "cluster"))).alias("flow_id"), F.col("anchor").alias("cluster_name"), "entry_id", F.coalesce("known_name", flow_name(F.col("anchor"), kind)).alias("name"), kind.alias("flow_type"), "trigger", flow_actor("kind").alias("actor"),
        F.coalesce("summary", "detail", F.concat_ws(" ", "anchor", F.lit("flow"))).alias("meaning"), "path", F.coalesce("last_step", "last", F.lit("flow completes")).alias("outcome"),
        F.when(F.col("known_ord").isNotNull(), 0.9).when(F.col("service").isNotNull(), 0.78).otherwise(0.62).alias("confidence"), "n_evidence",
    )


def flow_issues(entries: DataFrame, primary: DataFrame, steps: DataFrame, flows: DataFrame, nodes: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, category), each once: of entries' traces low-evidence, utility-noise and mixed-flow; of flows low-evidence,
    missing-node, broken-edge and semantic-contradiction. nodes(id, name), edges(src, dst); candidates(app, flow_name,
    flow_type) are other readings of flows, which a flow meets where one name holds the other."""
    mark = lambda df, key, c: df.select(F.col(key).alias("id"), F.lit(c).alias("category"))
    sizes = steps.groupBy("entry_id").agg(F.count("*").alias("n"), F.count_if(F.col("role").isin(*HELPER_ROLES)).alias("helpers"), F.count_if(F.col("role") == "service").alias("services"))
    proof = entries.join(primary.select("entry_id", "service"), "entry_id", "left").where(F.col("n_evidence") + F.col("service").isNotNull().cast("int") < 2)
    parts = [mark(proof, "entry_id", "low-evidence"), mark(sizes.where("helpers >= 3 AND n <= helpers + 1"), "entry_id", "utility-noise"), mark(sizes.where("services > 2"), "entry_id", "mixed-flow"), mark(flows.where("n_evidence < 2"), "flow_id", "low-evidence")]
    path = steps.join(flows.select("flow_id", "entry_id"), "entry_id").withColumn("low", F.lower("node"))
    names = nodes.select(F.col("id").alias("node_id"), F.lower("name").alias("low"))
    parts.append(mark(path.join(names.select("low").distinct(), "low", "left_anti"), "flow_id", "missing-node"))
    pairs = path.withColumn("next", F.lead("low").over(Window.partitionBy("flow_id").orderBy("step_ord"))).where("next IS NOT NULL").select("flow_id", "low", "next").distinct()
    known = names.select("low").distinct()
    pairs = pairs.join(known, "low", "left_semi").join(known.withColumnRenamed("low", "next"), "next", "left_semi")
    # Edges between names, either way; a pair of names is broken if no nodes of these names are linked.
    a, b = names.select(F.col("node_id").alias("src"), F.col("low").alias("low")), names.select(F.col("node_id").alias("dst"), F.col("low").alias("next"))
    wanted = pairs.select("low", "next").distinct()
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    linked = both.join(a.join(wanted.select("low").distinct(), "low", "left_semi"), "src").join(b.join(wanted.select("next").distinct(), "next", "left_semi"), "dst").select("low", "next").distinct()
    parts.append(mark(pairs.join(linked, ["low", "next"], "left_anti"), "flow_id", "broken-edge"))
    named = candidates.where("flow_name <> '' AND trim(flow_type) <> ''").select("app", "flow_name", F.col("flow_type").alias("other")).distinct()
    met = contains_either(flows.select("app", "cluster_name").distinct(), named.select("app", "flow_name").distinct(), "cluster_name", "flow_name", within=("app",))
    parts.append(mark(flows.join(met.join(named, ["app", "flow_name"]), ["app", "cluster_name"]).where("other <> flow_type"), "flow_id", "semantic-contradiction"))
    return reduce(DataFrame.union, parts).distinct()
