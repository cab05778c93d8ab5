"""Text rows to structured rows: lines, sections, items, mentions, endpoints, source facts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.names import section_name, trim_text
from quarry.operators.linking import contains_pairs
from quarry.operators.relational import unique_by

#: Section names of a semantic document.
KNOWN_SECTIONS = ["system", "intent", "context", "interfaces", "data_flows", "processes", "rules", "security", "dependencies", "examples", "acceptance_criteria"]
REQUIRED_SECTIONS = ["system", "intent", "context", "interfaces", "data_flows", "processes", "rules", "security"]


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), r"\r?\n")).alias("line_no", "line"))


def _body(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the lines of each section in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return rows.groupBy(*keys).agg(
        F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(ordered, lambda x: x["line"].isNotNull()), lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")).alias("raw"),
        F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"),
    )


def split_sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Second-level headings open sections; a first-level heading closes one and is dropped; deeper headings are body."""
    rows = lines(docs, key)
    level = F.length(F.regexp_extract(F.trim("line"), r"^(#{1,6})\s+.+$", 1))
    title = F.when(F.col("level") == 2, F.trim(F.regexp_extract(F.trim("line"), r"^##\s+(.+)$", 1)))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("level", level).withColumn("title", title)
    marked = marked.withColumn("sec_ord", F.sum(F.col("level").isin(1, 2).cast("int")).over(w)).withColumn("__head", F.last("title", True).over(w))
    # The last heading of level 1 or 2 decides whether lines belong to a section.
    marked = marked.withColumn("__open", F.last(F.when(F.col("level").isin(1, 2), F.col("level")), True).over(w)).where("__open = 2")
    body = marked.withColumn("line", F.when(F.col("level") == 2, None).otherwise(F.col("line"))).withColumn("title", F.col("__head"))
    return _body(body, [key, "sec_ord", "title"]).withColumn("name", section_name("title"))


def split_headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every heading opens a section."""
    rows = docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s+.+$", 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("level", level).withColumn("title", F.when(F.col("level") > 0, F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+)$", 1))))
    marked = marked.withColumn("sec_ord", F.sum((F.col("level") > 0).cast("int")).over(w)).where("sec_ord > 0")
    marked = marked.withColumn("__level", F.first(F.when(F.col("level") > 0, F.col("level")), True).over(Window.partitionBy(key, "sec_ord").orderBy("line_no")))
    marked = marked.withColumn("__title", F.first("title", True).over(Window.partitionBy(key, "sec_ord").orderBy("line_no")))
    body = marked.withColumn("line", F.when(F.col("level") > 0, None).otherwise(F.col("line"))).select(key, "sec_ord", F.col("__level").alias("level"), F.col("__title").alias("title"), "line_no", "line")
    return _body(body, [key, "sec_ord", "level", "title"]).withColumnRenamed("raw", "content")


def context_sections(docs: DataFrame, names: list[str], key: str = "doc_id") -> DataFrame:
    """Named sections that are not blank."""
    return split_sections(docs, key).where(F.lower("title").isin(names) & F.col("raw").rlike(r"\S"))


def lift_headings(docs: DataFrame, known: list[str], key: str = "doc_id") -> DataFrame:
    """If a first-level heading is a known section name, all headings go one level down."""
    rows = lines(docs, key)
    head = section_name(F.regexp_extract("line", r"^#\s+(.+)$", 1))
    lifted = rows.withColumn("__lift", F.max(head.isin(known).cast("int")).over(Window.partitionBy(key)))
    new = F.when((F.col("__lift") == 1) & F.col("line").rlike(r"^#{1,5}\s"), F.concat(F.lit("#"), F.col("line"))).otherwise(F.col("line"))
    new = F.regexp_replace(new, r"^(##\s+)data_models\s*$", "$1data_flows")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", new.alias("line"))))
    return lifted.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def section_items(sections: DataFrame, keys: list[str], raw: str = "raw") -> DataFrame:
    """Bullet items where there are any, else paragraphs."""
    trimmed = F.transform(F.split(F.col(raw), r"\r?\n"), lambda x: F.trim(x))
    bullets = F.filter(F.transform(F.filter(trimmed, lambda x: x.rlike(r"^[-*]\s+")), lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s+", ""))), lambda x: x != "")
    paragraphs = F.filter(F.transform(F.split(F.col(raw), r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return sections.select(*keys, F.posexplode(F.when(F.size(bullets) > 0, bullets).otherwise(paragraphs)).alias("item_ord", "item"))


def item_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sec_ord, item_ord, line_no) of the bullets of each section."""
    rows = lines(docs, key)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sec_ord", F.sum(F.col("line").rlike(r"^\s*#{1,2}\s+\S").cast("int")).over(w)).where(F.col("line").rlike(r"^\s*[-*]\s+"))
    return rows.select(key, "sec_ord", (F.row_number().over(Window.partitionBy(key, "sec_ord").orderBy("line_no")) - 1).alias("item_ord"), "line_no")


def system_name(sections: DataFrame, paths: DataFrame, key: str = "doc_id", default: str = "SemanticSystem") -> DataFrame:
    """First line of the system section, else the cleaned base name, else a constant; at most 80 characters."""
    first = sections.where("name = 'system'").select(key, F.try_element_at(F.filter(F.transform(F.split("raw", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1)).alias("__first"))
    base = F.element_at(F.split("path", "/"), -1)
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"(?i)\.semantic\.md$", ""), r"\.[^.]+$", ""), r"[_-]+", " ")
    return paths.join(first, key, "left").select(key, trim_text(F.coalesce(F.nullif("__first", F.lit("")), F.nullif(base, F.lit("")), F.lit(default)), 80).alias("system_name"))


def doc_title(text: Column, default: str = "Imported Document") -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)), F.lit("")), F.lit(default))


def mentions(docs: DataFrame, arrays: list[Column], key: str, out: str, cap: int, least: int = 0, most: int = 1 << 30) -> DataFrame:
    """Distinct values of several mention arrays in order of appearance, capped per document (a report's cap)."""
    found = F.array_distinct(F.concat(*arrays))
    kept = F.filter(found, lambda v: (F.length(v) > least) & (F.length(v) < most))
    return docs.select(key, F.posexplode(F.slice(kept, 1, cap)).alias("ord", out))


def extract_apis(docs: DataFrame, key: str = "doc_id", text: str = "text", cap: int = 30) -> DataFrame:
    verb = r"\b(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/[a-zA-Z0-9/_{}:.-]+)"
    rest = F.zip_with(F.regexp_extract_all(text, F.lit(verb), F.lit(1)), F.regexp_extract_all(text, F.lit(verb), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
    paths = F.regexp_extract_all(text, F.lit(r"`(/(?:api|v\d+)[a-zA-Z0-9/_{}:.-]+)`"), F.lit(1))
    return mentions(docs, [rest, paths], key, "api", cap)


#: Suffixes of component names in text, and words that mark a heading as a component or a flow.
COMPONENT_SUFFIXES = "Service|Module|Component|Handler|Manager|Controller|Repository|Gateway|Adapter|Engine|Processor|Dispatcher|Worker|Scheduler|Cache|Store|Bus|Broker|Queue|Connector|Proxy"
COMPONENT_HEADINGS = "Service|Module|Component|Handler|Manager|Controller|Repository|Gateway|Adapter|Client|Provider|Factory|Registry|Engine|Processor|Dispatcher|Coordinator|Orchestrator|Aggregator|Store|Cache|Bus|Broker|Queue|Consumer|Producer|Listener|Scheduler|Worker|Job|Task|Validator|Transformer|Converter|Parser|Serializer|Codec|Connector|Proxy|Facade|Delegate"
FLOW_HEADINGS = r"flow|process|sequence|workflow|pipeline|lifecycle|request\s+handling|authentication|authorization|registration|checkout|payment|onboarding|notification|event\s+processing|data\s+ingestion|sync|batch|migration"


def _headings(sections: DataFrame, test: Column, key: str) -> DataFrame:
    titles = F.array_sort(F.collect_list(F.struct("sec_ord", "title")))
    return sections.where(test).groupBy(key).agg(F.transform(titles, lambda x: x["title"]).alias("__titles"))


def extract_components(docs: DataFrame, key: str = "doc_id", cap: int = 40) -> DataFrame:
    heads = _headings(split_headings(docs, key), (F.col("level") <= 3) & F.col("title").rlike(rf"(?i)\b({COMPONENT_HEADINGS})\b"), key)
    words = F.regexp_extract_all("text", F.lit(rf"\b(?:the\s+)?([A-Z][a-zA-Z0-9]+(?:{COMPONENT_SUFFIXES}))\b"), F.lit(1))
    joined = docs.join(heads.hint("merge"), key, "left")
    return mentions(joined, [F.coalesce("__titles", F.array().cast("array<string>")), words], key, "component", cap, 3, 80)


def extract_flows(sections: DataFrame, key: str = "doc_id", cap: int = 20) -> DataFrame:
    named = (F.col("level") <= 3) & F.col("title").rlike(rf"(?i)\b({FLOW_HEADINGS})\b")
    listed = F.col("content").rlike(r"(?m)^\s*\d+\.\s+") | F.col("content").rlike(r"(?im)^\s*(?:Step\s+\d+|First|Then|Finally|Next)\b") | F.col("content").rlike(r"→|->|=>|>>")
    sized = (F.length("title") > 3) & (F.length("title") < 80)
    rows = unique_by(sections.where(named | (listed & sized)), [key, "title"], ["sec_ord"])
    place = F.row_number().over(Window.partitionBy(key).orderBy("sec_ord"))
    return rows.withColumn("ord", place - 1).where(F.col("ord") < cap).select(key, "ord", F.col("title").alias("flow"))


def extract_models(docs: DataFrame, key: str = "doc_id", cap: int = 20) -> DataFrame:
    tables = _headings(split_headings(docs, key), F.col("content").rlike(r"(?m)^\|.+\|"), key)
    joined = docs.join(tables.hint("merge"), key, "left")
    return mentions(joined, [
        F.coalesce("__titles", F.array().cast("array<string>")),
        F.regexp_extract_all("text", F.lit(r"(?i)\b(?:table|entity|model|schema|relation):\s*([A-Za-z][A-Za-z0-9_]+)"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"""(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`"']?([A-Za-z_][A-Za-z0-9_]+)[`"']?"""), F.lit(1)),
        F.regexp_extract_all("text", F.lit(r"""\b(?:Entity|Table|Model|Schema)\s+[`"]?([A-Z][a-zA-Z0-9]+)[`"]?"""), F.lit(1)),
    ], key, "model", cap, 1, 60)


def tag_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", term: str = "term") -> DataFrame:
    """(key, term) of dictionary terms that the text contains, whatever their case."""
    return contains_pairs(docs.select(key, text), terms, text, term).select(key, term).distinct()


def classify_docs(counts: DataFrame) -> DataFrame:
    """Kind from n_apis, n_components, n_flows and has_detail."""
    apis, components, flows = F.col("n_apis"), F.col("n_components"), F.col("n_flows")
    kind = (
        F.when((apis > 5) & (components < 3), "api-spec").when(F.col("has_detail") & (components > 2), "lld")
        .when((components > 3) & (flows > 1), "architecture").when(components + flows + apis > 2, "mixed").otherwise("technical-description")
    )
    return counts.withColumn("kind", kind)


#: Verbs of mapping annotations.
MAPPING_VERBS = ["Get", "Post", "Put", "Delete", "Patch"]


def annotation_endpoints(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, method, path, source) of mapping annotations."""

    def verb_rows(verb: str) -> Column:
        paths = F.regexp_extract_all(text, F.lit(rf"""(?i)@{verb}Mapping\(\s*(?:value\s*=\s*)?["']([^"']+)["']\s*\)"""), F.lit(1))
        return F.transform(paths, lambda p: F.struct(F.lit(verb.upper()).alias("method"), p.alias("path"), F.lit(f"@{verb}Mapping").alias("source")))

    arrays = [verb_rows(v) for v in MAPPING_VERBS]
    generic = F.regexp_extract_all(text, F.lit(r"(?i)@RequestMapping\(([^)]+)\)"), F.lit(1))
    blank = lambda x, d: F.coalesce(F.nullif(x, F.lit("")), d)
    arrays.append(F.transform(generic, lambda r: F.struct(
        blank(F.upper(F.regexp_extract(r, r"(?i)RequestMethod\.([A-Z]+)", 1)), F.lit("REQUEST")).alias("method"),
        blank(F.regexp_extract(r, r"""(?i)(?:path|value)\s*=\s*["']([^"']+)["']""", 1), blank(F.regexp_extract(r, r"""["']([^"']+)["']""", 1), F.lit("/"))).alias("path"),
        F.lit("@RequestMapping").alias("source"),
    )))
    return files.select(key, F.posexplode(F.concat(*arrays)).alias("ord", "e")).select(key, "ord", "e.*")


_METHOD = r"(?:public|private|protected|static|\s)+\w[\w<>,\s]*\s+(\w+)\s*\([^)]*\)\s*\{?\s*$"


def scan_endpoints(files: DataFrame, key: str = "file") -> DataFrame:
    """Line scan of several protocols: nearest class above, method in the next three lines, path annotation within three lines."""
    rows = lines(files, key)
    pick = lambda p, g=1: F.nullif(F.regexp_extract("line", p, g), F.lit(""))
    spring = r"""@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*(?:value\s*=\s*)?["']([^"']*?)["'])?"""
    # The annotations of each protocol.
    rows = rows.withColumns({
        "__class": pick(r"(?:class|interface)\s+(\w+)"), "__method": pick(_METHOD), "__path": pick(r"""@Path\s*\(\s*["']([^"']+)["']\s*\)"""),
        "__spring": pick(spring), "__spring_path": pick(spring, 2), "__jaxrs": pick(r"@(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b"),
        "__soap": pick(r"@(WebService|WebMethod|SoapAction)\b"),
        "__graphql": pick(r"@(QueryMapping|MutationMapping|SubscriptionMapping|SchemaMapping|GraphQlExceptionHandler)\b"),
        "__event": pick(r"@(EventListener|KafkaListener|RabbitListener|SqsListener|JmsListener|MessageMapping|StreamListener)\b"),
        "__topic": pick(r"""topics\s*=\s*["'{]([^"'}]+)"""), "__rpc": pick(r"^\s*rpc\s+(\w+)\s*\("),
    })
    # Lines without any mark are neither an endpoint nor what one looks for. The lines of a file came from one row, so a
    # window holds no more than such a row did; frames are by line number, which dropped lines do not change.
    marks = [x for x in rows.columns if x.startswith("__")]
    rows = rows.drop("line").where(F.coalesce(*marks).isNotNull())
    w = Window.partitionBy(key).orderBy("line_no")
    first = lambda x, a, b: F.first(x, ignorenulls=True).over(w.rangeBetween(a, b))
    rows = rows.withColumns({"class_name": F.last("__class", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)), "method_name": first("__method", 1, 3), "__near": first("__path", -3, 3)})
    c = F.col
    kind = F.when(c("__rpc").isNotNull(), "gRPC").when(c("__spring").isNotNull() | c("__jaxrs").isNotNull(), "REST").when(c("__soap").isNotNull(), "SOAP").when(c("__graphql").isNotNull(), "GraphQL").when(c("__event").isNotNull(), "Event")
    method = F.when(c("__rpc").isNotNull(), None).when(c("__spring").isNotNull(), F.when(c("__spring") == "Request", "ANY").otherwise(F.upper("__spring"))).when(c("__jaxrs").isNotNull(), c("__jaxrs")).when(c("__soap").isNotNull(), c("__soap")).when(c("__graphql").isNotNull(), None).otherwise(c("__event"))
    path = F.when(c("__rpc").isNotNull(), c("__rpc")).when(c("__spring").isNotNull(), F.coalesce("__spring_path", F.lit("/"))).when(c("__jaxrs").isNotNull(), F.coalesce("__near", F.lit("/"))).when(c("__soap").isNotNull() | c("__graphql").isNotNull(), None).otherwise(c("__topic"))
    found = rows.withColumns({"kind": kind, "method": method, "path": path}).where("kind IS NOT NULL")
    return found.select(key, (F.col("line_no") + 1).alias("line"), "kind", "method", "path", "class_name", F.when(c("kind") == "gRPC", c("__rpc")).otherwise(c("method_name")).alias("method_name"))


_VERBS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"


def doc_endpoints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """VERB /path at line starts, in headings and in table cells; a trailing slash does not make a new endpoint."""
    rows = lines(docs, key)
    forms = [rf"^({_VERBS})\s+(/\S*)", rf"^#+.*\b({_VERBS})\s+(/\S+)", rf"^\|\s*({_VERBS})\s+(/[^\s|]*)"]
    method, path = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p in reversed(forms):
        method = F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1)).otherwise(method)
        path = F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 2)).otherwise(path)
    rest = F.trim(F.regexp_replace(F.regexp_replace("line", forms[0], ""), r"^[\s—–-]+", ""))
    described = F.when(F.col("line").rlike(forms[0]), F.nullif(rest, F.lit("")))
    rows = rows.withColumns({"method": method, "path": path, "description": described}).where("method IS NOT NULL")
    rows = rows.withColumn("path_key", F.coalesce(F.nullif(F.regexp_replace("path", "/$", ""), F.lit("")), F.lit("/")))
    return unique_by(rows, ["method", "path_key"], [key, "line_no"]).select(key, (F.col("line_no") + 1).alias("line"), "method", "path", "path_key", "description")


def declared_endpoints(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """api:, event:, graphql: and grpc: items of the interfaces section."""
    items = sections.where("name = 'interfaces'").select(key, F.posexplode(F.split("raw", r"\r?\n")).alias("ord", "line"))
    item = F.regexp_replace(F.trim("line"), r"^[-*]\s+", "")
    dash = r"(?:\s*[—–-]+\s*(.*))?"
    out = None
    for kind, word in (("Event", "event"), ("GraphQL", "graphql"), ("gRPC", "grpc")):
        p = rf"^{word}:\s*(\S+){dash}"
        rows = items.where(item.rlike(p)).select(key, "ord", F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("method"), F.regexp_extract(item, p, 1).alias("path"), F.trim(F.regexp_extract(item, p, 2)).alias("description"))
        out = rows if out is None else out.unionByName(rows)
    p = rf"^api:\s*`([A-Z]+)\s+([^`]+)`{dash}"
    rest = items.where(item.rlike(p)).select(key, "ord", F.lit("REST").alias("kind"), F.regexp_extract(item, p, 1).alias("method"), F.trim(F.regexp_extract(item, p, 2)).alias("path"), F.trim(F.regexp_extract(item, p, 3)).alias("description"))
    return out.unionByName(rest)


def annotation_flags(files: DataFrame, names: list[str], key: str = "file", text: str = "text") -> DataFrame:
    """Which of the named annotations occur."""
    found = F.filter(F.array(*(F.when(F.col(text).rlike(rf"(?i)@{n}\b"), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return files.select(key, found.alias("annotations"))


def source_facts(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Package, type, imports, public methods and injected fields of source files."""
    none = lambda x: F.nullif(x, F.lit(""))
    declared = r"(?m)^\s*(?:(?:public|protected|private|abstract|final|static)\s+)*(class|interface|record|enum)\s+([A-Za-z0-9_]+)"
    return files.select(
        key, none(F.regexp_extract(text, r"(?m)^\s*package\s+([a-zA-Z0-9_.]+)\s*;", 1)).alias("package"),
        none(F.regexp_extract(text, declared, 1)).alias("type_kind"), none(F.regexp_extract(text, declared, 2)).alias("type_name"),
        F.regexp_extract_all(text, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.*]+)\s*;"), F.lit(1)).alias("imports"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*public\s+(?!class|interface|record|enum)[\w<>,\[\] ?]+\s+(\w+)\s*\("), F.lit(1))).alias("methods"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*private\s+final\s+([A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*;"), F.lit(1))).alias("injected"),
    )


def entity_fields(files: DataFrame, key: str = "file") -> DataFrame:
    """Field declarations with the annotations gathered above them; a blank line or a field starts anew."""
    rows = lines(files, key)
    field = r"^\s*(?:private|protected|public)\s+(?:final\s+)?([A-Za-z_][\w<>,\s\[\].]*?)\s+(\w+)\s*(?:=.*)?;\s*$"
    is_field = F.col("line").rlike(field)
    resets = (F.trim("line") == "") | is_field
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__group", F.coalesce(F.sum(resets.cast("int")).over(w), F.lit(0)))
    notes = F.sort_array(F.collect_list(F.when(F.trim("line").startswith("@"), F.struct("line_no", F.trim("line").alias("a")))))
    grouped = rows.groupBy(key, "__group").agg(
        F.transform(notes, lambda x: x["a"]).alias("annotations"),
        F.max(F.when(is_field, F.struct("line_no", F.regexp_extract("line", field, 1).alias("type"), F.regexp_extract("line", field, 2).alias("field")))).alias("f"),
    ).where("f IS NOT NULL")
    joined = F.array_join("annotations", " ")
    named = F.nullif(F.regexp_extract(joined, r'@(?:Column|JoinColumn)\s*\([^)]*name\s*=\s*"([^"]+)"', 1), F.lit(""))
    related = joined.rlike(r"@(ManyToOne|OneToMany|OneToOne|ManyToMany)\b")
    inner = F.regexp_extract("f.type", r"<\s*(?:\w+\s*,\s*)?(\w+)\s*>", 1)
    return grouped.select(
        key, (F.col("f.line_no") + 1).alias("line"), F.col("f.field").alias("field"), F.trim("f.type").alias("type"), "annotations", named.alias("column_name"),
        (~joined.rlike(r"nullable\s*=\s*false|@NotNull\b|@Id\b")).alias("nullable"),
        F.when(related, F.coalesce(F.nullif(inner, F.lit("")), F.trim("f.type"))).alias("target"),
    )


def grep_values(files: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Distinct first groups of a pattern."""
    return files.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("value")).distinct()


def grep_owners(files: DataFrame, pattern: str, key: str = "file", text: str = "text") -> DataFrame:
    """Base names of the files that hold a pattern."""
    base = F.regexp_replace(F.element_at(F.split(key, "/"), -1), r"\.[^.]+$", "")
    return files.where(F.col(text).rlike(pattern)).select(base.alias("owner")).distinct()


def schedules(files: DataFrame, key: str = "file", text: str = "text", default: str = "scheduled") -> DataFrame:
    cron = F.nullif(F.regexp_extract(text, r'cron\s*=\s*"([^"]+)"', 1), F.lit(""))
    return files.where(F.col(text).rlike(r"@Scheduled\b")).select(key, F.coalesce(cron, F.lit(default)).alias("schedule"))


#: Patterns of side effects in method bodies.
EFFECTS = [
    ("persists state", r"\.(save|saveAll|insert|update|persist|merge)\("), ("deletes state", r"\.(delete|deleteAll|deleteById|remove)\("),
    ("publishes event", r"publishEvent|\.publish\(|kafkaTemplate"), ("sends mail", r"(?i)mail(sender|service)?\.send"),
    ("calls external system", r"(?i)restTemplate|webClient|feign"), ("writes log", r"\blog(ger)?\."), ("reads state", r"\.(find\w*|get\w*|load\w*)\("),
]


def operation_effects(methods: DataFrame, keys: list[str], body: str = "body") -> DataFrame:
    found = F.filter(F.array(*(F.when(F.col(body).rlike(p), F.lit(e)) for e, p in EFFECTS)), lambda x: x.isNotNull())
    return methods.select(*keys, F.explode(found).alias("effect"))


#: Families of public methods by name prefix.
OPERATION_GROUPS = [("create", "create|add|insert|register"), ("read", "get|find|list|load|search|read"), ("update", "update|change|set|modify"), ("delete", "delete|remove"), ("send", "send|notify|publish"), ("check", "validate|check|is|has")]


def operation_groups(methods: DataFrame, keys: list[str], name: str = "method") -> DataFrame:
    group = F.lit("other")
    for g, p in reversed(OPERATION_GROUPS):
        group = F.when(F.col(name).rlike(f"^({p})"), g).otherwise(group)
    return methods.groupBy(*keys, group.alias("operation_group")).agg(F.sort_array(F.collect_set(name)).alias("methods"))


def repository_catalog(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Access style and entity of repository files."""
    jpa = F.col(text).rlike(r"extends\s+(Jpa|Crud|PagingAndSorting)Repository")
    return files.where(F.col(key).rlike(r"Repository\.java$")).select(
        key, F.when(jpa, "jpa").otherwise("jdbc").alias("style"), F.nullif(F.regexp_extract(text, r"Repository<\s*(\w+)\s*,", 1), F.lit("")).alias("entity"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]\w*Mapper)\b"), F.lit(1))).alias("mappers"),
    )


def mapper_catalog(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """base / row / dto mappers."""
    kind = F.when(F.col(key).rlike(r"(?i)BaseMapper\.java$"), "base").when(F.col(text).rlike(r"implements\s+RowMapper|ResultSet"), "row").otherwise("dto")
    return files.where(F.col(key).rlike(r"Mapper\.java$")).select(key, kind.alias("mapper_kind"))


def flow_steps(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sentences of a flow text with the kind of step they tell of."""
    parts = F.filter(F.transform(F.split(text, r"[.;\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    step = F.lower("step")
    kind = (
        F.when(step.rlike("auth|permission|role|token|login"), "security").when(step.rlike("external|client|api|call|http|mail"), "external call")
        .when(step.rlike("save|store|persist|database|repository|write"), "persistence").when(step.rlike("fail|error|retry|reject|exception"), "failure").otherwise("step")
    )
    return texts.select(*keys, F.posexplode(F.array_distinct(parts)).alias("ord", "step")).withColumn("kind", kind)


def flow_scenarios(texts: DataFrame, group: str, order: list, text: str = "text", most: int = 6, fallback: str = "no scenario") -> DataFrame:
    """The first distinct texts of a group as scenarios by verb family; a group without any gets a fallback row."""
    named = unique_by(texts.where(F.length(text) > 0), [group, text], order)
    placed = named.withColumn("ord", F.row_number().over(Window.partitionBy(group).orderBy(*[F.col(o) if isinstance(o, str) else o for o in order]))).where(F.col("ord") <= most)
    low = F.lower(text)
    kind = F.when(low.rlike("create|add|register"), "creation").when(low.rlike("update|change"), "update").when(low.rlike("delete|remove"), "removal").when(low.rlike("list|find|search|read|get"), "query").otherwise("scenario")
    rows = placed.select(group, "ord", kind.alias("scenario"), F.trim(F.element_at(F.split(text, r"[.;\n]"), 1)).alias("summary"))
    bare = texts.select(group).distinct().join(rows.select(group).distinct(), group, "left_anti")
    return rows.unionByName(bare.select(group, F.lit(1).alias("ord"), F.lit("scenario").alias("scenario"), F.lit(fallback).alias("summary")))


def report_section(text: Column, name: str) -> Column:
    """Body under a named heading, up to the next heading or the end."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is)(?:^|\n)#+[ \t]*{name}[ \t]*(?:\n|$)(.*?)(?=\n#|$(?![\r\n]))", 1), r"^\s+|\s+$", ""))


def report_metrics(reports: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Number of risks, and changed files without their comments."""
    bullets = lambda name: F.filter(F.split(report_section(F.col(text), name), "\n"), lambda x: x.rlike(r"^\s*[-*]\s+\S"))
    files = F.transform(bullets("Changed files"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^\s*[-*]\s+", ""), r"\s+(—|--|#).*$", "")))
    return reports.select(*keys, F.size(bullets("Risks")).alias("n_risks"), files.alias("changed_files"))


def drift(reports: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Whether a report has drift notes, and their first 300 characters as one line."""
    body = report_section(F.col(text), "Semantic drift")
    noted = (body != "") & ~F.lower(body).rlike(r"^(none|no drift|n/a)\.?$")
    return reports.select(*keys, noted.alias("has_drift"), F.when(noted, F.substring(F.regexp_replace(body, r"\s+", " "), 1, 300)).alias("drift"))


#: Fixed values, in the order that decides the result: what stands in the place of markup (silent elements, cells, ends and
#: starts of lines, any other tag).
_MARKUP = [
    (r"(?i)<(style|script)[\s\S]*?</\1>", " "),
    (r"(?i)<t[hd][^>]*>", " | "),
    (r"(?i)<tr[^>]*>|<br\s*/?>|</(?:p|li|h[1-6])>", "\n"),
    (r"<[^>]+>", " "),
]
#: Character references that are read; an ampersand comes before the others, so that what it uncovers is read
#: too.
_REFERENCES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
_OTHER_REFERENCE = r"&(?:#[0-9]+|[a-zA-Z]+);"
#: Elements of a body with macros; parameters go, wrappers leave what they hold.
_MACRO_PARAMETER, _MACRO_WRAPPER = r"<ac:parameter[^>]*>[\s\S]*?</ac:parameter>", r"</?ac:(?:structured-macro|rich-text-body)[^>]*>"


def html_to_text(html: Column) -> Column:
    """Lines of a page body, with bars between cells."""
    for pattern, new in _MARKUP:
        html = F.regexp_replace(html, pattern, new)
    for name, letter in _REFERENCES.items():
        html = F.replace(html, F.lit(f"&{name};"), F.lit(letter))
    html = F.regexp_replace(html, _OTHER_REFERENCE, " ")
    html = F.regexp_replace(F.regexp_replace(html, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def storage_to_text(view: Column, storage: Column, least: int = 50) -> Column:
    """The rendered body if it is long enough, else the stored one on one line, without macros."""
    bare = F.regexp_replace(F.regexp_replace(storage, _MACRO_PARAMETER, ""), _MACRO_WRAPPER, "")
    line = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), r"\s+", " "))
    return F.when(F.length(view) > least, html_to_text(view)).otherwise(F.coalesce(line, F.lit("")))


def normalize_markdown(text: Column, title: Column) -> Column:
    from quarry.functions.names import sanitize_title

    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return F.concat(F.lit("# "), sanitize_title(title), F.lit("\n\n"), F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("_No text extracted._")), F.lit("\n"))
