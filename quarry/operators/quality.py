"""Rule tables and data-quality checks with severities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.durable import saved
from quarry.operators.linking import contains_any, contains_pairs
from quarry.operators.text import KNOWN_SECTIONS, REQUIRED_SECTIONS


@dataclass(frozen=True)
class Rule:
    """A pattern that must be found, and one that must not."""

    rule_id: str
    pattern: str
    output: str
    negative: str | None = None


def apply_rules(df: DataFrame, keys: list[str], text: Column, rules: list[Rule]) -> DataFrame:
    """(keys, rule_id, output) of the rules that hold: one pass over the text, whatever the number of rules."""

    def holds(r: Rule) -> Column:
        test = text.rlike(r.pattern)
        return test & ~text.rlike(r.negative) if r.negative else test

    hits = F.array(*(F.when(holds(r), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.output).alias("output"))) for r in rules))
    return df.select(*keys, F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("r")).select(*keys, "r.*")


def apply_rule_table(df: DataFrame, keys: list[str], text: str, rules: DataFrame) -> DataFrame:
    """The same for a rule table (rule_id, needle, output) of plain substrings of any size."""
    return contains_pairs(df.select(*keys, text), rules, text, "needle").select(*keys, "rule_id", "output").distinct()


#: Hints and their patterns.
PERSISTENCE_HINTS = [Rule(h, p, "persistence") for h, p in [
    ("@Entity", "(?i)@entity"), ("@Table", "(?i)@table"), ("@Column", "(?i)@column"), ("@ManyToOne", "(?i)@manytoone"), ("@OneToMany", "(?i)@onetomany"),
    ("@ManyToMany", "(?i)@manytomany"), ("@JoinColumn", "(?i)@joincolumn"), ("sql schema", "(?i)schema\\.sql|ddl|create table|alter table|insert into"), ("migration", "(?i)flyway|liquibase|migration"),
]]
SECURITY_HINTS = [Rule(h, p, "security") for h, p in [
    ("@PreAuthorize", "(?i)@preauthorize"), ("@Secured", "(?i)@secured"), ("@RolesAllowed", "(?i)@rolesallowed"), ("@SecurityFilterChain", "(?i)@securityfilterchain"),
    ("@AuthenticationPrincipal", "(?i)@authenticationprincipal"), ("authz/authn", "(?i)oauth|oidc|jwt|csrf|authority|permission|role"),
]]
INTEGRATION_HINTS = [Rule(h, p, "integration") for h, p in [
    ("@FeignClient", "(?i)@feignclient"), ("@KafkaListener", "(?i)@kafkalistener"), ("@MessageListener", "(?i)@messagelistener"), ("@EventListener", "(?i)@eventlistener"),
    ("@Scheduled", "(?i)@scheduled"), ("@Async", "(?i)@async"), ("WebSocket", "(?i)websocket"), ("Redis", "(?i)redis"), ("Mail", "(?i)mail|smtp|ses"), ("Object storage", "(?i)minio|s3|object storage"),
]]
#: Layering smells.
LAYERING_RULES = [
    Rule("service_layer_contains_client_adapters", r"(?i)SERVICE:\s*client implementations|service-local client implementation", "warning"),
    Rule("service_layer_contains_local_dtos", r"(?i)SERVICE:\s*local DTOs|service-local dto", "warning"),
    Rule("event_contracts_split_across_layers", r"(?is)(?=.*SERVICE:\s*events)(?=.*EVENTS:\s*types)", "warning"),
    Rule("service_interface_underdocumented", r"(?is)Service\b.*issue: service interface lacks descriptive documentation", "violation"),
]


#: Integration hints that a file's path gives.
PATH_HINTS = [Rule(h, p, "integration") for h, p in [("WebSocket", "(?i)websocket"), ("Redis", "(?i)redis"), ("Mail", "(?i)mail|smtp|ses"), ("Object storage", "(?i)minio|s3|object storage")]]


def hints(files: DataFrame, keys: list[str], text: str, kind: str, path: str | None = None) -> DataFrame:
    """(keys, hint) of rules that a file's text meets; integration hints also look at its path, where one is named."""
    rules = {"persistence": PERSISTENCE_HINTS, "security": SECURITY_HINTS, "integration": INTEGRATION_HINTS}[kind]
    found = apply_rules(files, keys, F.col(text), rules).select(*keys, F.col("rule_id").alias("hint"))
    if path is None or kind != "integration":
        return found
    return found.union(apply_rules(files, keys, F.coalesce(path, F.lit("")), PATH_HINTS).select(*keys, "rule_id")).distinct()


def _issue(severity: str, code: str, ref: Column) -> list[Column]:
    return [F.lit(severity).alias("severity"), F.lit(code).alias("code"), ref.alias("source_ref")]


def missing_sections(docs: DataFrame, sections: DataFrame, key: str = "doc_id", required: list[str] | None = None) -> DataFrame:
    """Required sections that a document lacks."""
    wanted = docs.select(key, F.explode(F.array(*map(F.lit, required or REQUIRED_SECTIONS))).alias("name"))
    return wanted.join(sections.select(key, "name").distinct(), [key, "name"], "left_anti")


def empty_sections(sections: DataFrame, key: str = "doc_id", known: list[str] | None = None) -> DataFrame:
    return sections.where(F.col("name").isin(known or KNOWN_SECTIONS) & (F.trim("raw") == "")).select(key, "name").distinct()


def section_issues(docs: DataFrame, sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Required sections that a document lacks, and known ones that are empty. A document's sections are told once, as two
    lists that are no longer than the fixed ones."""
    named = lambda test: F.collect_set(F.when(test, F.col("name")))
    bare = F.col("name").isin(KNOWN_SECTIONS) & (F.trim("raw") == "")
    told = saved(sections.groupBy(key).agg(named(F.col("name").isin(REQUIRED_SECTIONS)).alias("__had"), named(bare).alias("__bare")), "sections")
    lacks = F.array_except(F.array(*map(F.lit, REQUIRED_SECTIONS)), F.coalesce("__had", F.array().cast("array<string>")))
    ref = F.concat(F.lit("#"), F.col("name"))
    missing = docs.select(key).join(told.hint("merge"), key, "left").select(key, F.explode(lacks).alias("name")).select(key, *_issue("gap", "missing_section", ref))
    return missing.union(told.select(key, F.explode("__bare").alias("name")).select(key, *_issue("gap", "empty_section", ref)))


def contradictions(items: DataFrame, key: str = "doc_id", compat: bool = False) -> DataFrame:
    """Rules whose core also stands in an allowing and in a denying rule of the same document. A negated
    rule is no allowing one, unless compat asks for that."""
    rule = F.trim(F.regexp_replace(F.lower("item"), r"\s+", " "))
    core = F.trim(F.regexp_replace(F.regexp_replace(rule, r"\bmust not\b|\bmust\b|\ballow(ed)?\b|\bdeny(ied)?\b", ""), r"\s+", " "))
    positive = rule.rlike(r"\bmust\b|\ballow\b") if compat else F.regexp_replace(rule, r"\bmust not\b", "").rlike(r"\bmust\b|\ballow\b")
    rows = items.select(key, rule.alias("rule"), core.alias("core"), positive.alias("positive"), rule.rlike(r"\bmust not\b|\bdeny\b").alias("negative"))
    mine, other = rows.where("core <> ''").select(key, "core").distinct().alias("m"), rows.alias("o")
    joined = mine.join(other, (F.col(f"m.{key}") == F.col(f"o.{key}")) & F.contains(F.regexp_replace("o.rule", r"\bmust not \b|\bmust \b|\ballowed \b|\ballow \b|\bdeny \b", ""), F.col("m.core")))
    judged = joined.groupBy(F.col(f"m.{key}").alias(key), F.col("m.core").alias("core")).agg(F.bool_or("o.positive").alias("p"), F.bool_or("o.negative").alias("n"))
    return judged.where("p AND n").select(key, "core")


#: Words that tell of exposure and access, and words that answer them.
EXPOSURE, AUTHENTICATION = ["login", "ui", "api", "protected", "user interface"], ["auth", "authentication"]
ACCESS, AUTHORIZATION = ["ui", "api", "role", "permission", "access control", "ownership"], ["authorization", "authorize", "authz", "role", "permission", "access control", "ownership"]


def security_issues(texts: DataFrame, key: str, text: str, whole_words: bool = False) -> DataFrame:
    """Exposure without authentication, access without authorization."""
    t = F.col(text)
    tests = [
        ("security_missing_authentication", contains_any(t, EXPOSURE, whole_words) & ~contains_any(t, AUTHENTICATION, whole_words)),
        ("security_missing_authorization", contains_any(t, ACCESS, whole_words) & ~contains_any(t, AUTHORIZATION, whole_words)),
    ]
    codes = F.filter(F.array(*(F.when(test, F.lit(code)) for code, test in tests)), lambda x: x.isNotNull())
    return texts.select(key, F.lit("violation").alias("severity"), F.explode(codes).alias("code"))


def policy_issues(texts: DataFrame, key: str, text: str, policy: str) -> DataFrame:
    """Requirements of a policy text of which no word occurs."""
    import re

    found = [re.sub(r"(?i)^(require|must|violation)\s*:\s*", "", x.strip()).strip() for x in policy.splitlines() if re.match(r"(?i)\s*(require|must|violation)\s*:", x)]
    missed = F.filter(F.array(*(F.when(~contains_any(F.col(text), r.lower().split()), F.lit(r)) for r in found if r)), lambda x: x.isNotNull())
    return texts.select(key, F.lit("violation").alias("severity"), F.lit("security_policy_violation").alias("code"), F.explode(missed).alias("requirement"))


def unreferenced(items: DataFrame, sections: DataFrame, key: str = "doc_id", section: str = "dependencies") -> DataFrame:
    """Items whose first word (three letters at least) no other section holds."""
    first = F.element_at(F.split(F.trim(F.lower("item")), r"\s+"), 1)
    others = sections.where(F.col("name") != section).groupBy(key).agg(F.lower(F.array_join(F.array_sort(F.collect_list("raw")), "\n")).alias("__others"))
    rows = items.where(F.col("section") == section).withColumn("first_word", first).where(F.length("first_word") >= 3)
    return rows.join(others, key, "left").where(~F.contains(F.coalesce("__others", F.lit("")), F.col("first_word"))).select(key, "item_ord", "item", "first_word")


def layering_issues(texts: DataFrame, key: str, text: str) -> DataFrame:
    return apply_rules(texts, [key], F.col(text), LAYERING_RULES).select(key, F.col("output").alias("severity"), F.col("rule_id").alias("code"))


#: Thresholds and markers of a complex document.
COMPLEX_LIMITS = {"n_interfaces": 8, "n_dependencies": 8, "n_processes": 8, "n_security": 5, "n_flows": 6}
COMPLEX_MARKERS = ["module", "gateway", "repository", "controller", "scheduler", "websocket", "multi-module", "kafka", "redis", "oauth"]


def is_complex(text: Column) -> Column:
    """Two markers at least, or two counts over their limits."""
    hits, wide = F.lit(0), F.lit(0)
    for m in COMPLEX_MARKERS:
        hits = hits + F.contains(F.lower(text), F.lit(m)).cast("int")
    for c, limit in COMPLEX_LIMITS.items():
        wide = wide + (F.col(c) >= limit).cast("int")
    return (hits >= 2) | (wide >= 2)


def quality_issues(docs: DataFrame, counts: DataFrame, key: str, text: str) -> DataFrame:
    """Missing processes or interfaces, complex documents without modules, persistence without a schema."""
    none = lambda c: F.coalesce(c, F.lit(0)) == 0
    joined = docs.join(counts, key, "left").fillna(0, list(COMPLEX_LIMITS) + ["n_modules", "n_tables"])
    tests = [
        ("gap", "missing_processes", none("n_processes")), ("gap", "missing_interfaces", none("n_interfaces")),
        ("warning", "missing_modules", is_complex(F.col(text)) & none("n_modules") & (F.regexp_count(F.lower(text), F.lit(r"\bmodule\b")) < 3)),
        ("warning", "missing_database_schema", F.col(text).rlike("(?i)persistence|database|repository|table|entity|sql|postgres|store|storage|file") & none("n_tables")),
    ]
    found = F.filter(F.array(*(F.when(t, F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"))) for s, c, t in tests)), lambda x: x.isNotNull())
    return joined.select(key, F.explode(found).alias("i")).select(key, "i.*")


def diagnostics(issues: DataFrame, severity: str = "severity", line: str = "source_line") -> DataFrame:
    """Severity as an editor shows it, and the line (the first if unknown)."""
    shown = F.when(F.col(severity).isin("violation", "conflict"), "error").when(F.col(severity).isin("warning", "gap"), "warning").otherwise("info")
    return issues.withColumns({"diagnostic": shown, "line": F.coalesce(line, F.lit(1))})


def validation_summary(issues: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts per severity and the status they give."""
    n = {s: F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("gap", "conflict", "warning", "violation")}
    out = issues.groupBy(key).agg(*n.values())
    status = F.when(F.col("n_violation") + F.col("n_conflict") + F.col("n_gap") > 0, "draft").when(F.col("n_warning") > 0, "ready").otherwise("validated")
    return out.withColumn("status", status)


#: Service smells by pattern.
SMELLS = [
    Rule("misplaced client", r"(?i)package [\w.]*service[\w.]*;[\s\S]*class \w*Client", "warning"), Rule("misplaced dto", r"(?i)package [\w.]*service[\w.]*;[\s\S]*class \w*Dto", "warning"),
    Rule("misplaced event", r"(?i)package [\w.]*service[\w.]*;[\s\S]*class \w*Event\b", "warning"), Rule("undocumented interface", r"public interface \w+Service\b", "violation", r"/\*\*"),
    Rule("throws exceptions", r"throw new \w+Exception", "info"),
]


def service_smells(files: DataFrame, key: str, text: str) -> DataFrame:
    return apply_rules(files, [key], F.col(text), SMELLS).select(key, F.col("rule_id").alias("smell"), F.col("output").alias("severity"))
