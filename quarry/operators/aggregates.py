"""Counts, families, catalogs and reports over corpora and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.names import endpoint_family, package_of
from quarry.operators.relational import top_k


def package_relations(deps: DataFrame, src: str = "from_type", dst: str = "to_type", cap: int = 500) -> DataFrame:
    """Dependencies per pair of packages, most first; the report's cap is a parameter."""
    pairs = deps.select(package_of(src).alias("from_package"), package_of(dst).alias("to_package")).where("from_package <> to_package")
    return pairs.groupBy("from_package", "to_package").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_package", "to_package").limit(cap)


def endpoint_families(endpoints: DataFrame, path: str, method: str, order: str, samples: int = 3) -> DataFrame:
    """Family, count, and the first distinct samples. Only `samples` rows per family are gathered."""
    rows = endpoints.withColumn("family", endpoint_family(path))
    counts = rows.groupBy("family").agg(F.count("*").alias("n"))
    first = top_k(rows, ["family"], [order], samples)
    named = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.concat_ws(" ", method, path).alias("s")))), lambda x: x["s"]))
    return counts.join(first.groupBy("family").agg(named.alias("samples")), "family")


def kind_counts(df: DataFrame, kind: str) -> DataFrame:
    """Count per kind and a total row with a null kind."""
    return df.rollup(kind).agg(F.count("*").alias("n"))


def package_counts(files: DataFrame, name: str, depth: int | None = None) -> DataFrame:
    package = package_of(name)
    if depth:
        package = F.array_join(F.slice(F.split(package, r"\."), 1, depth), ".")
    return files.groupBy(package.alias("package")).agg(F.count("*").alias("n"))


def label_histogram(nodes: DataFrame, labels: str, cap: int = 30) -> DataFrame:
    return nodes.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(cap)


def package_index(ast: DataFrame, imports_cap: int = 12) -> DataFrame:
    """ast(package, file, type_name, imports): files, types and the first sorted imports per package."""
    base = ast.groupBy("package").agg(F.countDistinct("file").alias("n_files"), F.countDistinct("type_name").alias("n_types"))
    used = ast.select("package", F.explode("imports").alias("i")).distinct()
    few = top_k(used, ["package"], ["i"], imports_cap).groupBy("package").agg(F.sort_array(F.collect_list("i")).alias("imports"))
    return base.join(few, "package", "left")


def annotation_index(types: DataFrame, name: str, annotations: str) -> DataFrame:
    """Per annotation: its types, each once, sorted."""
    rows = types.select(name, F.explode(F.array_distinct(annotations)).alias("annotation"))
    return rows.groupBy("annotation").agg(F.countDistinct(name).alias("n"), F.sort_array(F.collect_set(name)).alias("types"))


def lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """Key/value table of distinct values per key."""
    return df.select(F.col(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL AND value IS NOT NULL").distinct()


def index_summary(ast: DataFrame) -> DataFrame:
    return ast.agg(
        F.countDistinct("package").alias("n_packages"), F.countDistinct("file").alias("n_files"), F.countDistinct("type_name").alias("n_types"),
        F.sum(F.size("imports")).alias("n_imports"), F.sum(F.size("methods")).alias("n_methods"), F.sum(F.size("fields")).alias("n_fields"), F.sum(F.size("annotations")).alias("n_annotations"),
    )


def flag_counts(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Conditional counts in one pass."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in flags.items()))


def module_dossiers(df: DataFrame, module: str, flags: dict[str, Column], catalogs: dict[str, Column]) -> DataFrame:
    """Per module: conditional counts and sorted distinct catalogs."""
    return df.groupBy(module).agg(*(F.count_if(c).alias(n) for n, c in flags.items()), *(F.sort_array(F.collect_set(c)).alias(n) for n, c in catalogs.items()))


def observations(df: DataFrame, keys: list[str], rules: list[tuple[Column, str]]) -> DataFrame:
    """Texts of the threshold rules that hold, in order."""
    found = F.filter(F.array(*(F.when(t, F.lit(o)) for t, o in rules)), lambda x: x.isNotNull())
    return df.select(*keys, F.posexplode(found).alias("ord", "observation"))


def auth_mode(protected: Column, total: Column) -> Column:
    return F.when(protected == 0, "public").when(protected >= total, "protected").otherwise("mixed")


def repo_structure(paths: DataFrame, path: str) -> DataFrame:
    """Top-level roots, their children and the role that follows from them."""
    parts = F.split(path, "/")
    rows = paths.select(F.element_at(parts, 1).alias("root"), F.try_element_at(parts, F.lit(2)).alias("child")).distinct()
    n = rows.groupBy("root").agg(F.count("child").alias("n_children"))
    role = F.when(F.col("root").rlike("(?i)build|bom|version"), "build").when(F.col("root").rlike("(?i)doc"), "documentation").when(F.col("n_children") > 1, "multi-module application").otherwise("application")
    return n.withColumns({"role": role, "multi_module": F.col("n_children") > 1})


def common_prefix(df: DataFrame, keys: list[str], column: str, sep: str = ".") -> DataFrame:
    """Longest common prefix of whole parts: that of the least and the greatest value."""
    cut = F.split(column, sep.replace(".", r"\."))
    ends = df.groupBy(*keys).agg(F.min(cut).alias("a"), F.max(cut).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.when(F.array_contains(same, False), F.array_position(same, False) - 1).otherwise(F.size("a")).cast("int")
    return ends.select(*keys, F.array_join(F.slice("a", F.lit(1), n), sep).alias("prefix"))


def internal_modules(df: DataFrame, group: str, package: str, folder: str) -> DataFrame:
    """Module of each row: the package part after the common prefix, else the folder."""
    prefix = common_prefix(df, [group], package)
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", r"\.")))
    named = F.try_element_at(F.split(package, r"\."), (depth + 1).cast("int"))
    return df.join(prefix, group).groupBy(group, F.coalesce(named, F.col(folder)).alias("module")).agg(F.count("*").alias("n"))


def merged_items(df: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Distinct sorted items of each key."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_set(item)).alias("items"))


def package_slices(df: DataFrame, keys: list[str], package: str, depth: int = 4) -> DataFrame:
    return df.select(*keys, F.array_join(F.slice(F.split(package, r"\."), 1, depth), ".").alias("slice")).distinct()


def verification(missing: DataFrame, categories: list[str], evidence: int = 20) -> DataFrame:
    """One row per check: ok or warning, number of missing items, and the first of them."""
    spark = missing.sparkSession
    checks = spark.range(1).select(F.explode(F.array(*map(F.lit, categories))).alias("category"))
    counts = missing.groupBy("category").agg(F.count("*").alias("n"))
    key = next(c for c in missing.columns if c != "category")
    few = top_k(missing, ["category"], [key], evidence).groupBy("category").agg(F.sort_array(F.collect_list(F.col(key).cast("string"))).alias("evidence"))
    out = checks.join(counts, "category", "left").join(few, "category", "left")
    return out.select("category", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.coalesce("n", F.lit(0)) > 0, "warning").otherwise("ok").alias("status"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


#: Slices that checks of a category belong to; two categories belong to none.
VERIFICATION_SLICES = {"endpoints": ["api"], "services": ["service"], "repositories": ["persistence"], "flows": ["flow", "service"], "files": ["structure"]}


def verification_slices(checks: DataFrame) -> DataFrame:
    pairs = [(c, s) for c, ss in VERIFICATION_SLICES.items() for s in ss]
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(s).alias("s")) for c, s in pairs))
    rows = checks.select("*", F.explode(F.filter(table, lambda x: x["c"] == F.col("category"))).alias("p"))
    return rows.groupBy(F.col("p.s").alias("slice")).agg(F.count("*").alias("n_checks"), F.count_if(F.col("status") != "ok").alias("n_issues"))


def top_lists(df: DataFrame, kind: str, name: str, n: str, k: int = 12) -> DataFrame:
    """The k first names of each kind by count."""
    return top_k(df, [kind], [F.desc(n), name], k)


def insight_buckets(nodes: DataFrame, name: str, label: str, rules: list[tuple[str, Column]], fallback: str = "other") -> DataFrame:
    """Names per role: by type, prefix or keyword, in order."""
    role = F.lit(fallback)
    for r, test in reversed(rules):
        role = F.when(test, r).otherwise(role)
    return nodes.groupBy(role.alias("role")).agg(F.countDistinct(name).alias("n"), F.sort_array(F.collect_set(name)).alias("names"))
