"""Operator 4, quality rules: robust multivariate outliers per language and source.

Each text is reduced to counts, the counts to a vector of five transformed
statistics, and the vectors of a language and source to a centre and a scatter
by the minimum covariance determinant: from a deterministic start (medians and
median absolute deviations) concentration steps move to the fraction `H_SHARE`
of the rows with the least Mahalanobis distances until the determinant is
settled; a reweighting step follows. Rows far from the robust centre go.

Every step is one aggregation over all rows. Vectors are whole numbers (fixed
point), so sums do not depend on the order of tasks; the subset is picked on a
fine histogram of log distances, rounded up to a whole bin. A step sends at
most `BINS` rows of sums per group to a task, whatever the size of the group,
and a hot source is summed where its rows are.

Groups under `MIN_ROWS` rows are pooled by language, and pools still under it
across languages; a last pool under it has no estimate and keeps what passes
the base rule.

Defined results: a null or empty text has no words and fails the base rule;
null languages and sources are values of their own; repeated rows are judged
one by one; `keep_documents` returns all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import SPACE_BYTES, as_bytes, stored, table, tasks_for, unused

SYMBOLS = b"#*$%&|<>"
DIM = 5
#: Units of the fixed-point vectors, and their largest absolute value.
SCALE, LARGEST = 4096, 1 << 15
H_SHARE, MIN_ROWS = 0.7, 50
BINS, BINS_PER_DOUBLING = 1024, 16
#: Least standard deviations: differences below these are never a reason to reject.
FLOORS = np.array([0.06, 0.05, 0.06, 0.12, 0.16]) * SCALE
#: Quantiles of chi-square with five degrees of freedom at 0.5, 0.975 and 0.99999.
CHI_HALF, CHI_WEIGHT, CHI_CUT = 4.351, 12.833, 30.856

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words that the text holds twice or more (exact: windows are ranked, not hashed)."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    ranks = ids
    for k in range(1, size):
        joined = ranks[: len(ids) - k] * len(known) + ids[k:]
        _, ranks = np.unique(joined, return_inverse=True)
    twice = np.bincount(ranks)[ranks] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : size + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The values of COUNTS for one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    codes = np.frombuffer(text, np.uint8)
    table_ = np.bincount(codes, minlength=256)
    starts = len(text) - int(table_[0x80:0xC0].sum())
    chars = starts - sum(int(table_[b]) for b in SPACE_BYTES)
    lines = [x for x in text.split(b"\n") if x.strip(SPACE_BYTES)]
    return (
        len(words), chars, sum(int(table_[b]) for b in SYMBOLS), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), int(table_[0x41:0x5B].sum()),
    )


def vectors(counts: np.ndarray) -> np.ndarray:
    """Fixed-point statistic vectors of rows of COUNTS: word length, and square roots of the densities of
    symbols, capitals, repeated words and repeated lines. Constants added to the denominators calm short texts."""
    words, chars, symbols, dup, repeat, lines, upper = counts.T.astype(float)
    x = np.stack([
        np.log((chars + 240) / (words + 40)), np.sqrt(symbols / (chars + 100)), np.sqrt(upper / (chars + 100)),
        np.sqrt(repeat / (words + 20)), np.sqrt(dup / (lines + 5)),
    ], axis=1)
    return np.clip(np.rint(x * SCALE), -LARGEST, LARGEST).astype(np.int64)


_KEYED = [("lang", pa.string()), ("source", pa.string())]
_STATS = pa.schema([("doc_id", pa.int64()), *_KEYED, *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), *((f"x{i}", pa.int64()) for i in range(DIM))])
_STATS_DDL = f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, {', '.join(f'x{i} long' for i in range(DIM))}"


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts, base rule and statistic vector of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t) for t in as_bytes(batch.column("text"))], np.int64).reshape(-1, len(COUNTS))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "lang", "source")), *map(pa.array, counts.T), pa.array(failed), *map(pa.array, vectors(counts).T)], schema=_STATS
            )

    picked = docs.select(F.col("doc_id").cast("long"), *(F.col(c).cast("string") for c in ("text", "lang", "source")))
    return picked.mapInArrow(run, _STATS_DDL)


def _pooled(stats: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(group of each language and source, rows with their group). Small groups share a pool."""
    counts = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = counts.where(F.col("n") < min_rows).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    groups = stored(
        counts.alias("c").join(by_lang.alias("b"), F.col("c.lang").eqNullSafe(F.col("b.lang")) & (F.col("c.n") < min_rows), "left")
        .select(
            F.col("c.lang").alias("lang"), F.col("c.source").alias("source"),
            F.when(F.col("n") >= min_rows, F.sha2(F.to_json(F.struct(F.col("c.lang").alias("l"), F.col("c.source").alias("s"))), 256))
            .when(F.col("n_lang") >= min_rows, F.sha2(F.to_json(F.struct(F.col("c.lang").alias("l"))), 256)).otherwise("pool").alias("grp"),
        ), "quality-groups",
    )
    return groups, _grouped(stats, groups)


def _grouped(stats: DataFrame, groups: DataFrame) -> DataFrame:
    g = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "grp")
    return stats.join(g, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")


_PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
#: Groups up to this number are sent to all tasks: 25 MB of parameters at most.
GROUPS_SENT = 100_000
_PARAMS = f"grp string, n long, log_det double, settled boolean, cut double, factor double, {', '.join(f'm{i} double' for i in range(DIM))}, {', '.join(f'p{i}{j} double' for i, j in _PAIRS)}"


def _params(grp: str, n: int, centre: np.ndarray, scatter: np.ndarray, cut: float, factor: float, log_det: float | None = None) -> pd.DataFrame:
    floored = scatter + np.diag(FLOORS**2)
    precision = np.linalg.inv(floored)
    row = {"grp": grp, "n": n, "log_det": float(np.linalg.slogdet(floored)[1]) if log_det is None else log_det, "settled": False, "cut": cut, "factor": factor} | {f"m{i}": centre[i] for i in range(DIM)}
    return pd.DataFrame([row | {f"p{i}{j}": precision[i, j] * (1 if i == j else 2) for i, j in _PAIRS}])


def _start(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations from the value histogram of a group."""
    centre, spread, n = np.zeros(DIM), np.zeros(DIM), 0
    for i, own in pdf.groupby("dim"):
        own = own.sort_values("value")
        values, weights = own["value"].to_numpy(float), own["n"].to_numpy()
        n = int(weights.sum())
        centre[i] = values[np.searchsorted(np.cumsum(weights), (n + 1) // 2)]
        off = np.abs(values - centre[i])
        order = np.argsort(off, kind="stable")
        spread[i] = 1.4826 * off[order][np.searchsorted(np.cumsum(weights[order]), (n + 1) // 2)]
    return _params(key[0], n, centre, np.diag(spread**2), 0.0, 1.0, np.inf)


def distance() -> F.Column:
    """Squared Mahalanobis distance of a row joined with its group's parameters."""
    off = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIM)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + F.col(f"p{i}{j}") * off[i] * off[j]
    return total / F.col("factor")


def _step(last: bool):  # noqa: ANN202
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """New parameters from the sums per distance bin of one group."""
        pdf = pdf.sort_values("bin")
        n = pdf["n"].to_numpy()
        total, seen = int(n.sum()), np.cumsum(n)
        edges = 2.0 ** ((pdf["bin"].to_numpy() + 1 - BINS // 2) / BINS_PER_DOUBLING)
        # Consistent scale: the median distance is that of a normal sample.
        factor = max(edges[np.searchsorted(seen, (total + 1) // 2)] / CHI_HALF, 1e-9)
        take = edges <= CHI_WEIGHT * factor if last else np.arange(len(n)) <= np.searchsorted(seen, int(np.ceil(H_SHARE * total)))
        take[0] = True
        m = int(n[take].sum())
        sums = np.array([int(pdf[f"s{i}"].to_numpy()[take].sum()) for i in range(DIM)], float) / m
        scatter = np.zeros((DIM, DIM))
        for i, j in _PAIRS:
            scatter[i, j] = scatter[j, i] = int(pdf[f"s{i}{j}"].to_numpy()[take].sum()) / m - sums[i] * sums[j]
        return _params(key[0], total, sums, scatter, CHI_CUT, 1.0)

    return step


def _with_params(rows: DataFrame, params: DataFrame, how: str) -> DataFrame:
    """Parameters of few groups are sent to the rows, so that no group's rows are brought together."""
    few = params.limit(GROUPS_SENT + 1).count() <= GROUPS_SENT
    return rows.join(F.broadcast(params) if few else params, "grp", how)


def _stepped(rows: DataFrame, params: DataFrame, *, last: bool) -> DataFrame:
    """Parameters after one step over all rows."""
    place = F.floor(F.log2(F.greatest(distance(), F.lit(1e-9))) * BINS_PER_DOUBLING) + BINS // 2
    sums = (
        _with_params(rows, params, "inner").withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(BINS - 1)).cast("int"))
        .groupBy("grp", "bin").agg(
            F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(DIM)),
            *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _PAIRS),
        )
    )
    return sums.groupBy("grp").applyInPandas(_step(last), _PARAMS)


def fit(stats: DataFrame, *, min_rows: int = MIN_ROWS) -> tuple[DataFrame, DataFrame]:
    """(groups, parameters per group) of the minimum covariance determinant over all rows that pass the base rule."""
    groups, rows = _pooled(stats, min_rows)
    rows = stored(rows.where("NOT base_failed").select("grp", *(f"x{i}" for i in range(DIM))), "quality-vectors")
    values = rows.select("grp", F.posexplode(F.array(*(F.col(f"x{i}") for i in range(DIM)))).alias("dim", "x"))
    histogram = values.groupBy("grp", "dim", (F.floor(F.col("x") / 16) * 16).alias("value")).agg(F.count("*").alias("n"))
    save = lambda df: stored(df.coalesce(tasks_for(0)), "quality-params")
    params = save(histogram.groupBy("grp").applyInPandas(_start, _PARAMS))
    # A step that does not lower a group's determinant is not taken, and settles the group: determinants only fall,
    # so this ends.
    names = params.columns
    while params.where("NOT settled").limit(1).count():
        new = _stepped(rows, params.where("NOT settled"), last=False)
        both = params.select("grp", F.struct(*names).alias("old")).join(new.select("grp", F.struct(*names).alias("new")), "grp", "left")
        falls = F.col("new.log_det") < F.col("old.log_det") - 1e-6
        settled = F.coalesce(~falls, F.lit(True))
        params = save(both.select("grp", *(F.when(settled, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in names[1:] if c != "settled"), settled.alias("settled")).select(names))
    params = save(_stepped(rows, params, last=True))
    return groups, params.where(F.col("n") >= min_rows)


def verdicts(stats: DataFrame, groups: DataFrame, params: DataFrame) -> DataFrame:
    """Adds distance and kept."""
    judged = _with_params(_grouped(stats, groups), params, "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= F.coalesce(F.col("cut"), F.lit(0.0)))
    return judged.withColumn("kept", kept)


def judge_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Per document: counts, base rule, distance and verdict."""
    stats = stored(text_statistics(docs), "quality-stats")
    groups, params = fit(stats, **options)
    return verdicts(stats, groups, params)


def keep_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The documents that pass, with all their columns. Texts are counted again rather than shuffled to a join."""
    groups, params = fit(stored(text_statistics(docs), "quality-stats"), **options)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([text_counts(t) for t in as_bytes(batch.columns[-1])], np.int64).reshape(-1, len(COUNTS))
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            columns = [*batch.columns[:-1], pa.array(failed), *map(pa.array, vectors(counts).T)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = [f"__c{i}" for i in range(len(docs.columns))]
    names = [*own, "base_failed", *(f"x{i}" for i in range(DIM))]
    renamed = docs.select("*", F.col("text").cast("string").alias(unused(docs, "whole_text"))).toDF(*own, "whole_text")
    at = {c: own[i] for i, c in enumerate(docs.columns)}
    out = renamed.mapInArrow(mark, ", ".join([f"{c} {t}" for c, t in renamed.dtypes[:-1]] + ["base_failed boolean"] + [f"x{i} long" for i in range(DIM)]))
    out = out.withColumns({"lang": F.col(at["lang"]).cast("string"), "source": F.col(at["source"]).cast("string")})
    return verdicts(out, groups, params).where("kept").select(*(F.col(n).alias(c) for n, c in zip(own, docs.columns, strict=True)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
