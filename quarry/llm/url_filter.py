"""Operator 7, URL filters: rules first, then naive Bayes over segmented hosts and paths.

A rule names a host (itself and its subdomains) and a path prefix; the longest
that fits decides. URLs that a rule decides are the labelled rows of a
multinomial naive Bayes model, which judges all others. Its tokens are path
parts and host words: a host label is split by a unigram Viterbi search whose
word counts come from the visible words of all pages. Words that a rule names
are no tokens: they would only repeat the rule beyond its reach.

All words and tokens count. The most frequent ones, `VOCABULARY` each at most
(the documented bound of what is broadcast), are sent to the tasks; the others
are joined: words by the parts of the distinct hosts, tokens by the rows that
hold them. Class totals and word totals are sums over all of them.

Defined results: a null url, or one without `://`, has an empty host and path,
no rule and no tokens, so the class shares decide; without any labelled row, or
on a tie, the verdict is allow; repeated rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import most_frequent, stored, table

RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
VOCABULARY = 50_000
#: Letters of the longest word: a label of a host has no more, so no longer word is in one.
LONGEST_WORD = 63
#: Copies of a host's rarer words, so that the rows of one host spread over tasks.
SALTS = 32
#: Rows of parts of hosts in one Arrow batch.
PARTS = 50_000
_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit("")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), _ASCII_UPPER, _ASCII_LOWER)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: F.Column, path: F.Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[F.Column, F.Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Unigram Viterbi search over the letters of a host label. `total` is the sum of all counts, where `counts` has only some;
    `more` then has the other words among the parts of the labels that are split next."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / self.total) for w, n in counts.items()}
        self.unknown = math.log(self.total) + 2.0
        self.more: dict[str, float] = {}
        # A label's split depends on the words among its own parts only, which `more` has whole.
        self.split = lru_cache(maxsize=100_000)(self._split)

    def know(self, rarer: dict[str, int]) -> None:
        self.more = {w: -math.log(n / self.total) for w, n in rarer.items()}

    def _split(self, label: str) -> tuple[str, ...]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(label) + 1):
            choices = []
            for start in range(max(0, end - LONGEST_WORD), end):
                word = label[start:end]
                # An unknown word costs more the longer it is; digits stay together.
                cost = self.cost.get(word)
                if cost is None:
                    cost = self.more.get(word, 1.0 if word.isdigit() else self.unknown + 4.0 * (end - start))
                choices.append((best[start][0] + cost, start))
            best.append(min(choices))
        words, at = [], len(label)
        while at:
            words.append(label[best[at][1] : at])
            at = best[at][1]
        return tuple(reversed(words))


_PART = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")


def pieces_of(host: str, ruled: frozenset[str] = frozenset()) -> list[str]:
    return [piece for label in host.split(".") if label not in ruled for piece in label.split("-") if piece]


def tokens_of(host: str, path: str, segmenter: Segmenter, ruled: frozenset[str] = frozenset()) -> list[str]:
    """h:word for each word of the host, p:part for each part of the path; numbers by their length."""
    out = [f"h:{w}" for piece in pieces_of(host, ruled) for w in segmenter.split(piece)]
    return out + ["p:" + _DIGITS.sub(lambda m: f"<{len(m[0])}>", x.lower()) for x in _PART.findall(path) if x not in ruled]


def word_counts(pages: DataFrame) -> DataFrame:
    """(word, n): the visible words of all pages."""
    visible = F.regexp_replace(F.coalesce(F.col("html").cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).where((F.length("word") > 0) & (F.length("word") <= LONGEST_WORD))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _rest(counts: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """The counts that are not among the most frequent ones."""
    return counts.join(F.broadcast(top.select(key)), key, "left_anti")  # VOCABULARY rows at most


def rarer_words(hosts: DataFrame, rest: DataFrame, ruled: frozenset[str]) -> DataFrame:
    """(host, words): the words of rest(word, n) among the parts of each distinct host."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[list[str], list[str]] = ([], [])
        for batch in batches:
            for host in batch.column("host").to_pylist():
                for piece in dict.fromkeys(pieces_of(host, ruled)):
                    for start in range(len(piece)):
                        for end in range(start + 1, min(len(piece), start + LONGEST_WORD) + 1):
                            rows[0].append(host)
                            rows[1].append(piece[start:end])
                    if len(rows[0]) >= PARTS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], names=["host", "word"])
                        rows = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in rows], names=["host", "word"])

    found = hosts.mapInArrow(parts, "host string, word string").distinct().join(rest, "word")
    return found.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("words"))


def filter_urls(pages: DataFrame, *, rules: tuple[tuple[str, str], ...] = RULES, vocabulary: int = VOCABULARY) -> DataFrame:
    """page_id, host, path, rule, verdict, tokens and the model's log odds of block."""
    spark = pages.sparkSession
    counts = stored(word_counts(pages), "url-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    top_words = most_frequent(counts, "n", vocabulary)
    words = spark.sparkContext.broadcast({r["word"]: r["n"] for r in top_words.collect()})
    url = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = url.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = frozenset(x for _, text in rules for x in _PART.findall(text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words.value, total)
        for batch in batches:
            tokens = []
            for h, p, rarer in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "words")), strict=True):
                segmenter.know(dict(rarer or ()))
                tokens.append(tokens_of(h, p, segmenter, ruled))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.list_(pa.string()))], names=[*batch.schema.names[:-1], "tokens"])

    rarer = rarer_words(parts.select("host").distinct(), _rest(counts, top_words, "word"), ruled)
    salted = rarer.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")
    ruled_rows = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), salt.alias("salt"))
    own = ruled_rows.join(stored(salted, "url-rarer-words"), ["host", "salt"], "left").select("page_id", "host", "path", "rule", "fixed", "words")
    cut_ddl = "page_id long, host string, path string, rule string, fixed string, tokens array<string>"
    judged = own.mapInArrow(cut, cut_ddl).withColumn("row", F.monotonically_increasing_id())
    judged = stored(judged, "url-tokens")

    labelled = judged.where("fixed IS NOT NULL")
    classes = {r["fixed"]: r["count"] for r in labelled.groupBy("fixed").count().collect()}  # two rows
    # Frequent among all rows, so that no token left to the join is in many of them.
    counted = stored(
        judged.select("fixed", F.explode("tokens").alias("token")).groupBy("token").agg(
            F.count("*").alias("n"), F.count_if(F.col("fixed") == "block").alias("block"), F.count_if(F.col("fixed") == "allow").alias("allow")
        ), "url-token-counts",
    )
    top = most_frequent(counted, "n", vocabulary)
    known = F.col("block") + F.col("allow") > 0
    sums = counted.where(known).agg(F.count("*").alias("tokens"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("block", "allow"))).first()
    if len(classes) < 2:
        prior, unknown, n_block, n_allow = (1.0 if "block" in classes else -1.0), 0.0, 0, 0
    else:
        n_block, n_allow = (sums[c] + sums["tokens"] + 1 for c in ("block", "allow"))
        unknown = math.log(n_allow / n_block)
        prior = math.log(classes["block"] / classes["allow"])

    def odds_of(block: int, allow: int) -> float:
        return math.log((block + 1) / n_block) - math.log((allow + 1) / n_allow) if n_block and block + allow else unknown

    model = spark.sparkContext.broadcast({r["token"]: odds_of(r["block"], r["allow"]) for r in top.collect()})

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(row, t) for row, own in zip(*(batch.column(c).to_pylist() for c in ("row", "tokens")), strict=True) for t in own if t not in model.value]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["row", "token"])

    rest = _rest(counted, top, "token").where(known).select("token", "block", "allow")
    found = judged.select("row", "tokens").mapInArrow(left, "row long, token string").join(rest, "token")
    found = found.groupBy("row").agg(F.collect_list(F.struct("block", "allow")).alias("found"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = model.value.get
        for batch in batches:
            sums = []
            for own, rarer in zip(*(batch.column(c).to_pylist() for c in ("tokens", "found")), strict=True):
                odds = [get(t) for t in own]
                rarer = [odds_of(x["block"], x["allow"]) for x in rarer or ()]
                blank = sum(x is None for x in odds) - len(rarer)
                sums.append(prior + math.fsum([x for x in odds if x is not None] + rarer + [unknown] * blank))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.float64())], names=[*batch.schema.names[:-1], "log_odds"])

    judged = judged.join(found, "row", "left").drop("row")
    method = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return judged.mapInArrow(score, cut_ddl + ", log_odds double").select("page_id", "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"), "tokens", "log_odds")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "log_odds")
