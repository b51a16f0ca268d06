"""URL filter: rules first, then naive Bayes over words that Viterbi finds in host and path.

Concatenated names are split into the words of the most probable reading under
unigram counts of all words of the pages' own text: each distinct name is
joined with the counts of its own substrings, so no task holds the words.  The multinomial naive Bayes model
learns from the pages that a rule decides, after a short list of words of
advertising, tracking and adult hosts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Hashed features of the naive Bayes model (a fixed model size).
FEATURES = 1 << 16
#: Longest word looked for; substrings in one batch.
LONGEST, BATCH = 24, 100_000
#: Most names whose weights go to every task (the most frequent; those of all other names are joined).
NAMES = 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NAME = re.compile(r"[^\W\d_]+|\d+")

# Words of advertising, tracking and adult hosts; each counts as SEEN blocked occurrences beforehand.
BLOCK_WORDS = ["ad", "ads", "advert", "adult", "banner", "bet", "casino", "click", "doubleclick", "gambling", "loan", "malware",
               "phishing", "popup", "porn", "sex", "spam", "track", "tracker", "tracking", "viagra", "xxx"]
SEEN = 50


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and for paths that start with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def with_host_path(pages: DataFrame, url_col: str) -> DataFrame:
    """Adds host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path
    (from there up to ``?``, ``#`` or the end); null urls and urls without ``://`` have empty ones."""
    rest = F.when(F.locate("://", F.col(url_col)) > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    return (pages.withColumn("host", F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)))


def rule_column(rules: list[Rule]) -> Column:
    """The text of the longest rule that fits host and path (ties: the smaller text), else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, r.text).otherwise(out)
    return out


class Segmenter:
    """Unigram Viterbi over one name."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total``: of all words, if ``counts`` has only those that occur in the names to be split."""
        total = sum(counts.values()) + 1 if total is None else total
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.unknown = math.log(total) + 2.0  # of a one-letter unknown word; each more letter costs as much as a rare letter
        self.letter = math.log(26)

    def split(self, name: str) -> tuple[str, ...]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - LONGEST), end):
                cost = self.cost.get(name[start:end])
                cost = best[start] + (cost if cost is not None else self.unknown + self.letter * (end - start - 1))
                if cost < best[end]:
                    best[end], back[end] = cost, start
        out = []
        while n:
            out.append(name[back[n]:n])
            n = back[n]
        return tuple(out[::-1])

    def tokens(self, host: str, path: str) -> list[str]:
        """Words of the host (marked) and of the path; numbers count by their length."""
        return [mark + w for mark, name in names(host, path) for w in ([name] if name[0] == "#" else self.split(name))]


def names(host: str, path: str) -> list[tuple[str, str]]:
    """(mark, name) of each name of host and path in order; a number is ``#`` and its length."""
    return [(mark, f"#{len(name)}" if name.isdigit() else name)
            for mark, text in (("h:", host), ("p:", path.lower())) for name in _NAME.findall(text)]


def feature(token: str) -> int:
    """Stable hash of a token (FNV-1a) into the model's features."""
    h = 0xCBF29CE484222325
    for b in token.encode("utf-8"):
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 32) % FEATURES


@dataclass
class Bayes:
    """Multinomial naive Bayes with add-one smoothing over hashed features; classes allow and block."""
    counts: np.ndarray  # (2, FEATURES)
    pages: np.ndarray   # (2,)

    def weights(self) -> tuple[float, np.ndarray]:
        """Log odds of block: prior and per feature."""
        if not self.pages.all():  # one class or none was seen
            return (1.0 if self.pages[1] else -1.0), np.zeros(FEATURES)
        seen = (self.counts.sum(axis=0) > 0).sum() + 1
        p = (self.counts + 1) / (self.counts.sum(axis=1, keepdims=True) + seen)
        return float(np.log(self.pages[1] / self.pages[0])), np.log(p[1]) - np.log(p[0])


def word_counts(pages: DataFrame, html_col: str) -> DataFrame:
    """(w, c): counts of all words in all pages' text outside of tags."""
    text = F.translate(F.regexp_replace(F.col(html_col), "<[^>]*>", " "), UPPER, LOWER)
    found = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"\p{L}+"), 0)).alias("w")).where(F.length("w") <= LONGEST)
    return written(pages.sparkSession, found.groupBy("w").agg(F.count("*").alias("c")), "page-words")


def word_model(pages: DataFrame, html_col: str) -> Segmenter:
    """The unigram model of all words on the driver, for tables whose words fit there; filter_urls doesn't need it."""
    counts = {r.w: r.c for r in word_counts(pages, html_col).collect()}
    return Segmenter(counts | {w: max(counts.get(w, 0), SEEN) for w in BLOCK_WORDS})


def split_names(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, parts) of every row of ``distinct(name)`` by its own words' counts and the total of all words."""
    listed = {r.w: r.c for r in counts.where(F.col("w").isin(BLOCK_WORDS)).collect()}
    more = sum(max(SEEN - listed.get(w, 0), 0) for w in BLOCK_WORDS)
    total = int(counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first().c) + more + 1

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, subs = [], []
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if name[0] == "#":
                    continue
                for start in range(len(name)):
                    ends = range(start + 1, min(len(name), start + LONGEST) + 1)
                    subs += [name[start:end] for end in ends]
                    of += [name] * len(ends)
                    if len(subs) >= BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(subs, pa.string())], names=["name", "w"])
                        of, subs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(subs, pa.string())], names=["name", "w"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for name, ws, cs in zip(*(c.to_pylist() for c in batch.columns)):
                own = dict(zip(ws or [], cs or []))
                own |= {w: max(own.get(w, 0), SEEN) for w in BLOCK_WORDS if w in name}
                parts.append([name] if name[0] == "#" else list(Segmenter(own, total).split(name)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["name", "parts"])

    hits = distinct.mapInArrow(substrings, "name string, w string").join(counts, "w")
    lists = hits.groupBy("name").agg(F.collect_list(F.struct("w", "c")).alias("x")).select("name", "x.w", "x.c")
    got = distinct.join(lists, "name", "left").select("name", "w", "c").mapInArrow(split, "name string, parts array<string>")
    return written(distinct.sparkSession, got, "url-splits")


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                frequent: int = NAMES) -> DataFrame:
    """Verdict of every page by rule or, where none fits, by naive Bayes.

    Returns (page_id, host, path, rule, verdict, block_odds), one row per row
    of ``pages``; block_odds is the model's log odds.  A null url has an empty
    host and path.  Without pages decided by both kinds of rule the model says
    what the one kind says, or allow.  Null html has no words; ids may be null
    or repeated; other columns are not looked at.  ``frequent`` bounds the names
    whose weights go to every task and has no effect on the result.
    """
    spark = pages.sparkSession
    counts = word_counts(pages.select(F.col(html_col).alias("html")), "html")
    rows = with_host_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.text, r.verdict)]) if rules else F.create_map().cast("map<string,string>")
    rows = rows.withColumn("rule", rule_column(rules)).withColumn("ruled", F.element_at(verdicts, F.col("rule"))).drop("url")
    rows = written(spark, rows.withColumn("row", F.monotonically_increasing_id()), "url-rows")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = Counter()
            for host, path, ruled in zip(*(c.to_pylist() for c in batch.columns)):
                side = -1 if ruled is None else int(ruled == "block")
                got.update((side, mark, name) for mark, name in names(host, path))
            side, mark, name = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()), pa.array(mark, pa.string()), pa.array(name, pa.string()),
                                              pa.array(list(got.values()), pa.int64())], names=["side", "mark", "name", "n"])

    used = written(spark, rows.select("host", "path", "ruled").mapInArrow(named, "side long, mark string, name string, n long")
                   .groupBy("side", "mark", "name").agg(F.sum("n").alias("n")), "url-names")  # at most 6 rows a name
    splits = split_names(used.select("name").distinct(), counts)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, FEATURES), np.int64)
        for batch in batches:
            for side, mark, n, parts in zip(*(c.to_pylist() for c in batch.columns)):
                for w in parts:
                    counts[side, feature(mark + w)] += n
        side, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(at), pa.array(counts[side, at])], names=["side", "f", "c"])

    model = Bayes(np.zeros((2, FEATURES)), np.zeros(2))
    for w in BLOCK_WORDS:
        model.counts[1, feature("h:" + w)] += SEEN
    seen = rows.where("ruled is not null").groupBy((F.col("ruled") == "block").cast("int").alias("side")).agg(F.count("*").alias("n"))
    for r in seen.collect():
        model.pages[r.side] = r.n
    learned = used.where("side >= 0").join(splits, "name").select("side", "mark", "n", "parts")
    for r in learned.mapInArrow(learn, "side long, f long, c long").groupBy("side", "f").agg(F.sum("c").alias("c")).collect():
        model.counts[r.side, r.f] += r.c
    weights = spark.sparkContext.broadcast(model.weights())

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value[1]
        for batch in batches:
            sums = [[float(sum(weight[feature(mark + w)] for w in parts)) for parts in batch.column(1).to_pylist()] for mark in ("h:", "p:")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.float64()) for x in sums)], names=["name", "h", "p"])

    worth = splits.mapInArrow(weighed, "name string, h double, p double")
    # the most frequent names go to every task, down to the count level where they stay below the limit
    often = used.groupBy("name").agg(F.sum("n").alias("n")).withColumn("level", F.floor(F.log2("n") * 64))
    held, lowest, rare = 0, 1 << 20, False
    for r in often.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        held += r.n
        if held > frequent:
            rare = True
            break
        lowest = r.level
    shared = spark.sparkContext.broadcast(
        {r.name: (r.h, r.p) for r in worth.join(often.where(F.col("level") >= lowest).select("name"), "name").select("name", "h", "p").collect()})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = [(row, at, mark, name) for row, host, path in zip(*(c.to_pylist() for c in batch.columns))
                   for at, (mark, name) in enumerate(names(host, path)) if name not in known]
            row, at, mark, name = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(mark, pa.string()),
                                              pa.array(name, pa.string())], names=["row", "at", "mark", "name"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, prior = shared.value, weights.value[0]
        for batch in batches:
            odds = []
            for host, path, far in zip(*(batch.column(i).to_pylist() for i in (1, 2, 6))):
                rest = iter(x["x"] for x in far or [])  # in order of their places
                odds.append(prior + sum(known[name][mark == "p:"] if name in known else next(rest) for mark, name in names(host, path)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(odds, pa.float64())], names=[*batch.schema.names[:5], "block_odds"])

    if rare:
        far = (rows.select("row", "host", "path").mapInArrow(others, "row long, at long, mark string, name string").join(worth, "name")
               .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.when(F.col("mark") == "h:", F.col("h")).otherwise(F.col("p")).alias("x")))).alias("far")))
        rows = rows.join(far, "row", "left")
    else:
        rows = rows.withColumn("far", F.lit(None).cast("array<struct<at:bigint,x:double>>"))
    rows = rows.select("page_id", "host", "path", "rule", "ruled", "row", "far")
    kind = rows.schema["page_id"].dataType.simpleString()
    judged = rows.mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, ruled string, block_odds double")
    verdict = F.coalesce("ruled", F.when(F.col("block_odds") > 0, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_odds")
