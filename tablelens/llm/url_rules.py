"""Judge urls by host and path rules: a sort-merge range join swept with a stack of active nested rules.

A rule (host, path, verdict) fits its host and all subdomains where the url's path starts with the rule's path. The key of a
rule is its host with the labels reversed, each followed by a dot, then its path: `example.com/en/` becomes
`com.example./en/`. All keys that begin with it form one interval [key, key + 0xFF). A url stands at one point for each of
its parent hosts that a rule can name (as many labels as the deepest rule has), so that subdomains need no interval of their
own: `www.example.com/en/x` stands at `com./en/x`, `com.example./en/x` and `com.example.www./en/x`.

Different urls (host and path) are taken once. Cut points of a bounded sample of their keys (`CUTS` per bucket; they only
balance the work) cut the key order into buckets; a rule goes to each bucket that its interval meets, which for all rules
together is one row each and the nesting depth at every cut. A task sorts its buckets by key and sweeps them: rules whose
interval has ended leave the stack, a point takes the top, which is the longest active rule. The longest rule over the
points of a url wins (then the one of the longer host), and is joined back to the rows by host and path.

Defined cases: a NULL url or one without `://` has an empty host and path. Only A to Z are lower-cased. A rule with an empty
or NULL host fits every host, one with an empty or NULL path every path; a path that is not empty and does not begin with a
slash fits nothing. Of equal rules the greatest verdict in code-point order holds (block before allow); a rule with a NULL
verdict is none. Repeated rows are judged alike. Other columns stay, but those named like an added column are replaced.
No pages give no rows; without rules every url gets the default.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import stage
from .native import upto

ADDED = ("host", "path", "rule", "verdict")
#: Keys looked at for each cut between buckets, and the bytes of a key that a cut keeps.
CUTS, CUT_BYTES = 32, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FOUND = "host string, path string, rule string, verdict string, rule_host string"
_FOUND_ARROW = pa.schema([(c.split()[0], pa.string()) for c in _FOUND.split(", ")])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A to Z lower-cased) and the path of a url, without query and fragment."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def _labels(host: Column) -> Column:
    """Labels from the right, none of an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.", -1)))


def _key(labels: Column, path: Column) -> Column:
    return F.encode(F.concat(F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), ""), path), "UTF-8")


def rule_table(rules: DataFrame) -> DataFrame:
    """(host, path, verdict, key, end, n_labels) of the different rules that can fit."""
    host, path = F.coalesce(F.translate("host", UPPER, LOWER), F.lit("")), F.coalesce("path", F.lit(""))
    rows = rules.select(host.alias("host"), path.alias("path"), "verdict").where("verdict IS NOT NULL AND (path = '' OR path LIKE '/%')")
    rows = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    key = _key(_labels(F.col("host")), F.col("path"))
    return rows.select("*", key.alias("key"), F.concat(key, F.lit(b"\xff")).alias("end"), F.size(_labels(F.col("host"))).alias("n_labels"))


def _points(urls: DataFrame, least: int, most: int) -> DataFrame:
    """(host, path, key): a row for each parent host of as many labels as rules have."""
    labels = _labels(F.col("host"))
    rows = urls.select("host", "path", labels.alias("labels")).select("host", "path", "labels", F.explode(
        F.filter(upto(F.size("labels") + 1), lambda d: d.between(least, most))).alias("depth"))
    return rows.select("host", "path", _key(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).alias("key"))


def _cuts(points: DataFrame, n_buckets: int) -> list[bytes]:
    keys = points.select(F.substring("key", 1, CUT_BYTES).alias("key")).orderBy(F.xxhash64("key"), "key").limit(CUTS * n_buckets).collect()
    ordered = sorted(bytes(r.key) for r in keys)
    return sorted(set(ordered[CUTS::CUTS]))


def _n_below(cuts: list[bytes], key: Column, *, equal: bool) -> Column:
    """How many cuts lie below a key, or at it too: a search by halves."""
    if not cuts:
        return F.lit(0)
    held, steps = F.array(*[F.lit(c) for c in cuts]), [1 << k for k in reversed(range(len(cuts).bit_length()))]

    def step(at: Column, n: Column) -> Column:
        cut = F.get(held, at + n - 1)
        return F.when(cut <= key if equal else cut < key, at + n).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def _sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, stack = None, []  # active rules, each inside the one before: (end, rule, verdict, host)
    for batch in batches:
        found = []
        for b, key, end, verdict, host, path in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if b != bucket:
                bucket, stack = b, []
            while stack and stack[-1][0] <= key:
                stack.pop()
            if end is not None:
                stack.append((end, host + path, verdict, host))
            elif stack:
                found.append((host, path, *stack[-1][1:]))
        columns = zip(*found) if found else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], schema=_FOUND_ARROW)


def fitting(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of those different urls (host, path) that a rule fits."""
    spark = urls.sparkSession
    rules = stage(rule_table(rules))
    depth = rules.agg(F.min("n_labels").alias("least"), F.max("n_labels").alias("most")).first()
    if depth.least is None:
        return spark.createDataFrame([], "host string, path string, rule string, verdict string")
    points = _points(urls, depth.least, depth.most)
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(points, n_buckets)
    none = F.lit(None)
    standing = points.select(_n_below(cuts, F.col("key"), equal=True).alias("bucket"), "key", none.cast("binary").alias("end"),
                             none.cast("string").alias("verdict"), "host", "path")
    met = F.sequence(_n_below(cuts, F.col("key"), equal=True), _n_below(cuts, F.col("end"), equal=False))
    held = rules.select(F.explode(met).alias("bucket"), "key", "end", "verdict", "host", "path")
    dealt = held.unionByName(standing).repartition(n_buckets, "bucket")
    swept = dealt.sortWithinPartitions("bucket", "key", F.col("end").isNull()).mapInArrow(_sweep, _FOUND)
    longest = F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("m"), "rule", "verdict")).alias("best")
    return swept.groupBy("host", "path").agg(longest).select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, the longest rule that fits (host and path in one string, NULL if none) and the verdict."""
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    kept = [c for c in pages.columns if c not in ADDED]
    rows = pages.select(host.alias("host"), path.alias("path"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    found = fitting(stage(rows.select("host", "path").distinct()), rules)
    judged = rows.join(found, ["host", "path"], "left")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", "rule",
                         F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (host, path, verdict) as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
