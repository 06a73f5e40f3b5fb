"""URL filters: a sorted sweep over reversed-host keys with a stack of nested rule intervals."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged, table

#: Contract rules: (host, path prefix, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

_ASCII_UPPER, _ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where `://` is missing."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + F.lit(3), F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _ASCII_UPPER, _ASCII_LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


OUT = "page_id long, host string, path string, rule string, verdict string"


#: Ends each label of a key; within labels MARK stands for itself followed by "\x03", END for MARK twice.
END, MARK = "\x01", "\x02"


def reversed_key(host: str) -> str:
    """The labels of a host, the last first, each with END after it; a host's key begins with that of each of its parents and
    with no other's, whatever characters its labels hold."""
    plain = host.replace(MARK, MARK + "\x03").replace(END, MARK + MARK)
    return "".join(x + END for x in reversed(plain.split("."))) if host else ""


def _sweep(rules: list[tuple[str, str, str]], default: str):
    """Task: rows arrive sorted by key; rules whose host interval holds the key form the stack."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(reversed_key(host), []).append((path, host + path, verdict))
    starts = sorted(by_host)
    for paths in by_host.values():
        paths.sort(key=lambda x: (-len(x[0]), x[0]))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches):
        stack: list[str] = []
        at, last = None, None
        for b in batches:
            cols = b.to_pydict()
            rule, verdict = [], []
            for key, path in zip(cols["host_key"], cols["path"], strict=True):
                if key != last:
                    if at is None:  # enclosing rules that start before this task's first key
                        at = bisect.bisect_right(starts, key)
                        stack = [s for s in (key[: i + 1] for i, c in enumerate(key) if c == END) if s in by_host]
                    else:
                        while stack and not key.startswith(stack[-1]):
                            stack.pop()
                        while at < len(starts) and starts[at] <= key:
                            if key.startswith(starts[at]):
                                stack.append(starts[at])
                            at += 1
                    last = key
                hit = next((r for s in reversed(stack) for r in by_host[s] if path.startswith(r[0])), None)
                rule.append(hit and hit[1])
                verdict.append(hit[2] if hit else default)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    return run


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """Judge each row's url by the most specific fitting rule.

    A rule (host, path, verdict) fits its host and all subdomains if the url's path starts
    with the rule's; the longest host wins, then the longest path; of rules equal in both the
    greater verdict (block over allow).  A rule's host is the interval of reversed-host keys
    that begin with it, so nested rules are nested intervals.  Rows are range-sorted by (key,
    path, page_id): equal keys may be split over tasks, so a hot host or url does not meet in
    one task.  Each task sweeps its sorted rows once, popping rules that ended and pushing
    rules that begin.  A list of rules goes to all tasks, which find those that began earlier
    from the prefixes of their first key; a table of rules, of any size, is sorted in among the
    rows (see _merged).  Rules without a host fit nothing.

    Null or malformed urls have empty host and path and get the default; repeated rows and null
    page_ids are judged alike; an empty table gives no rows; other columns of pages are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(pages["url"])
    parts = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    if isinstance(rules, DataFrame):
        return _merged(parts, rules, default, n)
    best: dict[tuple[str, str], str] = {}
    for h, p, v in rules:
        if h:
            best[h, p] = max(v, best.get((h, p), v))
    ordered = parts.withColumn("host_key", host_key()).repartitionByRange(n, "host_key", "path", "page_id").sortWithinPartitions("host_key", "path", "page_id")
    return ordered.mapInArrow(_sweep([(h, p, v) for (h, p), v in best.items()], default), OUT)


def host_key() -> Column:
    """reversed_key of column host."""
    plain = F.replace(F.replace("host", F.lit(MARK), F.lit(MARK + "\x03")), F.lit(END), F.lit(MARK + MARK))
    return F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), END), F.lit(END)))


def _merged(parts: DataFrame, rules: DataFrame, default: str, n: int) -> DataFrame:
    """Sort-merge of rows and a table of rules: both are range-sorted together by key, rules before the rows of their key, and
    each range is swept.  Rules that began in an earlier range are those whose key is a prefix of the range's first key: one
    key a range, its prefixes joined with the rules, so no list of rules is gathered anywhere.  Only the rules of the
    enclosing hosts of one key are held at a time."""
    r = rules.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.select(F.lit(None).cast("long").alias("page_id"), "host", "path", "verdict", F.lit(0).alias("kind")).withColumn("host_key", host_key())
    rows = parts.withColumn("verdict", F.lit(None).cast("string")).withColumn("kind", F.lit(1)).withColumn("host_key", host_key())
    order = ["host_key", "kind", "path", "page_id"]
    dealt = staged(r.unionByName(rows).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "url-ranges")
    labels = F.split("first", END)
    first = dealt.groupBy("part").agg(F.min("host_key").alias("first")).where("first <> ''")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), END), F.lit(END))))
    open_rules = first.select("part", prefix.alias("host_key")).join(dealt.where("kind = 0").drop("part"), "host_key").withColumn("kind", F.lit(-1))
    swept = dealt.unionByName(open_rules).repartitionById(n, "part").sortWithinPartitions("part", F.col("kind") >= 0, *order)

    def run(batches):
        part, stack = None, []
        for b in batches:
            keep, rule, verdict = [], [], []
            cols = [b.column(c).to_pylist() for c in ("part", "host_key", "kind", "host", "path", "verdict")]
            for i, (at, key, kind, host, path, v) in enumerate(zip(*cols, strict=True)):
                if at != part:
                    part, stack = at, []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind < 1:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, []))
                    stack[-1][1][path] = (host + path, v)
                    if len(path) not in stack[-1][2]:
                        bisect.insort(stack[-1][2], len(path))
                    continue
                hit = next((paths[path[:k]] for _, paths, sizes in reversed(stack) for k in reversed(sizes) if path[:k] in paths), (None, default))
                keep.append(i)
                rule.append(hit[0])
                verdict.append(hit[1])
            found = pa.RecordBatch.from_arrays([b.column(c) for c in ("page_id", "host", "path")], names=["page_id", "host", "path"]).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return swept.mapInArrow(run, OUT)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


OP9_SQL = """
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM a),
r AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) AS t(rh, rp, rv)),
m AS (SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
      FROM b JOIN r ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp))
SELECT b.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM b LEFT JOIN m ON b.page_id = m.page_id AND m.k = 1
"""
