"""URL filters, native: sort-merge range join of reversed-host keys against rule intervals.

``www.example.org`` has the key ``org.example.www.``; a rule's host covers itself and
its subdomains, which is the interval of keys that begin with its own key. These
intervals nest or are disjoint. A sweep over their sorted ends keeps a stack of the
rules that are active, and leaves one event per end that carries the stack. Pages and
events are merged in key order, and each page takes the stack of the last event before
it. Rules are a parameter; their events go to every
partition, ``MAX_RULES`` at a time (more take several passes), and pages are dealt by a hash of the whole url and id: a host that holds a third of all
rows is spread like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvspark.llm.base import ascii_lower, fresh

MAX_RULES = 100_000


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def key(self) -> str:
        return ".".join(reversed(self.host.split("."))) + "."


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    split = "://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, split, 1)), F.regexp_extract(url, split, 2)


def sweep(rules: list[UrlRule]) -> list[tuple[str, list[UrlRule]]]:
    """The ends of all rule intervals in key order, each with the rules that are active from there on."""
    after = lambda key: key[:-1] + "/"  # noqa: E731  the first key past those that begin with `key`
    order = sorted(set(rules), key=lambda r: (r.key.encode(), r.path.encode(), r.verdict))
    events: list[tuple[str, list[UrlRule]]] = [("", [])]
    stack: list[UrlRule] = []

    def put(key: str) -> None:
        if events[-1][0] == key:
            events.pop()
        events.append((key, list(stack)))

    for rule in order:
        while stack and not rule.key.startswith(stack[-1].key):
            closed = stack.pop()
            put(after(closed.key))
        stack.append(rule)
        put(rule.key)
    while stack:
        closed = stack.pop()
        put(after(closed.key))
    return events


def judge_urls(df: DataFrame, rules: list[UrlRule], url_col: str = "url", id_col: str = "page_id", default: str = "allow", partitions: int | None = None, max_rules: int = MAX_RULES) -> DataFrame:
    """Adds host, path, rule and verdict. The longest rule (host and path together, then the longer host) that fits decides.

    Rules beyond ``max_rules`` are swept in further passes over the pages; the result is the same.

    Without one, ``rule`` is null and ``verdict`` is ``default``. Null urls have an empty host and path;
    repeated rows are judged alike; existing columns with these four names are replaced.
    """
    spark = df.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    kept = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    host, path = parse_url(F.col(url_col))
    bucket, key, kind, active, best, row = fresh(df, "bucket", "key", "kind", "active", "best", "row")
    reversed_key = F.concat(F.array_join(F.reverse(F.split("host", r"\.", -1)), "."), F.lit("."))
    one = "struct<rank:bigint,path:string,rule:string,verdict:string>"
    pages = df.select(F.struct("*").alias(row), host.alias("host"), path.alias("path")).select(
        F.pmod(F.xxhash64(F.col(row)[id_col], F.col(row)[url_col]), F.lit(partitions)).cast("int").alias(bucket),
        reversed_key.alias(key), F.lit(1).alias(kind), "host", "path", row, F.lit(None).cast(one).alias(best),
    )
    rank = lambda r: (len(r.host) + len(r.path)) << 20 | len(r.host)
    so_far = Window.partitionBy(bucket).orderBy(key, kind).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(0, max(1, len(rules)), max_rules):
        events = sweep(rules[k : k + max_rules])
        ends = spark.createDataFrame([(at, [(rank(r), r.path, r.host + r.path, r.verdict) for r in stack]) for at, stack in events], f"{key} string, {active} array<{one}>")
        ends = ends.withColumn(bucket, F.explode(F.sequence(F.lit(0), F.lit(partitions - 1)))).withColumn(kind, F.lit(0))
        merged = pages.unionByName(ends, allowMissingColumns=True)
        swept = merged.withColumn(active, F.last(active, ignorenulls=True).over(so_far)).filter(F.col(kind) == 1)
        fits = F.array_max(F.filter(active, lambda r: F.startswith(F.col("path"), r["path"])))
        pages = swept.withColumn(best, F.array_max(F.array_compact(F.array(best, fits)))).drop(active)
    return pages.select(f"{row}.*", "host", "path", F.col(best)["rule"].alias("rule"), F.coalesce(F.col(best)["verdict"], F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]
