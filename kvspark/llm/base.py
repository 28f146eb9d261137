"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the contracts: runs without ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else, whatever the locale."""
    return F.translate(text, _UPPER, _LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row and binds it inside ``body``.

    A column that a lambda mentions may be inlined into it and computed again
    for each element; a lambda's own variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name, k = f"__{stem}", 0
        while name.lower() in taken:
            k += 1
            name = f"__{stem}_{k}"
        taken.add(name.lower())
        names.append(name)
    return names


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share; one of our own only where it is unset, as in local tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="kvspark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def text_batches(spark: SparkSession) -> None:
    """Rows that go to workers are whole texts, so a batch is of 1,000 rows, not 10,000, which costs memory on both sides. A value that the session has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that is no longer needed, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows for which a partition of a checkpoint is worth its own files in the shuffles that follow.
ROWS = 20_000


def checkpoint(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder. Few rows in many partitions are read in fewer, of ``rows`` each."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    enough = max(1, -(-out.count() // rows))
    # one partition is named as such, also if it was one before: then what follows by key needs no shuffle
    return out.coalesce(enough) if enough == 1 or enough < out._jdf.rdd().getNumPartitions() else out


def regex_spans(text: Column, pattern: str, group: int = 0, only: Column | None = None) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,end,hit,part>>.

    ``start`` and ``end`` (exclusive) count code points, ``part`` is the text of ``group``.
    The gaps between matches come from a split by the same pattern, so a running sum
    of lengths gives the positions. Texts without a match pay for one search only, and
    texts for which ``only`` is false (a cheap test that any match must pass) for none.
    """
    kind = "array<struct<start:bigint,end:bigint,hit:string,part:string>>"
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), parts.alias("part"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        found = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["part"].alias("part"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("out"))
    found = F.aggregate(F.filter(zipped, lambda x: x["hit"].isNotNull()), zero, step, lambda s: s["out"])
    test = text.rlike(pattern) if only is None else only & text.rlike(pattern)
    return F.when(test, found).otherwise(F.array().cast(kind))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def has_any(text: Column, *parts: str) -> Column:
    """True if the text contains one of the parts: a byte search, much cheaper than a pattern."""
    test = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        test = test | F.contains(text, F.lit(part))
    return test


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")
