"""Lines that repeat across documents, found batch by batch in levelled sorted runs of line hashes.

A run is a table of line keys, bucketed and sorted by their 128-bit hash, with the documents that
hold a key, the largest id among them and its lines.  Batches come by falling document id.  A new
batch is reduced to a run of its own, which merge-joins the runs so far: keys that no run holds and
that one document of the batch alone has are fresh and keep their lines; the other lines, but for
those of a key's largest document, are candidates.  Then the batch's run is added, and as soon as a
level holds ``FANOUT`` runs they are merged into one of the next level.  All runs have the same
buckets, so neither joins nor merges of runs shuffle.  When all batches are in, candidates whose key
has reached the wanted number of documents go.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize, scratch_path, shuffle_width
from seriesloom.operators.skew import salted_join

#: Batches a table is cut into, and runs of a level that are merged into one of the next.
BATCHES, FANOUT = 4, 2
#: A key counts from so many code points on, and lines go from so many documents on.
MIN_CHARS, MIN_DOCS = 20, 3
#: Accuracy of the batch bounds, which only balance work.
BOUND_ACCURACY = 10_000

_BLANK = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text_mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


class LineRuns:
    """Levelled runs ``h1, h2, docs, keeper, lines`` of the line keys of all batches added so far."""

    def __init__(self, buckets: int, fanout: int = FANOUT):
        self.buckets, self.fanout = buckets, fanout
        self.levels: list[list[DataFrame]] = []

    def _stored(self, run: DataFrame) -> DataFrame:
        """The run as a bucketed, sorted table in the shared folder; the catalog forgets its name at once."""
        spark, name = run.sparkSession, f"line_run_{uuid.uuid4().hex}"
        writer = run.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", scratch_path(spark, "run"))
        writer.saveAsTable(name, format="parquet")
        table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")  # the files are external and stay
        return table

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """One run of several, by merge joins of their buckets."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select(*_KEY, F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper"), F.col("lines").alias("_lines"))
            total = lambda a, b: (F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))).alias(a)
            out = out.join(other, _KEY, "full").select(
                *_KEY, total("docs", "_docs"), F.greatest("keeper", "_keeper").alias("keeper"), total("lines", "_lines")
            )
        return out

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch ``doc_id, h1, h2, ...`` of lines; returns those of them that may have to go.

        No document may have lines in two batches, and no earlier batch a smaller document id.
        """
        each = lines.groupBy(*_KEY, "doc_id").agg(F.count(F.lit(1)).alias("lines"))
        own = each.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keeper"), F.sum("lines").alias("lines"))
        own = self._stored(own)
        met, seen, keepers = own, F.col("docs") > 1, [F.col("keeper")]
        for k, run in enumerate(self.runs()):
            met = met.join(run.select(*_KEY, F.col("docs").alias(f"_docs{k}"), F.col("keeper").alias(f"_keeper{k}")), _KEY, "left")
            seen = seen | F.col(f"_docs{k}").isNotNull()
            keepers.append(F.col(f"_keeper{k}"))
        keeper = F.greatest(*keepers) if len(keepers) > 1 else keepers[0]
        shared = materialize(met.filter(seen).select(*_KEY, keeper.alias("keeper"), "lines"))
        counts = shared.select(*_KEY, F.col("lines").alias("_n"))
        found = salted_join(lines, shared.drop("lines"), _KEY, key_counts=counts)
        candidates = materialize(found.filter(~F.col("doc_id").eqNullSafe(F.col("keeper"))).drop("keeper"))
        self._file(own, 0)
        return candidates

    def _file(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            whole = self._stored(self.merged(self.levels[level]))
            self.levels[level] = []
            self._file(whole, level + 1)


def _batched(docs: DataFrame, batches: int, min_chars: int) -> tuple[str, int]:
    """Lines ``doc_id, mark, pos, h1, h2`` of one scan of ``docs``, stored by batch: (path, batches)."""
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, BOUND_ACCURACY).alias("b")).first()["b"] if shares else []
    bounds = sorted({int(b) for b in bounds or []}, reverse=True)
    below = [(F.col("doc_id") < b).cast("int") for b in bounds]
    batch = F.coalesce(sum(below[1:], below[0]), F.lit(len(bounds))) if below else F.lit(0)
    lines = docs.select("doc_id", _text_mark().alias("mark"), batch.alias("batch"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.filter(F.length("line") >= min_chars).withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= min_chars)
    path = scratch_path(docs.sparkSession, "lines")
    hashed = keyed.select("doc_id", "mark", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "batch")
    hashed.write.partitionBy("batch").parquet(path)
    return path, len(bounds) + 1


def drop_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` per row of ``docs(doc_id, text)``, ``text`` without repeated lines.

    A line's key is the line without white space (space, tab, line feed, vertical tab, form feed,
    carriage return) at both ends and A-Z lower-cased.  Keys of ``min_chars`` code points or more
    that ``min_docs`` documents or more hold lose all their lines but those of the largest doc_id.
    Lines end at line feeds alone; null and empty texts are one empty line.  Rows of one doc_id are
    one document, rows without an id are one document smaller than all others; repeated rows are
    returned each, and lines that repeat within a document stay or go together.  ``n_lines`` counts
    before dropping; a text that loses all its lines is empty.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    path, made = _batched(docs, batches, min_chars)
    schema = "doc_id bigint, mark bigint, pos int, h1 bigint, h2 bigint, batch int"
    stored = spark.read.schema(schema).parquet(path)
    runs, held = LineRuns(shuffle_width(docs), fanout), None
    for k in range(made):
        some = runs.add(stored.filter(F.col("batch") == k).drop("batch"))
        held = some if held is None else held.unionByName(some)
    frequent = materialize(runs.merged(runs.runs()).filter(F.col("docs") >= min_docs).select(*_KEY, F.col("lines").alias("_n")))
    gone = salted_join(held, frequent.drop("_n"), _KEY, key_counts=frequent)
    gone = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).agg(F.collect_set("pos").alias("_gone"))
    # Lines are cut below the join, so that what is taken from them by place is cut once.
    cut = docs.select("doc_id", _text_mark().alias("mark"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    met = cut.join(gone, same, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    return met.select(
        "doc_id", text.alias("text"), F.size("lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
