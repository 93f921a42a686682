"""Passages that repeat across documents, cut out of all documents but one.

Paragraphs are of two kinds.  Lines are compared by MinHash: bands tuned for recall at the
threshold, colliding lines verified by exact Jaccard, linked lines clustered by components.
Passages inside lines have no line breaks to go by, so documents are also cut at content-defined
places (the least hash of every run of ``WINDOW`` words), where a passage is cut alike wherever
it stands; such a segment has the single band of its whole word sequence, and what stands
before and after it is compared with all earlier occurrences through short hashes.  Runs of
repeated segments and repeated lines go if they have ``MIN_WORDS`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.jaccard import Filed, cluster_components, clusters
from seriesloom.llm.store import fresh, join_checked, materialize
from seriesloom.llm.words import Words, column_bytes, mix, steps

#: Words of a shingle; the similarity of repeated lines as a fraction of 100.
SHINGLE, SIMILARITY = 5, 80
#: The least words of a run of repeated lines and segments that is cut out.
MIN_WORDS = 30
#: A segment ends at the least hash of every so many words; shorter ones than this stand for nothing.
WINDOW, MIN_SEGMENT = 23, 4
#: Words before and after a segment whose hashes are compared; gaps between repeated segments that are closed.
CONTEXT, MAX_GAP = (3, 7, 13, 22), 8
#: The chance that two lines of the least similarity share a band, and the most bands.
RECALL, MAX_BANDS = 0.999, 10

_NODE = "xxhash64(doc_id, text)"


def tune_bands(similarity: float, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which at most ``most`` bands reach ``recall``."""
    for rows in range(16, 0, -1):
        for bands in range(1, most + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return most, 1


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def band_keys(grams: np.ndarray, starts: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys, one row of ``bands`` a set: MinHash of ``grams[start : start + size]``; sizes are positive."""
    flat = grams[_ranges(starts, sizes)]
    cuts = np.cumsum(sizes) - sizes
    out = np.zeros((len(starts), bands), dtype=np.uint64)
    for k in range(bands * rows):
        x = (flat ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xCF1BBCDCB7A56463)
        out[:, k // rows] = mix(out[:, k // rows] * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(x, cuts) + np.uint64(k))
    return out


def line_table(docs: DataFrame) -> DataFrame:
    """Lines of ``docs(doc_id, node, text)`` with at least ``SHINGLE`` words, stored: ``doc, node, start, words, sequence, keys``.

    Equal lines have the same ``sequence`` and equal keys, so a task files the keys with the first one.
    """
    bands, rows = tune_bands(SIMILARITY / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filed = Filed()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id")
            for a, b in steps(offsets):
                words = Words(data, offsets[a : b + 1])
                first = words.lines()
                size = np.diff(np.append(first, len(words.hash)))
                first, size = first[size >= SHINGLE], size[size >= SHINGLE]
                if not len(first):
                    continue
                sequence = words.sequences(first, first + size).view(np.int64)
                new = np.array([filed.first(x) for x in sequence.tolist()])
                keys = np.zeros(0, np.int64)
                if new.any():
                    keys = band_keys(words.grams(SHINGLE)[0], first[new], size[new] - SHINGLE + 1, bands, rows).view(np.int64)
                row = words.row[first]
                columns = [nodes[a + row], first - words.first[row], size, sequence]
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new * bands)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(a + row)), *[pa.array(c, pa.int64()) for c in columns], listed],
                    ["doc", "node", "start", "words", "sequence", "keys"],
                )

    return materialize(docs.mapInArrow(run, "doc bigint, node bigint, start bigint, words bigint, sequence bigint, keys array<bigint>"))


def _line_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shingles of the lines ``wanted(cluster, unit, node, start, words)``."""
    lines = materialize(wanted.groupBy("node").agg(F.collect_list(F.struct("cluster", "unit", "start", "words")).alias("lines")))
    met = join_checked(docs, lines, "node").select("text", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in steps(offsets):
                words, out = Words(data, offsets[a : b + 1]), []
                grams, _ = words.grams(SHINGLE)
                for k, lines in enumerate(batch.column("lines").slice(a, b - a).to_pylist()):
                    for x in lines:
                        at = words.first[k] + x["start"]
                        found = np.unique(grams[at : at + x["words"] - SHINGLE + 1])
                        out.append((x["cluster"], x["unit"], len(found), found.tobytes()))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["cluster", "node", "n", "shingles"])

    sets = met.mapInArrow(run, "cluster bigint, node bigint, n bigint, shingles binary")
    return sets.dropDuplicates(["node"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """``node, start, words, keeper`` of lines that stand, nearly equal, in the document ``keeper``."""
    lines = line_table(docs)
    place, owner = F.struct("doc", "node", "start"), F.struct("doc", "node")
    classes = materialize(
        lines.groupBy("sequence", "words").agg(
            F.min(place).alias("low"), F.max(owner).alias("high")
        )
    )
    # A line's word sequence is its name among the classes too, so keys go from their table straight to where they meet.
    cluster = clusters(lines.filter(F.size("keys") > 0).select(F.col("sequence").alias("node"), "keys")).withColumnRenamed("node", "sequence")
    wanted = classes.join(cluster, "sequence").select("cluster", F.col("sequence").alias("unit"), "low.node", "low.start", "words")
    found = cluster_components(_line_sets(docs, wanted), SIMILARITY, 100).withColumnRenamed("node", "sequence")
    named = classes.join(found, "sequence", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "sequence")))
    spread = named.groupBy("component").agg(F.min("low").alias("keep"), F.max("high").alias("_high")).filter("keep.node <> _high.node")
    gone = named.join(spread, "component").select("sequence", "words", F.col("keep.node").alias("keeper"))
    return (
        join_checked(lines.drop("keys"), materialize(gone), ["sequence", "words"])
        .filter("node <> keeper")
        .select("node", "start", "words", "keeper")
    )


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least value of every ``width`` neighbours; the later one of equals."""
    if len(x) < width:
        return np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(x[::-1], width)
    return np.unique(len(x) - 1 - (np.arange(len(view)) + view.argmin(axis=1)))


def _context(words: Words, at: np.ndarray, row: np.ndarray, side: int) -> np.ndarray:
    """Four 16-bit hashes of the words before (side -1) or after (1) each place of a row, packed.

    The row's ends cut the context short; a hash is 0 where no word is left.
    """
    out = np.zeros(len(at), dtype=np.uint64)
    for k, n in enumerate(CONTEXT):
        a = np.maximum(at - n, words.first[row]) if side < 0 else at
        b = at if side < 0 else np.minimum(at + n, words.first[row + 1])
        found = np.maximum(words.sequences(a, b) >> np.uint64(48), np.uint64(1))
        out |= np.where(b > a, found, np.uint64(0)) << np.uint64(16 * k)
    return out


def segment_rows(docs: DataFrame) -> DataFrame:
    """Content-defined segments of ``docs(doc_id, node, text)``: ``sequence, doc, node, start, size, before, after``.

    ``size`` is 64 times the words of the segment and the words of the document after it, 63 at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            docs = batch.column("doc_id")
            for a, b in steps(offsets):
                words = Words(data, offsets[a : b + 1])
                if len(words.hash) < 2:
                    continue
                cuts = _least(words.grams(2)[0], WINDOW)
                start, end = cuts[:-1], cuts[1:]
                kept = (end - start >= MIN_SEGMENT) & (words.row[start] == words.row[end])
                start, end = start[kept], end[kept]
                if not len(start):
                    continue
                row = words.row[start]
                size = (end - start) * 64 + np.minimum(words.first[row + 1] - end, 63)
                columns = [words.sequences(start, end).view(np.int64), nodes[a + row], start - words.first[row], size]
                columns += [_context(words, start, row, -1).view(np.int64), _context(words, end, row, 1).view(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [docs.take(pa.array(a + row)), *[pa.array(c, pa.int64()) for c in columns]],
                    ["doc", "sequence", "node", "start", "size", "before", "after"],
                )

    return docs.mapInArrow(run, "doc bigint, sequence bigint, node bigint, start bigint, size bigint, before bigint, after bigint")


def _key(sequence, side, context, level: int) -> F.Column:
    """A key of segments of equal words that agree in ``context`` up to the length ``CONTEXT[level]``; null where no word is left."""
    bits = F.lit((1 << 16 * (level + 1)) - 1 if level + 1 < len(CONTEXT) else -1).cast("bigint")
    there = F.shiftrightunsigned(context, 16 * level).bitwiseAND(F.lit(0xFFFF)) != 0
    return F.when(there, F.xxhash64(sequence, side, F.lit(level), F.col(context).bitwiseAND(bits)))


def _sides(rows: DataFrame, *names: str) -> DataFrame:
    """``names`` and ``sequence, side, context`` of segments: side 1 with the words before, side 2 with those after."""
    both = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("context")) for side, c in ((1, "before"), (2, "after"))])
    return rows.select(*names, "sequence", F.inline(both))


def _at_levels(sides: DataFrame, levels: range, *names: str) -> DataFrame:
    """``names`` and ``side, agree, key`` for every compared length of ``levels`` that a side has words for."""
    keys = F.array(*[F.struct(F.lit(CONTEXT[k]).alias("agree"), _key("sequence", "side", "context", k).alias("key")) for k in levels])
    return sides.select(*names, "side", F.inline(keys)).filter("key IS NOT NULL")


def _first_of(held: DataFrame, levels: range) -> DataFrame:
    """``key, first``, stored: the document that has the segments of a key first, where more than one segment has it."""
    place = ("doc", "node", "start")
    keyed = _at_levels(_sides(held, *place), levels, *place)
    firsts = keyed.groupBy("key").agg(F.min(F.struct(*place)).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    # Stored, so that the join reads both sides from shuffles of their own and a key with very many rows is split.
    return materialize(firsts.select("key", F.col("first.node").alias("first")))


def repeated_segments(docs: DataFrame) -> DataFrame:
    """``node, start, words, before, after, keeper``: segments that stand in another document first, with the words around that agree.

    Every document that has the segment counts: on each side, the words are the longest compared
    length up to which any earlier document agrees, not only the first one that has the segment.
    A segment of the first document of all is the first at every length, so it is not looked up;
    nor are shorter lengths where the longest one agrees.  Segments are found twice, which is
    cheaper than to store those that stand in one document only.
    """
    rows = segment_rows(docs)
    places = rows.groupBy("sequence").agg(F.min(F.struct("doc", "node", "start")).alias("first"), F.min("node").alias("low"), F.max("node").alias("high"))
    shared = materialize(places.filter("low <> high").select("sequence", F.col("first.node").alias("keeper")))
    held = materialize(join_checked(rows, shared, "sequence"))
    later = held.filter("node <> keeper")
    last = len(CONTEXT) - 1

    sides = _sides(later, "node", "start").withColumn("key", _key("sequence", "side", "context", last))
    # A side without so many words has a key of its own, so that those rows do not meet in one task.
    alone = F.coalesce("key", F.xxhash64("node", "start", "side"))
    longest = join_checked(sides.withColumn("key", alone), _first_of(held, range(last, last + 1)), "key", "left")
    agrees = F.coalesce(F.col("first") != F.col("node"), F.lit(False))
    longest = materialize(
        longest.select(
            "node", "start", "side", F.when(agrees, F.col("first")).alias("keeper"),
            F.when(~agrees, F.col("sequence")).alias("sequence"), F.when(~agrees, F.col("context")).alias("context"),
        )
    )
    rest = _at_levels(longest.filter("keeper IS NULL"), range(last), "node", "start")
    shorter = join_checked(rest, _first_of(held, range(last)), "key").filter("node <> first")

    none = F.lit(0).cast("bigint")
    found = (
        later.select("node", "start", "size", F.lit(0).alias("side"), F.lit(0).alias("agree"), "keeper")
        .unionByName(longest.filter("keeper IS NOT NULL").select("node", "start", none.alias("size"), "side", F.lit(CONTEXT[last]).alias("agree"), "keeper"))
        .unionByName(shorter.select("node", "start", none.alias("size"), "side", "agree", F.col("first").alias("keeper")))
    )
    best = lambda side: F.max(F.when(F.col("side") == side, F.struct("agree", "keeper")))
    found = found.groupBy("node", "start").agg(F.max("size").alias("size"), best(0).alias("alone"), best(1).alias("b"), best(2).alias("a"))
    agreed = lambda side: F.coalesce(F.col(f"{side}.agree"), F.lit(0)).cast("bigint")
    return found.select(
        "node",
        "start",
        F.shiftright("size", 6).alias("words"),
        F.least(agreed("b"), "start").alias("before"),
        F.least(agreed("a"), F.col("size").bitwiseAND(F.lit(63).cast("bigint"))).alias("after"),
        F.greatest("alone", "b", "a")["keeper"].alias("keeper"),
    )


def runs(parts: list[tuple[int, int, int, int, int]], least: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Word ranges to cut out, from ``(start, words, before, after, keeper)`` of a document's repeated parts."""
    spans = sorted((max(s - b, 0), s + n + a, k) for s, n, b, a, k in parts)
    out: list[list[int]] = []
    for start, end, keeper in spans:
        if out and (start <= out[-1][1] or (start - out[-1][1] <= MAX_GAP and keeper == out[-1][2])):
            if end > out[-1][1]:
                out[-1][1:] = [end, keeper]
        else:
            out.append([start, end, keeper])
    return [(a, b) for a, b, _ in out if b - a >= least]


def _ranges_of(parts: DataFrame) -> DataFrame:
    """``node, ranges`` to cut out of documents of which anything is, from their repeated parts."""
    zero = F.lit(0).cast("bigint")
    grouped = parts.groupBy("node").agg(F.collect_list(F.struct("start", "words", "before", "after", "keeper")).alias("parts"))
    enough = F.aggregate("parts", zero, lambda n, x: n + x["words"] + x["before"] + x["after"]) >= MIN_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            nodes, out = [], []
            for node, found in zip(batch.column("node").to_pylist(), batch.column("parts")):
                ranges = runs([(x["start"], x["words"], x["before"], x["after"], x["keeper"]) for x in found.as_py()])
                if ranges:
                    nodes.append(node)
                    out.append([{"a": a, "b": b} for a, b in ranges])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, kind)], ["node", "ranges"])

    return grouped.filter(enough).mapInArrow(run, "node bigint, ranges array<struct<a:bigint,b:bigint>>")


def cut_out(text: bytes, starts: np.ndarray, ends: np.ndarray, ranges: list[tuple[int, int]]) -> tuple[bytes, int]:
    """(text without the words of ``ranges``, words cut); the space around a cut becomes one line feed or space."""
    out, at, cut = b"", 0, 0
    for a, b in ranges:
        b = min(b, len(starts))
        left, right = text[at : starts[a]], text[ends[b - 1] : (starts[b] if b < len(starts) else len(text))]
        bare = left.rstrip(b" \t\n\v\f\r")
        gap = left[len(bare) :] + right
        out += bare
        if out and b < len(starts):
            out += b"\n" if b"\n" in gap else b" "
        at = starts[b] if b < len(starts) else len(text)
        cut += b - a
    return out + text[at:], cut


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with all columns, their texts without repeats, and ``words_cut``.

    Of passages that repeat across documents one stays, in the document of the smallest
    doc_id.  Repeats within one document stay.  Rows with the same id and text are one
    document and are cut alike; null, empty and short texts are as they were, and so are all texts
    of which nothing is cut.  Columns of other names are passed on; ``words_cut`` is replaced.
    """
    docs = docs.drop("words_cut")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.expr(_NODE).alias("node"), "text").filter("text IS NOT NULL")
    zero = F.lit(0).cast("bigint")
    lines = repeated_lines(texts).select("node", "start", "words", zero.alias("before"), zero.alias("after"), "keeper")
    parts = lines.unionByName(repeated_segments(texts))
    key, node, held = fresh(docs, "_key", "_node", "_ranges")
    ranges = materialize(_ranges_of(parts).toDF(node, held))
    met = join_checked(docs.withColumn(key, F.expr(_NODE)), ranges, F.col(key) == F.col(node), "left")
    names = docs.columns
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.dtypes] + ["words_cut bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, cuts = batch.column("text"), np.zeros(batch.num_rows, dtype=np.int64)
            changed = {}
            ranges = batch.column(held)
            for i in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)).tolist():
                text = texts[i].as_py().encode()
                words = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
                left, cuts[i] = cut_out(text, words.start, words.end, [(x["a"], x["b"]) for x in ranges[i].as_py()])
                changed[i] = left.decode()
            if changed:
                texts = pa.array([changed[i] if i in changed else t for i, t in enumerate(texts.to_pylist())], texts.type)
            columns = [texts if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts)], [*names, "words_cut"])

    return met.select(*names, held).mapInArrow(run, schema)
