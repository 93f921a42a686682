"""Passages of a test set inside training documents: BM25 over an inverted index of the test items.

Every document is a query.  The score an item must reach is what is left of
its own score when as many of its best terms are missing as verification would forgive, so no
document that would be verified falls short.  A document is scored like block-max WAND does:
only items of which it holds enough essential terms are pivots; their block is skipped where
the sum of its terms' block maxima stays below the threshold; the others are scored in full.
Survivors are verified by the shingles they share with the item, anywhere in the document; the
shares of its question and its answer are only reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.words import Words, column_bytes, steps

K1, B = 1.2, 0.75
#: Words of a shingle, and the share of an item's shingles that a document must hold.
SHINGLE, OVERLAP = 5, 0.8
#: Distinct essential terms that a document must hold of an item beyond those it may lack.
PIVOT_TERMS = 4
#: Items of similar length that share block maxima.
BLOCK_ITEMS = 8
#: Test items are indexed in shards of at most about so many characters; each shard is broadcast.
SHARD_CHARS = 20_000_000


class Item(NamedTuple):
    item_id: int
    terms: np.ndarray  # sorted term numbers
    impacts: np.ndarray
    needed: float  # the BM25 score to reach
    pivots: int  # essential terms to hold
    shingles: np.ndarray
    question: np.ndarray
    answer: np.ndarray


class Index(NamedTuple):
    vocabulary: np.ndarray  # sorted word hashes
    present: np.ndarray  # bit table of their low bits
    items: list[Item]
    blocks: np.ndarray  # block of each item
    block_needed: np.ndarray
    block_max: dict[int, dict[int, float]]  # block -> term -> impact
    essential_at: np.ndarray  # term -> first posting
    essential: np.ndarray  # item of each posting


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence or line; an item of one sentence has none."""
    body = text.rstrip(".!?\n\t ")
    at = max(body.rfind(c) for c in ".!?\n") + 1
    return (text[:at], text[at:]) if at else (text, "")


def _grams(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    grams, valid = Words(data, np.array([0, len(data)])).grams(SHINGLE)
    return np.unique(grams[valid])


def build_index(rows: list[tuple[int, str]]) -> Index | None:
    """Index ``(item_id, text)``; texts with fewer words than a shingle identify nothing and are left out."""
    texts, words = [], []
    for item_id, text in sorted(rows):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        found = Words(data, np.array([0, len(data)])).hash
        if len(found) >= SHINGLE:
            texts.append((item_id, text, len(found)))
            words.append(found)
    if not texts:
        return None
    vocabulary, inverse = np.unique(np.concatenate(words), return_inverse=True)
    cuts = np.cumsum([0] + [len(w) for w in words])
    tfs = [np.unique(inverse[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]
    df = np.bincount(np.concatenate([t for t, _ in tfs]), minlength=len(vocabulary))
    idf = np.log(1 + (len(texts) - df + 0.5) / (df + 0.5))
    mean = cuts[-1] / len(texts)
    items = []
    for (item_id, text, n), (terms, tf) in zip(texts, tfs):
        impacts = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))
        shingles = _grams(text)
        # A missing term breaks a shingle of its own at least, so so many terms may be missing.
        lost = min(int((1 - OVERLAP) * len(shingles) + 1e-9), len(terms) - 1)
        best = np.sort(impacts)[::-1]
        question, answer = map(_grams, split_item(text))
        items.append(
            Item(item_id, terms, impacts, float(best[lost:].sum()) - 1e-9, min(PIVOT_TERMS, len(terms) - lost), shingles, question, answer)
        )
    lengths = np.array([n for _, _, n in texts])
    blocks = np.empty(len(items), dtype=np.int64)
    blocks[np.argsort(lengths, kind="stable")] = np.arange(len(items)) // BLOCK_ITEMS
    block_max: dict[int, dict[int, float]] = {}
    block_needed = np.full(blocks.max() + 1, np.inf)
    postings = []
    for k, item in enumerate(items):
        held = block_max.setdefault(int(blocks[k]), {})
        for t, x in zip(item.terms.tolist(), item.impacts.tolist()):
            held[t] = max(held.get(t, 0.0), x)
        block_needed[blocks[k]] = min(block_needed[blocks[k]], item.needed)
        lost = min(int((1 - OVERLAP) * len(item.shingles) + 1e-9), len(item.terms) - 1)
        best = item.terms[np.lexsort((item.terms, -item.impacts))][: lost + item.pivots]
        postings += [(int(t), k) for t in best]
    postings.sort()
    listed = np.array(postings, dtype=np.int64).reshape(-1, 2)
    present = np.zeros(1 << 18, dtype=bool)
    present[(vocabulary & np.uint64(len(present) - 1)).astype(np.int64)] = True
    at = np.searchsorted(listed[:, 0], np.arange(len(vocabulary) + 1))
    return Index(vocabulary, present, items, blocks, block_needed, block_max, at, listed[:, 1])


class Match(NamedTuple):
    row: int
    item: int
    start: int  # first word of the first shingle that the item shares
    score: float
    found: int  # shingles of the item in the document
    question: float
    answer: float


def matches(index: Index, words: Words) -> Iterator[Match]:
    """Test items that the rows of ``words`` hold, wherever in a row their shingles stand."""
    if not len(words.hash):
        return
    terms = np.full(len(words.hash), -1, dtype=np.int64)
    maybe = np.flatnonzero(index.present[(words.hash & np.uint64(len(index.present) - 1)).astype(np.int64)])
    at = np.searchsorted(index.vocabulary, words.hash[maybe])
    at[at == len(index.vocabulary)] = 0
    same = index.vocabulary[at] == words.hash[maybe]
    terms[maybe[same]] = at[same]
    hit = np.flatnonzero(terms >= 0)
    hit = hit[index.essential_at[terms[hit] + 1] > index.essential_at[terms[hit]]]
    if not len(hit):
        return
    n_terms, n_items = len(index.vocabulary), len(index.items)
    pairs = np.unique(words.row[hit].astype(np.int64) * n_terms + terms[hit])
    grams = words.grams(SHINGLE)[0]
    least = np.array([x.pivots for x in index.items])
    for row in np.unique(pairs // n_terms).tolist():
        low, high = np.searchsorted(pairs, [row * n_terms, (row + 1) * n_terms])
        term = pairs[low:high] % n_terms
        first, size = index.essential_at[term], index.essential_at[term + 1] - index.essential_at[term]
        posting = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pivots = np.flatnonzero(np.bincount(index.essential[posting], minlength=n_items) >= least)
        start, end = int(words.first[row]), int(words.first[row + 1])
        if not len(pivots) or end - start < SHINGLE:
            continue
        own = np.unique(terms[start:end])
        own = own[own >= 0]
        here, places = np.unique(grams[start : end - SHINGLE + 1], return_index=True)
        for block in np.unique(index.blocks[pivots]).tolist():
            maxima = index.block_max[block]
            if sum(maxima.get(t, 0.0) for t in own.tolist()) < index.block_needed[block]:
                continue
            for k in pivots[index.blocks[pivots] == block].tolist():
                item = index.items[k]
                score = float(item.impacts[np.isin(item.terms, own, assume_unique=True)].sum())
                if score < item.needed:
                    continue
                at = np.minimum(np.searchsorted(here, item.shingles), len(here) - 1)
                shared = here[at] == item.shingles
                if shared.sum() >= OVERLAP * len(item.shingles):
                    share = lambda part: float(np.isin(part, here).mean()) if len(part) else 1.0
                    yield Match(row, k, int(places[at[shared]].min()), score, int(shared.sum()), share(item.question), share(item.answer))


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of ``items(item_id, text)`` in shards of a bounded size; rows with a null id or text are left out."""
    items = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    chars = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    shards = 1 + chars // SHARD_CHARS
    for k in range(shards):
        shard = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        if index := build_index([(r.item_id, r.text) for r in shard.distinct().collect()]):
            yield index


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, start, score, n_found, n_shingles, question, answer`` of every test item a document holds.

    One row per row of ``docs(doc_id, text)`` and item: a document holds an item if it has at least ``OVERLAP`` of its distinct ``SHINGLE``-word
    shingles.  Null and empty texts hold nothing, repeated rows are reported each, no items mean
    no rows; other columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, start bigint, score double, n_found bigint, n_shingles bigint, question double, answer double"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = [rows.mapInArrow(_reporter(docs.sparkSession.sparkContext.broadcast(index)), schema) for index in indexes(items)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _reporter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        names = ["doc_id", "item_id", "start", "score", "n_found", "n_shingles", "question", "answer"]
        types = [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2 + [pa.float64()] * 2
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            ids = batch.column("doc_id")
            for a, b in steps(offsets):
                out = [
                    (ids[a + m.row].as_py(), index.items[m.item].item_id, m.start, m.score, m.found, len(index.items[m.item].shingles), m.question, m.answer)
                    for m in matches(index, Words(data, offsets[a : b + 1]))
                ]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return run


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; nothing is shuffled."""
    for index in indexes(items):
        docs = docs.mapInArrow(_filter(docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs


def _filter(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            keep = np.ones(batch.num_rows, dtype=bool)
            for a, b in steps(offsets):
                for m in matches(index, Words(data, offsets[a : b + 1])):
                    keep[a + m.row] = False
            yield batch.filter(pa.array(keep))

    return run
