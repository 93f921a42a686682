"""Words, quality, near duplicates, repeats and decontamination against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.llm import decontaminate, near, quality, substrings
from seriesloom.llm.components import connected_components
from seriesloom.llm.jaccard import Bands
from seriesloom.llm.words import Words, shingle_sets

SCHEMA = "doc_id bigint, text string, extra string, node string, _key string"


def docs_of(spark, texts):
    """Rows of (id, text) with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def prose(rng, n, vocabulary=4000):
    return " ".join("w" + str(rng.randrange(vocabulary)) for _ in range(n))


def reach(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉß \t\n\x0b\x1c ", max_size=30), max_size=6))
def test_words_are_cut_as_stated(texts):
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    words = Words(np.frombuffer(data, dtype=np.uint8), offsets)
    assert words.count().tolist() == [len(words_of(t)) for t in texts]
    sets = list(shingle_sets(words, 3))
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(shingles(a, 3) & shingles(b, 3))
    lines = [x for t in texts for x in t.split("\n") if words_of(x)]
    assert np.diff(np.append(words.lines(), len(words.hash))).tolist() == [len(words_of(x)) for x in lines]


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_linked_sets_share_a_part_key(num, den):
    rng, bands = np.random.default_rng(1), Bands(num, den)
    heavy = rng.random(1 << 10) < 0.3
    for size in [*range(1, 60), 100, 333, 1000, 4000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            drop = rng.integers(0, len(a) * (den - num) // den + 1)
            b = np.sort(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, len(a) * (den - num) // den + 1 - drop + 1, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both):
                assert np.intersect1d(bands.keys(a), bands.keys(b)).size
                assert np.intersect1d(bands.keys(a, heavy), bands.keys(b, heavy)).size
                assert np.intersect1d(bands.keys(a, heavy | True), bands.keys(b, heavy | True)).size


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(600), rng.randrange(600)) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1400)]
    got = connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    want = reach(range(1500), links)
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert {r.node for r in got} == nodes
    named = {}
    for r in got:
        assert named.setdefault(r.component, want[r.node]) == want[r.node]
    assert len(set(named.values())) == len(named)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_texts():
    rng = random.Random(5)
    out = [(i, prose(rng, rng.choice([1, 2, 3, 8, 20, 21, 22, 60, 200]))) for i in range(60)]
    for i in range(60, 160):
        w = rng.choice(out)[1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = prose(rng, 1)
        out.append((i, " ".join(w) if rng.random() < 0.5 else " ".join(w).upper().replace(" ", "\n\t")))
    long = prose(rng, 30_000, 10**6)
    out += [(200, None), (201, ""), (202, " \n "), (203, out[0][1]), (203, out[0][1]), (None, out[3][1]), (204, long), (205, long + " tail")]
    return out


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80)])
def test_near_documents_equal_brute_force(spark, words, num):
    texts = near_texts()
    rows = near.near_documents(docs_of(spark, texts), words, num, 100).collect()
    sets = [shingles(t, words) for _, t in texts]
    links = [
        (i, j)
        for i in range(len(texts))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])
    ]
    group = reach(range(len(texts)), links)
    first = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            first[group[i]] = min(d, first.get(group[i], d))
    want = sorted((str(d), len(sets[i]), str(first.get(group[i]))) for i, (d, _) in enumerate(texts))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == want
    kept = near.keep_one(docs_of(spark, texts), words, num, 100)
    assert kept.columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    blank = sorted(str(d) for (d, _), s in zip(texts, sets) if not s)
    firsts = sorted(str(first[g]) for g in {group[i] for i in range(len(texts)) if sets[i]})
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(blank + firsts)


@pytest.mark.parametrize("bands", [1, 6])
def test_many_near_copies_over_several_tiles(spark, monkeypatch, bands):
    from seriesloom.llm import jaccard

    monkeypatch.setattr(jaccard, "TILE_BANDS", bands)
    monkeypatch.setattr(jaccard, "TILE_BYTES", 20_000)
    rng = random.Random(8)
    base = prose(rng, 120).split()
    texts = []
    for i in range(150):
        w = list(base) + [f"n{j}" for j in range(i % 30)]
        w[rng.randrange(len(w))] = f"u{i}"
        texts.append((i, " ".join(w)))
    sets = [shingles(t, 3) for _, t in texts]
    links = [(i, j) for i in range(150) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])]
    rows = near.near_documents(docs_of(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in rows} == reach(range(150), links)


def copies_of_six():
    rng = random.Random(9)
    base = [prose(rng, 40) for _ in range(6)]
    return [(i, base[i % 6]) for i in range(60)]


def test_copies_file_their_keys_once(spark):
    """A copy in the same task sends no keys anywhere, and copies are one node."""
    table = near.set_table(docs_of(spark, copies_of_six()).coalesce(1), 5, 80, 100).collect()
    assert len(table) == 60 and len({r.node for r in table}) == len({r.summary for r in table}) == 6
    assert sum(len(r["keys"]) > 0 for r in table) == 6


def test_keys_are_not_stored(spark, monkeypatch):
    """Keys take more room than the texts; they go to where they meet and are in no table of the shared folder."""
    docs, stored = docs_of(spark, copies_of_six()), []
    monkeypatch.setattr(near, "materialize", lambda df, store=near.materialize: stored.append(df.columns) or store(df))
    assert near.keep_one(docs).count() == 6
    assert stored and not any("keys" in columns for columns in stored)


def test_stored_tables_leave_no_shuffle_files(spark):
    """They go with their job, also while its frame is held, and the setting is as before."""
    import time

    from seriesloom.session import FILE_CLEANUP, materialize

    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))
    before, setting = names(), spark.conf.get(FILE_CLEANUP, None)
    dealt = spark.range(5000).repartition(3, "id")
    table, end = materialize(dealt), time.time() + 10
    while (left := names() - before) and time.time() < end:
        time.sleep(0.1)
    assert not left and spark.conf.get(FILE_CLEANUP, None) == setting
    assert table.count() == 5000


def test_equal_lines_file_their_keys_once(spark):
    docs = spark.createDataFrame([(i, i, t) for i, t in copies_of_six()], "doc_id bigint, node bigint, text string")
    lines = substrings.line_table(docs.coalesce(1)).collect()
    assert len(lines) == 60 and sum(len(r["keys"]) > 0 for r in lines) == 6
    assert {r.sequence for r in lines if r["keys"]} == {r.sequence for r in lines}


def test_stages_take_texts_in_small_batches(spark):
    import corpus_pipeline
    from seriesloom.llm.store import BATCH_BYTES

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    texts = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 50000) AS text")
    try:
        corpus_pipeline.one_of_each(spark, docs_of(spark, [(1, "a b c")]), "")
        assert max(r.n for r in texts.select("text").mapInArrow(sizes, "n bigint").collect()) <= 2 * BATCH_BYTES
    finally:
        spark.conf.set(name, before)


def test_near_documents_of_nothing(spark):
    empty = docs_of(spark, [])
    assert near.near_documents(empty).count() == 0 and near.keep_one(empty).count() == 0


def test_bands_are_tuned_for_recall():
    bands, rows = substrings.tune_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= substrings.RECALL and bands <= substrings.MAX_BANDS
    assert 1 - (1 - 0.8 ** (rows + 1)) ** substrings.MAX_BANDS < substrings.RECALL


def test_repeats_are_cut_and_clean_documents_stay(spark):
    rng = random.Random(11)
    texts = {i: "\n".join(prose(rng, rng.randrange(5, 120), 10**6) for _ in range(6)) for i in range(40)}
    clean = dict(texts)
    passages = [prose(rng, n, 10**6) for n in (51, 52, 60, 80, 150, 300)]
    holders = {k: [] for k in range(len(passages))}
    for k, passage in enumerate(passages):
        for d in rng.sample(range(30), 4):  # inside a line, anywhere
            w = texts[d].split(" ")
            at = rng.randrange(len(w))
            texts[d] = " ".join(w[:at] + [passage] + w[at:])
            holders[k].append(d)
    line = prose(rng, 90, 10**6).split()
    for d in (31, 32, 33):  # a line of its own, with a word changed
        w = list(line)
        w[d] = "changed"
        texts[d] += "\n" + " ".join(w)
    short = prose(rng, 13, 10**6)
    for d in (34, 35, 36, 37):
        texts[d] = clean[d] = short + "\n" + texts[d]
    whole = [*texts.items(), (100, None), (101, ""), (102, "one"), (103, texts[38]), (103, texts[38]), (None, texts[39])]
    rows = substrings.cut_repeats(docs_of(spark, whole))
    assert rows.columns == [*docs_of(spark, []).columns, "words_cut"]
    got = [(r.doc_id, r.text, r.words_cut) for r in rows.collect()]
    assert sorted(str(d) for d, _, _ in got) == sorted(str(d) for d, _ in whole)
    found = {d: (t, n) for d, t, n in got}
    for k, passage in enumerate(passages):
        held = sorted(holders[k])
        first, rest = held[0], held[1:]
        assert sum(passage.split()[len(passage.split()) // 2] in found[d][0].split() for d in held) == 1
        w = set(passage.split())
        for d in rest:
            assert len(w & set(found[d][0].split())) <= 0.3 * len(w)
        assert len(w & set(found[first][0].split())) >= 0.7 * len(w)
    middle = " ".join(line[50:60])
    assert [d for d in (31, 32, 33) if middle in found[d][0]] == [31]
    for d in set(range(40)) - {x for v in holders.values() for x in v} - {31, 32, 33, 38, 39}:
        assert found[d] == (clean[d], 0)
    for d in range(30):  # what was a document's own stays, but for a few words beside a cut
        own = clean[d].split()
        assert len(set(own) & set(found[d][0].split())) >= len(set(own)) - 25
    assert found[103] == ("", len(texts[38].split()))
    assert found[39][0] == "" and found[None] == (texts[39], 0)
    assert found[100] == (None, 0) and found[101] == ("", 0) and found[102] == ("one", 0)
    assert substrings.cut_repeats(docs_of(spark, [])).count() == 0


def test_passages_around_a_line_that_stands_in_earlier_documents(spark):
    rng = random.Random(21)
    own = lambda: prose(rng, 30, 10**6)
    texts, pairs = {}, []
    for p in range(120):
        line = prose(rng, 24, 10**6)
        texts[p] = f"{own()} {line} {own()}"
        passage = f"{prose(rng, 14, 10**6)} {line} {prose(rng, 14, 10**6)}"
        for d in (1000 + 2 * p, 1001 + 2 * p):
            texts[d] = f"{own()} {passage} {own()}"
        pairs.append((set(passage.split()), 1000 + 2 * p, 1001 + 2 * p))
    found = {r.doc_id: (r.text, r.words_cut) for r in substrings.cut_repeats(docs_of(spark, texts.items())).collect()}
    assert all(found[d] == (t, 0) for d, t in texts.items() if d < 1000 or d % 2 == 0)
    for passage, _, second in pairs:
        assert len(passage & set(found[second][0].split())) <= 0.3 * len(passage)


def test_passages_of_short_lines_that_are_nearly_equal(spark):
    rng = random.Random(22)
    texts = {d: "\n".join(prose(rng, 40, 10**6) for _ in range(3)) for d in range(40)}
    clean, passages = dict(texts), []
    for d in range(0, 40, 2):
        lines = [prose(rng, 20, 10**6).split() for _ in range(3)]
        passages.append((d, {w for x in lines for w in x[1:-1]}))
        texts[d] += "\n" + "\n".join(map(" ".join, lines))
        changed = [["new", *x[1:]] if k % 2 else [*x[:-1], "new"] for k, x in enumerate(lines)]
        texts[d + 1] += "\n" + "\n".join(map(" ".join, changed))
    found = {r.doc_id: (r.text, r.words_cut) for r in substrings.cut_repeats(docs_of(spark, texts.items())).collect()}
    for d, middle in passages:
        assert found[d] == (texts[d], 0) and found[d + 1] == (clean[d + 1], 60)


def test_test_items_are_found_like_by_brute_force(spark):
    rng = random.Random(13)
    items = [(k, prose(rng, rng.randrange(5, 70), 300) + ". " + prose(rng, 4, 300)) for k in range(30)]
    items += [(50, None), (51, ""), (52, "too short"), (None, prose(rng, 20, 300)), (7, items[7][1])]
    texts = []
    for i in range(80):
        w = prose(rng, rng.randrange(0, 400), 300).split()
        if i % 2:
            x = rng.choice(items[:30])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                x[rng.randrange(len(x))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = x
        texts.append((i, " ".join(w).upper() if i % 3 else "\n".join(w)))
    texts += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1]), (None, items[5][1])]
    docs, tests = docs_of(spark, texts), spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    got = sorted((str(r.doc_id), r.item_id) for r in decontaminate.contaminated(docs, tests).collect())
    want = []
    for d, t in texts:
        have = shingles(t, 5)
        for k, x in items[:30]:
            need = shingles(x, 5)
            if 10 * len(need & have) >= 8 * len(need):
                want.append((str(d), k))
    assert got == sorted(want) and len(got) > 20
    left = decontaminate.decontaminate(docs, tests)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in texts if str(d) not in {a for a, _ in want})
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs, nothing).count() == 0 and decontaminate.decontaminate(docs, nothing).count() == len(texts)
    assert decontaminate.contaminated(docs_of(spark, []), tests).count() == 0


def test_items_that_stand_in_parts_are_found(spark):
    rng = random.Random(14)
    items = [(k, prose(rng, 59, 10**6)) for k in range(8)]
    texts = []
    for k, (_, x) in enumerate(items):
        w = x.split()
        for gap in (20, 500):
            texts.append((len(texts), " ".join([prose(rng, 7 * k + 1), *w[:30], prose(rng, gap), *w[30:], prose(rng, 90)])))
    tests = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_found) for r in decontaminate.contaminated(docs_of(spark, texts), tests).collect()}
    assert got == {(d, d // 2, 51) for d in range(16)}
    assert decontaminate.decontaminate(docs_of(spark, texts), tests).count() == 0


def test_block_maxima_bound_every_score():
    rng = random.Random(2)
    index = decontaminate.build_index([(k, prose(rng, 40, 200)) for k in range(40)])
    for k, item in enumerate(index.items):
        held = index.block_max[int(index.blocks[k])]
        assert all(held[t] >= x for t, x in zip(item.terms.tolist(), item.impacts.tolist()))
        assert index.block_needed[index.blocks[k]] <= item.needed <= item.impacts.sum()


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    good = quality.reject(docs, labels)
    assert good.columns == docs.columns and 0.7 * docs.count() < good.count() < docs.count()


def test_quality_of_odd_tables(spark):
    texts = [(i, ("good words here " * 9) if i % 2 else "!!$$ " * 30) for i in range(200)]
    texts += [(None, "text"), (300, None), (301, ""), (302, "word " * 200_000), (5, "twice"), (5, "twice")]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (7, 0, 0), (8, None, 0), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows if r.doc_id is not None and r.doc_id < 200 and r.doc_id != 5)
    blind = quality.classify(docs, labels.limit(0)).collect()
    assert {r.score for r in blind} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.reject(docs.limit(0), labels).count() == 0
