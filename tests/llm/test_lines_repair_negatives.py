"""Line runs, conversation repair and hard negatives against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import lines, negatives, repair

BLANK = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


# Lines -------------------------------------------------------------------------------------


def brute_lines(rows, min_docs=3, min_chars=20):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    largest = {k: max(d, key=lambda x: (x is not None, x or 0)) for k, d in holders.items() if len(d) >= min_docs}
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        stay = [x for x in every if key(x) not in largest or largest[key(x)] == doc]
        out.append((doc, "\n".join(stay), len(every), len(every) - len(stay)))
    return out


def line_rows():
    rng = random.Random(3)
    pool = [f"  A line of {'words ' * 3}number {k}\t" for k in range(40)] + ["short", "", " ", "exactly twenty chars", "ünïcödé lines côunt pöints"]
    rows = [(d, "\n".join(rng.choices(pool, k=rng.randint(0, 12)))) for d in range(60)]
    rows += [(d, "This line stands in VERY many documents.\n" + str(d)) for d in range(100, 220)]
    rows += [(70, None), (71, ""), (72, "\n\n"), (73, "x" * 3_000_000 + "\n" + "\n".join(pool * 300))]
    rows += [(5, "another text of five\n" + pool[0]), (None, pool[1] + "\n" + pool[2]), (None, pool[1]), rows[0], rows[0], (219, "\nthis line stands in very many documents.\n\n")]
    rows += [(-3, pool[4].upper()), (-4, "a line of two documents\r"), (-5, "A LINE OF TWO DOCUMENTS")]
    return rows


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (5, 3)])
def test_lines_equal_brute_force(spark, batches, fanout):
    rows = line_rows()
    frame = spark.createDataFrame([(*r, 1, "b", 2, "x") for r in rows], "doc_id int, text string, n_lines int, mark string, batch int, lines string")
    got = lines.drop_lines(frame.repartition(5), batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute_lines(rows), key=order)


def test_lines_of_an_empty_table(spark):
    assert lines.drop_lines(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_levels_hold_fewer_runs_than_the_fanout(spark):
    runs = lines.LineRuns(2, 2)
    for b in range(5):
        batch = spark.createDataFrame([(100 - 10 * b - k, 1, 0, k, k) for k in range(6)], "doc_id bigint, mark bigint, pos int, h1 bigint, h2 bigint")
        fresh = runs.add(batch)
        assert fresh.count() == (6 if b else 0)  # keys of an earlier batch are candidates, fresh ones stay
        assert all(len(level) < 2 for level in runs.levels)
    whole = {r.h1: (r.docs, r.keeper, r.lines) for r in runs.merged(runs.runs()).collect()}
    assert whole == {k: (5, 100 - k, 5) for k in range(6)}
    plan = runs.merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs have the same buckets


# Repair ------------------------------------------------------------------------------------


def brute_repair(codes):
    """The least (cost, audit) of all edit sequences, one table entry per prefix and state, all of them kept."""
    best = {(0, 0): {"": 0}}
    for i in range(len(codes) + 1):
        for _ in range(3):
            for s in range(4):
                for audit, cost in list(best.get((i, s), {}).items()):
                    t = repair.STEP[s, repair.turn(s)]
                    if not audit.endswith("II"):
                        best.setdefault((i, t), {})[audit + "I"] = cost + 3
        if i < len(codes):
            initial, fault = divmod(repair.SYMBOLS.index(codes[i]), 3)
            for s in range(4):
                for audit, cost in best.get((i, s), {}).items():
                    best.setdefault((i + 1, s), {})[audit + "D"] = cost + 4
                    if fault < 2:
                        if (s, repair.INITIALS[initial]) in repair.STEP:
                            best.setdefault((i + 1, repair.STEP[s, repair.INITIALS[initial]]), {})[audit + "K"] = cost + 3 * fault
                        best.setdefault((i + 1, repair.STEP[s, repair.turn(s)]), {})[audit + "R"] = cost + 3 + 3 * fault
    return min((cost, audit) for s in (0, 3) for audit, cost in best.get((len(codes), s), {}).items())


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=repair.SYMBOLS, max_size=4))
def test_agenda_equals_all_edits(codes):
    found = repair.lightest(codes, goals=repair.ENDS)
    goal = next(s for s in found if s in repair.ENDS)
    assert found[goal] == brute_repair(codes)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=repair.SYMBOLS, max_size=40), st.integers(1, 7))
def test_chunks_compose_to_the_whole(codes, size):
    now = {0: (0, "")}
    for at in range(0, len(codes), size):
        now = repair.compose(now, repair.chunk_table(codes[at : at + size]))
    assert {s: v for s, v in now.items()} == {s: v for s, v in repair.lightest(codes).items() if codes} or not codes


def brute_conversation(rows):
    """``rows(turn, role, text)`` after damage, in order."""
    seen, faults, codes = set(), [0, 0, 0], ""
    for _, role, text in rows:
        kept = text.strip(BLANK)
        fault = 0
        if not kept:
            fault, faults[0] = 2, faults[0] + 1
        elif (role, text) in seen:
            fault, faults[1] = 2, faults[1] + 1
        elif kept[-1] not in ".!?":
            fault, faults[2] = 1, faults[2] + 1
        seen.add((role, text))
        codes += repair.SYMBOLS[("sua".find(role[:1]) if role[:1] else 3) % 4 * 3 + fault]
    initials = [r[1][:1] for r in rows]
    wrong = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    found = repair.lightest(codes)
    cost, audit = min(found[s] for s in repair.ENDS if s in found)
    out, state, at = [], 0, 0
    for edit in audit:
        role, text = ("", "") if edit == "I" else rows[at][1:]
        at += edit != "I"
        if edit != "D":
            initial = role[:1] if edit == "K" else repair.turn(state)
            out.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[initial]}:{text}")
            state = repair.STEP[state, initial]
    assert state in (0, 3) and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in out))
    return gaps, *faults, wrong, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def brute_damage(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        said = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        by[conv]  # noqa: B018  every conversation comes back
        role, text = said[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest())
    return {c: brute_conversation(sorted(r, key=order)) for c, r in by.items()}


def conversation_rows():
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Hello.", "Yes!", "no", " \n", "", None, "Why? ", "end.\x0b", "\x85"]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn * rng.choice([1, 1, 1, 2]) if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts) or f"Text {turn}."))
    rows += [(None, 3, "user", "Null id."), (None, None, "assistant", None), (500, None, None, None), rows[5], rows[5], rows[9]]
    rows += [(600, k, ["user", "assistant"][k % 2], f"Turn {k % 37}" + ".?"[k % 3 == 0] * (k % 5 > 0)) for k in range(700)]
    rows += [(601, 1, "user", "z" * 2_000_000 + "."), (601, 2, "assistant", "Same.")] + [(601, 3, "user", "Same.")] * 300
    return rows


def test_repair_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_BITS", 3)
    rows = conversation_rows()
    schema = "conv_id bigint, turn int, role string, text string, audit string, pos int, kind string"
    got = repair.damage_and_repair(spark.createDataFrame([(*r, "a", 1, "k") for r in rows], schema).repartition(7)).collect()
    assert got[0].__fields__ == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute_damage(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want


def test_conversations_that_lose_all_rows_and_none_at_all(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    gone = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.damage_and_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], schema)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert repair.damage_and_repair(spark.createDataFrame([], schema)).collect() == []


# Hard negatives ----------------------------------------------------------------------------


def brute_negatives(rows, is_anchor):
    usable = []
    for vec_id, label, x in rows:
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        usable.append((vec_id, label, [int(np.floor(256 * float(v))) for v in x]))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, label, x) in enumerate(usable):
        if anchor is None or not is_anchor(anchor):
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other) for k, (i, other, y) in enumerate(usable) if k != a and len(x) == len(y)]
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for ps, pid, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 30 * ps <= 100 * r[0] <= 90 * ps][:10]
            out += [(anchor, pid, k + 1, nid, ps, ns) for k, (ns, nid, _) in enumerate(fits)]
    return out


def vector_rows():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16))
    rows = [(i, int(i % 4), [float(np.float32(v)) for v in (centres[i % 12] + 0.6 * rng.standard_normal(16)) / 4]) for i in range(900)]
    rows += [(2000 + k, 1, rows[100][2]) for k in range(40)] + [(3000 + k, 2, rows[100][2]) for k in range(40)]  # copies, some of them anchors
    rows += [rows[200], rows[200], (None, 0, rows[201][2]), (None, 3, rows[201][2]), (300, 1, rows[7][2])]
    odd = [None, [], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [0.0] * 16, [1.0, -2.0], [2.0, 0.5], [3.0e30] * 3]
    rows += [(4000 + 50 * k, 0, v) for k, v in enumerate(odd)] + [(4001, 1, [1.0, 1.0]), (4002, 1, []), (4050, None, [1.0, 1.0])]
    return [r for r in rows if r[2] != [3.0e30] * 3] + [(9000, 0, [3.0e30] * 3)]


@pytest.mark.parametrize("cell, first", [(1024, 8192), (16, 40)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, cell, first):
    monkeypatch.setattr(negatives, "CELL_ROWS", cell)
    monkeypatch.setattr(negatives, "FIRST_ROWS", first)
    rows = vector_rows()
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, label int, embedding array<float>, key string, size int, kind int")
    got = negatives.hard_negatives(frame.repartition(6), F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    order = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute_negatives([r for r in rows if r[0] != 9000], lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_bounds_cover_scores_and_the_heap_falls():
    rng = np.random.default_rng(1)
    x = rng.integers(-80, 80, (600, 9))
    codes = tuple(negatives.fit(h, 5) for h in negatives.halves(x))
    own = [negatives.nearest(h, c) for h, c in zip(negatives.halves(x), codes)]
    far = [np.sqrt(((h - c[o]) ** 2).sum(1)) for h, c, o in zip(negatives.halves(x), codes, own)]
    cells = {}
    for k, cell in enumerate(zip(own[0].tolist(), own[1].tolist())):
        cells.setdefault(cell, []).append(k)
    radii = tuple(np.array([f[o == c].max(initial=0) for c in range(len(codes[k]))]) for k, (o, f) in enumerate(zip(own, far)))
    held = {c: (len(r), far[0][r].max(), far[1][r].max()) for c, r in cells.items()}
    book = negatives.Book(codes, radii, held)
    for anchor in x[:40]:
        seen = list(negatives.visit(book, anchor))
        assert [b for b, _ in seen] == sorted((b for b, _ in seen), reverse=True) and {c for _, c in seen} == set(cells)
        for bound, cell in seen:
            scores = x[cells[cell]] @ anchor
            assert scores.max() <= bound and scores.min() >= negatives.lowest(book, anchor, cell)


def test_hard_negatives_of_an_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], "vec_id bigint, label int, embedding array<float>"), F.col("vec_id") % 100 == 0).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    big = [float(1 << 17)] * 4
    rows = [(0, 0, big), (1, 0, [x - 1 / 256 for x in big]), (2, 1, [0.75 * x + 1 / 256 for x in big])]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    got = negatives.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == brute_negatives(rows, lambda i: i % 100 == 0)
