"""Conversations brought into the order system, user, assistant, user, ... by the cheapest edits.

Repair is a weighted deduction system.  Item ``(i, state)`` says that the first ``i`` rows are
edited into a prefix that leaves the grammar in ``state``; rules keep, rerole or delete the next
row or insert a turn, and every item is worth the least (cost, audit) of its derivations, audit
being the edits' initials.  The rules are superior functions: a conclusion is never worth less than
its premise, and of two values of one item, none's audit continues the other's at the same cost, so
that order is kept.  Knuth's agenda therefore finalises items in the order they are popped.

Long conversations are cut into chunks of ``CHUNK`` rows.  A chunk's agenda gives the lightest
derivation from every state to every state; these tables compose, so a chunk is one task's work
however long its conversation is.  Only the last step, the SHA-256 of a whole repaired
conversation, has to pass its rows in order through one hasher, as a stream.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import materialize, shuffle_width
from seriesloom.operators.skew import null_safe

#: Rows of a chunk: two to this power.
CHUNK_BITS = 9
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant; a conversation may end in the first and last.
STATES, ENDS = range(4), (0, 3)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
INITIALS = "suax"
#: A row's symbol tells its initial and whether it is sound, truncated or has to go.
SYMBOLS = "abcdefghijkl"
_ROLE = {"u": "user", "a": "assistant"}
_SPACE = r"\x20\x09-\x0D"
_LETTER = f"[^{_SPACE}]"

Value = tuple[int, str]


def turn(state: int) -> str:
    """The initial of a turn that may be inserted or reroled in ``state``."""
    return "a" if state == 2 else "u"


def conclusions(codes: str, at: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """Rules with the premise ``(at, state)``: (cost, edit, next at, next state)."""
    yield INSERT, "I", at, STEP[state, turn(state)]
    if at < len(codes):
        initial, fault = divmod(SYMBOLS.index(codes[at]), 3)
        yield DELETE, "D", at + 1, state
        if fault < 2:
            more = TRUNCATED * fault
            if (state, INITIALS[initial]) in STEP:
                yield KEEP + more, "K", at + 1, STEP[state, INITIALS[initial]]
            yield REROLE + more, "R", at + 1, STEP[state, turn(state)]


def lightest(codes: str, start: int = 0, goals: tuple[int, ...] | None = None) -> dict[int, Value]:
    """The lightest derivation of ``(len(codes), state)`` from ``(0, start)`` for every state, or until one of ``goals`` is final."""
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    final: set[tuple[int, int]] = set()
    found: dict[int, Value] = {}
    while agenda:
        cost, audit, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(codes):
            found[state] = cost, audit
            if goals and state in goals or len(found) == len(STATES):
                break
        for more, edit, to, then in conclusions(codes, at, state):
            if (to, then) not in final:
                heapq.heappush(agenda, (cost + more, audit + edit, to, then))
    return found


@functools.lru_cache(maxsize=1 << 13)
def chunk_table(codes: str) -> tuple[tuple[int, int, int, str], ...]:
    """``(from, to, cost, audit)`` of a chunk."""
    return tuple((s, t, *value) for s in STATES for t, value in lightest(codes, s).items())


def compose(now: dict[int, Value], table: list[tuple[int, int, int, str]]) -> dict[int, Value]:
    """The lightest derivations after one chunk more."""
    out: dict[int, Value] = {}
    for s, t, cost, audit in table:
        if s in now:
            value = now[s][0] + cost, now[s][1] + audit
            if t not in out or value < out[t]:
                out[t] = value
    return out


def illegal(initials: str) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text)`` with the damage that the crc32 of ``conv_id:turn`` deals; nulls are one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(said("role"))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind")).filter("_kind <> 0")
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _key() -> Column:
    return F.unhex(F.md5("text"))


def flagged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, pos, initial, blank, cut, again`` of rows after damage, stored; ``pos`` rises with the order of a conversation."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    narrow = rows.select(
        "conv_id", "turn", "role", _key().alias("key"), (~F.col("text").rlike(_LETTER)).alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"), F.monotonically_increasing_id().alias("row"),
    )
    # The last column only parts equal rows, so that very many of them spread.
    order = ["conv_id", "turn", "role", "key", "row"]
    ranged = narrow.repartitionByRange(shuffle_width(rows), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.drop("row").withColumn("pos", F.monotonically_increasing_id()))
    firsts = placed.filter("NOT blank").groupBy("conv_id", "role", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    met = placed.join(firsts, "pos", "left")
    return materialize(
        met.select(
            "conv_id", "turn", "pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), "blank",
            (~F.col("blank") & F.col("cut") & F.col("first").isNotNull()).alias("cut"), (~F.col("blank") & F.col("first").isNull()).alias("again"),
        )
    )


def _tables(rows: DataFrame, conv: str) -> DataFrame:
    """``conv_id, chunk, codes, states, nexts, costs, audits`` of chunks of ``flagged`` rows."""
    fault = F.when(F.col("blank") | F.col("again"), 2).when(F.col("cut"), 1).otherwise(0)
    symbol = F.substring(F.lit(SYMBOLS), (F.instr(F.lit(INITIALS), F.col("initial")) - 1) * 3 + fault + 1, F.lit(1))
    coded = rows.select("conv_id", "pos", F.shiftright("pos", CHUNK_BITS).alias("chunk"), symbol.alias("symbol"))
    listed = coded.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "symbol"))).alias("l"))
    chunks = listed.select("conv_id", "chunk", F.array_join(F.col("l.symbol"), "").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "chunk", "codes", "states", "nexts", "costs", "audits"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [list(zip(*chunk_table(c))) for c in part.column("codes").to_pylist()]
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
                made = [pa.array([f[k] for f in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), *made], names)

    return chunks.mapInArrow(run, f"conv_id {conv}, chunk bigint, codes string, states array<int>, nexts array<int>, costs array<bigint>, audits array<string>")


def audits(rows: DataFrame, conv: str) -> DataFrame:
    """``conv_id, cost, audit, illegal`` per conversation of ``flagged`` rows: its chunks' tables composed in order."""
    names = ["conv_id", "cost", "audit", "illegal"]
    dealt = _tables(rows, conv).repartition(shuffle_width(rows), "conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, now, last, wrong, out, kind = None, {}, "", 0, [], None

        def close() -> None:
            out.append((here[0], *min(now[s] for s in ENDS if s in now), wrong))

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv_id, codes, *table in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "codes", "states", "nexts", "costs", "audits"))):
                if here is None or here[0] != conv_id:
                    if here is not None:
                        close()
                    here, now, last, wrong = (conv_id,), {0: (0, "")}, "", 0
                initials = last + "".join(INITIALS[SYMBOLS.index(c) // 3] for c in codes)
                wrong, last = wrong + illegal(initials), initials[-1]
                now = compose(now, list(zip(*table)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, (kind, pa.int64(), pa.string(), pa.int64()))], names)
            out.clear()
        if here is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (kind, pa.int64(), pa.string(), pa.int64()))], names)

    return dealt.mapInArrow(run, f"conv_id {conv}, cost bigint, audit string, illegal bigint")


class Editor:
    """Applies an audit to the rows of a conversation, one by one, and hashes the result."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.none = audit, 0, 0, True
        self.hash = hashlib.sha256()

    def _write(self, initial: str, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.none else chr(10)}{role}:{text}".encode())
        self.none, self.state = False, STEP[self.state, initial]

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._write(turn(self.state), _ROLE[turn(self.state)], "")

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self._write(role[:1], role, text)
        elif edit == "R":
            self._write(turn(self.state), _ROLE[turn(self.state)], text)

    def close(self) -> str:
        self._insert()
        return self.hash.hexdigest()


def _hashed(rows: DataFrame, found: DataFrame, conv: str) -> DataFrame:
    """``found`` with ``repaired_sha256``; rows stream through their conversation's hasher in order."""
    known = [c for c in found.columns if c != "conv_id"]
    kinds = dict(found.dtypes)
    text = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", _key().alias("key"), "text", *[F.lit(None).cast(kinds[c]).alias(c) for c in known])
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast(dict(rows.dtypes)["turn"]).alias("turn"), F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("text"), *known,
    )
    both = heads.unionByName(text).repartition(shuffle_width(rows), "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "key")
    both = both.select("conv_id", "kind", "role", "text", *known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, editor = None, None
        for batch in batches:
            done, ends = [], []
            kind, roles, texts = batch.column("kind").to_pylist(), batch.column("role"), batch.column("text")
            for i, k in enumerate(kind):
                if k:
                    editor.row(roles[i].as_py(), texts[i].as_py())
                    continue
                if head is not None:
                    done.append(head)
                    ends.append(editor.close())
                head = batch.slice(i, 1).select(["conv_id", *known])
                editor = Editor(head.column("audit")[0].as_py())
            if done:
                whole = pa.Table.from_batches(done).combine_chunks().append_column("repaired_sha256", pa.array(ends))
                yield from whole.to_batches()
        if head is not None:
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array([editor.close()])], [*head.schema.names, "repaired_sha256"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in known)
    return both.mapInArrow(run, f"conv_id {conv}, {schema}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` per conversation.

    ``rows(conv_id, turn, role, text)`` are taken by turn, nulls first; rows of one turn by role and
    the MD5 of their text, so repeated rows stand side by side.  A row's first fault counts: blank
    (no character but white space), duplicate (role and text seen earlier), truncated (the last
    such character is none of ``.!?``).  ``illegal`` counts neighbours whose role initials are not
    su, ua or au; ``gaps`` the turns missing between the least and greatest, without null turns.
    The repair of least cost, then least audit, makes role initials ``(s?(ua)+)?``; only rows whose
    role starts with s, u or a can be kept as they are.  A null conv_id is a conversation of its
    own, null roles and texts count as one space; no rows give no conversations; other columns are
    ignored.
    """
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    conv = dict(rows.dtypes)["conv_id"]
    flags = flagged(rows)
    count = lambda c: F.sum(F.col(c).cast("bigint"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    stats = flags.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).alias("gaps"), count("blank").alias("blank"), count("again").alias("duplicate"), count("cut").alias("truncated")
    )
    found = null_safe(stats, audits(flags, conv), ["conv_id"])
    order = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return _hashed(rows, materialize(found.select(*order)), conv)


def damage_and_repair(rows: DataFrame) -> DataFrame:
    """``repair`` of the damaged rows, for every conversation that ``rows`` has; those that lose all rows have zeros and an empty audit."""
    done = repair(damaged(rows)).withColumnRenamed("conv_id", "_conv")
    all_ids = rows.select("conv_id").distinct()
    met = all_ids.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    zeros = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256().hexdigest()
    return met.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
