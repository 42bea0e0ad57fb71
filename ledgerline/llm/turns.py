"""Conversation structure repair: turns aligned to an alternating grammar at least cost.

A repaired conversation's roles spell ``(s?(ua)+)?`` in initials: perhaps a
system turn, then user and assistant in turn.  Conversations are cut into blocks
of consecutive turns.  A block is aligned, by Wagner and Fischer's table, to
each feasible length of the alternating string that leads from one state of the
grammar to another; the tables are bands around the diagonal, as wide as the
cost of a first alignment allows (Ukkonen).  A conversation is then a walk over
its blocks' results, so that one of any length is aligned in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.work import Scratch

#: Turns of a conversation aligned in one table.
BLOCK = 64

#: Costs of the edits; a turn cut off in mid-sentence that stays adds to its edit.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Where a walk through the grammar may stand: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)

ROLES = {"u": "user", "a": "assistant"}

#: More than any cost.
_FAR = 1 << 60

#: A result of a block from one state to another: cost and edits, or None where there is none.
Result = tuple[int, str] | None


# --- one block


def _expected(state: int) -> str:
    return "a" if state == USER else "u"


def _first_cost(turns: tuple[tuple[str, bool, int], ...], state: int) -> int:
    """The cost of one plain walk: deletes what is cut off, changes every role that doesn't fit."""
    cost, want = 0, _expected(state)
    for initial, truncated, _ in turns:
        if truncated:
            cost += DELETE
            continue
        cost += KEEP if initial == want else REROLE
        want = "a" if want == "u" else "u"
    return cost


def _symbol(left: int, last: str) -> str:
    """The first symbol of the alternating string of ``left`` symbols that ends in ``last``."""
    return last if left % 2 else ("u" if last == "a" else "a")


def _table(turns: tuple[tuple[str, bool, int], ...], last: str, bound: int) -> list[dict[int, int]]:
    """Cost of aligning the turns from i on to the ``left`` last symbols, for every i and ``left`` in the band.

    A difference of turns and symbols costs its deletions or insertions at
    least; what would cost more than ``bound`` is no part of the band.
    Insertions stand before a turn, so that edits of a block end in a turn's.
    """
    n = len(turns)
    table: list[dict[int, int]] = [{} for _ in range(n + 1)]
    table[n][0] = 0
    for i in range(n - 1, -1, -1):
        initial, truncated, _ = turns[i]
        extra, below, row = (TRUNCATED if truncated else 0), table[i + 1], table[i]
        for left in range(max(0, n - i - bound // DELETE), n - i + bound // INSERT + 1):
            costs = []
            if left in below:
                costs.append(below[left] + DELETE)
            if left:
                if left - 1 in below:
                    costs.append(below[left - 1] + extra + (KEEP if initial == _symbol(left, last) else REROLE))
                if left - 1 in row:
                    costs.append(row[left - 1] + INSERT)
            if costs and (least := min(costs)) <= bound:
                row[left] = least
    return table


def _traced(turns: tuple[tuple[str, bool, int], ...], table: list[dict[int, int]], last: str, i: int, left: int) -> str:
    """The edits of a cheapest alignment from (i, left) on, of several the least in ASCII order.

    Letters are tried in their order; two alignments from one cell never have
    edits of which one begins the other, so the first difference decides.
    """
    edits = []
    while i < len(turns):
        initial, _, forced = turns[i]
        below, cost = table[i + 1], table[i][left]
        if left in below and below[left] + DELETE == cost:
            edit, i = "D", i + 1
        elif left and table[i].get(left - 1, _FAR) + INSERT == cost:
            edit, left, forced = "I", left - 1, 0
        elif initial == _symbol(left, last):
            edit, i, left = "K", i + 1, left - 1
        else:
            edit, i, left = "R", i + 1, left - 1
        edits.append(edit + "D" * forced)
    return "".join(edits)


def _best(found: Iterator[Result]) -> Result:
    return min((f for f in found if f is not None), default=None)


def _from_start_by_system(turns: tuple[tuple[str, bool, int], ...], tables: dict) -> Iterator[tuple[int, Result]]:
    """Results of walks that keep a system turn and delete all before it; to each state, for each such turn."""
    for i, (initial, truncated, forced) in enumerate(turns):
        if initial != "s":
            continue
        cost = DELETE * i + (TRUNCATED if truncated else 0)
        head = "".join("D" + "D" * f for _, _, f in turns[:i]) + "K" + "D" * forced
        rest = turns[i + 1 :]
        yield SYSTEM, (cost + DELETE * len(rest), head + "".join("D" + "D" * f for _, _, f in rest))
        for state, last in ((USER, "u"), (ASSISTANT, "a")):
            table = tables[last]
            for left, more in table[i + 1].items():
                if left and _symbol(left, last) == "u":
                    yield state, (cost + more, head + _traced(turns, table, last, i + 1, left))


@lru_cache(1 << 13)
def aligned(turns: tuple[tuple[str, bool, int], ...], forced: int) -> tuple[tuple[Result, ...], ...]:
    """Cheapest edits of a block from each state to each state, of equal cost the least in ASCII order.

    ``turns`` has the initial of each turn that may stay, whether it is cut off,
    and how many turns that must go follow it; ``forced`` must go before the first.
    """
    n = len(turns)
    # to end in another state than the first walk takes one turn more or less, a cut one and an insertion at worst
    bound = max(_first_cost(turns, s) for s in STATES) + TRUNCATED + REROLE - DELETE + INSERT
    tables = {last: _table(turns, last, bound) for last in "ua"}
    gone = (DELETE * n, "".join("D" + "D" * f for _, _, f in turns))
    out = []
    for state in STATES:
        results: dict[int, list[Result]] = {s: [] for s in STATES}
        results[state].append(gone)
        for target, last in ((USER, "u"), (ASSISTANT, "a")):
            table = tables[last]
            lengths = [m for m in table[0] if m and _symbol(m, last) == _expected(state)]
            if lengths:
                least = min(table[0][m] for m in lengths)
                for m in lengths:
                    if table[0][m] == least:
                        results[target].append((least, _traced(turns, table, last, 0, m)))
        if state == START:
            for target, result in _from_start_by_system(turns, tables):
                results[target].append(result)
        out.append(tuple(_best(results[s]) for s in STATES))
    must = DELETE * (forced + sum(f for _, _, f in turns))
    return tuple(
        tuple(None if r is None else (r[0] + must, "D" * forced + r[1]) for r in row) for row in out
    )


def _block(faults: list[str], initials: list[str]) -> tuple[tuple[Result, ...], ...]:
    turns, forced, before = [], 0, 0
    for fault, initial in zip(faults, initials):
        if fault in ("blank", "duplicate"):
            if turns:
                forced += 1
            else:
                before += 1
            continue
        if turns:
            turns[-1] = (*turns[-1], forced)
        turns.append((initial if initial in "sua" else "?", fault == "truncated"))
        forced = 0
    if turns:
        turns[-1] = (*turns[-1], forced)
    return aligned(tuple(turns), before)


# --- a conversation's blocks

#: What must follow the last turn for a conversation to be whole: cost and edits by state.
_TAILS = {START: (0, ""), ASSISTANT: (0, ""), USER: (INSERT, "I"), SYSTEM: (2 * INSERT, "II")}


def walked(blocks: list[list[list[Result]]]) -> tuple[int, list[tuple[int, str]]]:
    """The cheapest walk over blocks, of several the one whose edits are least: its cost, and the state
    each block is entered in with its edits.

    Edits up to the end of a block, in different states, differ before either
    ends, so their order carries over to whatever follows.
    """
    reached = {START: (0, 0)}  # state: cost, rank of the edits so far
    steps = []
    for block in blocks:
        options: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank) in reached.items():
            for target, result in zip(STATES, block[state]):
                if result is not None:
                    option = (cost + result[0], rank, result[1], state)
                    if target not in options or option < options[target]:
                        options[target] = option
        steps.append({t: (state, edits) for t, (_, _, edits, state) in options.items()})
        order = sorted(options, key=lambda t: options[t][1:3])
        reached = {t: (options[t][0], rank) for rank, t in enumerate(order)}
    ends = {t: (cost + _TAILS[t][0], rank) for t, (cost, rank) in reached.items()}
    state = min(ends, key=ends.__getitem__)
    cost, path, tail = ends[state][0], [], _TAILS[state][1]
    for step in reversed(steps):
        before, edits = step[state]
        path.append((before, edits + tail))
        state, tail = before, ""
    return cost, path[::-1]


# --- tables

#: Faults, the first of which counts.
FAULTS = ["blank", "duplicate", "truncated"]

_COUNTS = ["gaps", *FAULTS, "illegal", "cost"]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with damage by the CRC-32 of ``conv_id:turn``: conv_id, turn, role, text, and gone for a row dropped.

    Null roles and texts become one space, as do null ids and turns where they
    are spelled.  Of every 20 draws 0 drops the row, 1 empties its text, 2 takes
    its sentence ends, 3 repeats it, 4 makes it the user's.
    """
    spelled = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))
    )
    draw = F.crc32(spelled.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(draw == 3, 2).otherwise(1)))
    out = rows.select(
        "conv_id",
        "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        text.alias("text"),
        (draw == 0).alias("gone"),
        copies.alias("copy"),
    )
    return out.drop("copy")


def _sorted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows in order, written, with ``at``: their place, ascending over the whole table.

    Ranges are cut by conversation, turn, role, text and a draw, so a
    conversation of any size, and a turn repeated without end, spread over many.
    """
    keys = ["conv_id", "turn", "role", "text"]
    own = rows.select(*keys, "gone", F.rand(11).alias("draw"))
    own = own.repartitionByRange(*keys, "draw").sortWithinPartitions(*keys, "draw")
    own = own.withColumn("filled", F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")))
    last = F.substring("filled", -1, 1)
    return scratch.write(
        own.select(
            F.monotonically_increasing_id().alias("at"),
            *keys,
            "gone",
            (F.length("filled") == 0).alias("blank"),
            last.isin(".", "!", "?").alias("ended"),
            F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"),
        ),
        "turns",
    )


def _faults(turns: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial, gone and fault of every row, without texts.

    A row is a duplicate if its role and text stand earlier in its
    conversation: the earliest place is an aggregate, combined before the
    shuffle, and only texts that stand twice are joined back.
    """
    light = turns.select("conv_id", "at", "turn", "role", "gone", "blank", "ended", "digest")
    filled = light.filter("NOT gone AND NOT blank").groupBy("conv_id", "role", "digest")
    firsts = filled.agg(F.min("at").alias("first"), F.max("at").alias("last")).filter("first < last").drop("last")
    f = firsts.withColumnsRenamed({"conv_id": "c", "role": "r", "digest": "d"})
    same = [light["conv_id"].eqNullSafe(f["c"]), light["role"] == f["r"], light["digest"] == f["d"]]
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("ended"), "truncated")
    )
    return light.join(f, same, "left").select(
        "conv_id",
        "at",
        "turn",
        F.substring("role", 1, 1).alias("initial"),
        "gone",
        F.coalesce(fault, F.lit("")).alias("fault"),
    )


_RESULT = pa.struct([("cost", pa.int64()), ("edits", pa.string())])
_BLOCK = pa.schema(
    [
        ("cell", pa.int64()),
        *[(c, pa.int64()) for c in (*FAULTS, "illegal", "turns", "low", "high", "opens", "closes")],
        ("head", pa.string()),
        ("tail", pa.string()),
        ("results", pa.list_(_RESULT)),
    ]
)
_BLOCK_DDL = (
    "cell bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, "
    "opens bigint, closes bigint, head string, tail string, results array<struct<cost: bigint, edits: string>>"
)

_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _summary(cell: int, rows: list[dict]) -> dict:
    """One block: what it counts, where it begins and ends, and its alignments from each state to each."""
    rows = sorted((r for r in rows if not r["gone"]), key=itemgetter("at"))
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials, faults = [r["initial"] for r in rows], [r["fault"] for r in rows]
    results = chain.from_iterable(_block(faults, initials))
    return {
        "cell": cell,
        **{f: faults.count(f) for f in FAULTS},
        "illegal": sum(pair not in _LEGAL for pair in zip(initials, initials[1:])),
        "turns": len(set(turns)),
        "low": min(turns, default=None),
        "high": max(turns, default=None),
        "opens": turns[0] if turns else None,
        "closes": turns[-1] if turns else None,
        "head": initials[0] if rows else None,
        "tail": initials[-1] if rows else None,
        "results": [None if r is None else {"cost": r[0], "edits": r[1]} for r in results],
    }


def _blocks(faults: DataFrame) -> DataFrame:
    """conv_id and one row per block of its consecutive rows, all of them in one cell of BLOCK places."""
    cell = F.shiftright("at", BLOCK.bit_length() - 1).alias("cell")
    row = F.struct("at", "turn", "initial", "gone", "fault")
    grouped = faults.groupBy("conv_id", cell).agg(F.collect_list(row).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_summary(c.as_py(), r.as_py()) for c, r in zip(batch.column("cell"), batch.column("rows"))]
            table = pa.RecordBatch.from_pylist(made, schema=_BLOCK)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *table.columns], names=["conv_id", *table.schema.names]
            )

    id_type = faults.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {id_type}, {_BLOCK_DDL}")


def _folded(blocks: list[dict]) -> dict:
    """One conversation from its blocks, in order."""
    blocks.sort(key=itemgetter("cell"))
    size = len(STATES)
    results = [
        [
            [None if r is None else (r["cost"], r["edits"]) for r in b["results"][i : i + size]]
            for i in range(0, size * size, size)
        ]
        for b in blocks
    ]
    cost, path = walked(results)
    counts = {f: sum(b[f] for b in blocks) for f in FAULTS}
    illegal, distinct, tail, closes = sum(b["illegal"] for b in blocks), 0, None, None
    for b in blocks:
        if b["head"] is not None:
            illegal += tail is not None and (tail, b["head"]) not in _LEGAL
            tail = b["tail"]
        if b["turns"]:
            distinct += b["turns"] - (b["opens"] == closes)
            closes = b["closes"]
    lows, highs = ([b[c] for b in blocks if b[c] is not None] for c in ("low", "high"))
    gaps = max(highs) - min(lows) + 1 - distinct if lows else 0
    parts = [{"cell": b["cell"], "state": s, "edits": e} for b, (s, e) in zip(blocks, path)]
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": "".join(e for _, e in path), "parts": parts}


_PARTS = pa.list_(pa.struct([("cell", pa.int64()), ("state", pa.int64()), ("edits", pa.string())]))
_FOLDED = pa.schema([*[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("parts", _PARTS)])


def audits(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and the cheapest edits; and the rows in order, for ``repaired``.

    ``rows`` has conv_id, turn, role, text (neither null) and gone; a gone row
    only tells that its conversation exists.  Columns: conv_id (null is an id
    like any other), gaps, blank, duplicate, truncated, illegal, cost, audit,
    and parts, the audit by block.  Rows are in order of turn, nulls first, of
    one turn by role and text.
    """
    turns = _sorted(rows, scratch)
    blocks = scratch.write(_blocks(_faults(turns)), "blocks")
    fields = [F.col(c) for c in blocks.columns if c != "conv_id"]
    whole = blocks.groupBy("conv_id").agg(F.collect_list(F.struct(*fields)).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.RecordBatch.from_pylist([_folded(b.as_py()) for b in batch.column("blocks")], schema=_FOLDED)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *table.columns], names=["conv_id", *table.schema.names]
            )

    id_type = rows.schema["conv_id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    schema = f"conv_id {id_type}, {counts}, audit string, parts array<struct<cell: bigint, state: bigint, edits: string>>"
    found = scratch.write(whole.mapInArrow(run, schema), "audits")
    scratch.drop("blocks")
    return found, turns


_PLACED = pa.schema([("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


class _Editor:
    """Turns of conversations in order, edited as their blocks say."""

    def __init__(self) -> None:
        self.conv_id: object = None
        self.edits, self.at, self.state, self.place = "", 0, START, 0

    def _put(self, edit: str, role: str, text: str) -> tuple:
        row = (self.conv_id, self.place, edit, role, text)
        self.place += 1
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        return row

    def inserted(self) -> Iterator[tuple]:
        """The insertions that come next."""
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put("I", ROLES[_expected(self.state)], "")

    def open(self, conv_id: object, state: int, edits: str) -> None:
        if conv_id != self.conv_id:
            self.conv_id, self.place = conv_id, 0
        self.edits, self.at, self.state = edits, 0, state

    def turn(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            yield self._put(edit, role if edit == "K" else ROLES[_expected(self.state)], text)


def repaired(found: DataFrame, turns: DataFrame) -> DataFrame:
    """The turns of whole conversations from both results of ``audits``: conv_id, place (from 0), edit, role, text.

    Rows of a conversation lie in one partition in order, as a digest of them
    needs, and are streamed: memory doesn't grow with a conversation.
    """
    parts = found.select("conv_id", F.explode("parts").alias("part"))
    parts = parts.select(
        "conv_id",
        F.shiftleft("part.cell", BLOCK.bit_length() - 1).alias("at"),
        F.col("part.state").alias("state"),
        F.col("part.edits").alias("edits"),
    )
    rows = turns.filter("NOT gone").select("conv_id", "at", "role", "text")
    both = parts.unionByName(rows, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", "at", F.col("edits").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, id_type = _Editor(), None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            ids = pa.array([row[0] for row in out], id_type)
            made = [pa.array(values, field.type) for values, field in zip(list(zip(*out))[1:] or [[]] * 4, _PLACED)]
            return pa.RecordBatch.from_arrays([ids, *made], names=["conv_id", *_PLACED.names])

        for batch in batches:
            id_type, out = batch.column("conv_id").type, []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "state", "edits", "role", "text")]
            for conv_id, state, edits, role, text in zip(*columns):
                if edits is None:
                    out += editor.turn(role, text)
                else:
                    out += editor.inserted()
                    editor.open(conv_id, state, edits)
            yield packed(out)
        if id_type is not None:
            yield packed(list(editor.inserted()))

    id_type = found.schema["conv_id"].dataType.simpleString()
    return both.mapInArrow(run, f"conv_id {id_type}, place bigint, edit string, role string, text string")


def digests(whole: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``repaired``: of its ``role:text``, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, hashed, id_type = None, None, None

        def packed(done: list[tuple]) -> pa.RecordBatch:
            ids, values = pa.array([c for c, _ in done], id_type), pa.array([h for _, h in done], pa.string())
            return pa.RecordBatch.from_arrays([ids, values], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            id_type, done = batch.column("conv_id").type, []
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if hashed is not None:
                        done.append((current, hashed.hexdigest()))
                    current, hashed = conv_id, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            yield packed(done)
        if hashed is not None:
            yield packed([(current, hashed.hexdigest())])

    id_type = whole.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {id_type}, repaired_sha256 string")


def conversation_audits(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Every conversation damaged, audited and repaired, its repaired turns as a digest."""
    found, turns = audits(damaged(rows), scratch)
    hashes = digests(repaired(found, turns)).withColumnRenamed("conv_id", "c")
    digest: Column = F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    out = found.join(hashes, found["conv_id"].eqNullSafe(hashes["c"]), "left")
    return out.select("conv_id", *_COUNTS, "audit", digest)
