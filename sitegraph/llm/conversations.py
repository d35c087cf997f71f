"""Repair of conversation structure by weighted CYK interval parsing.

The role initials of a conversation should read ``(s?(ua)+)?``.  The repair grammar has
one nonterminal [p, q] for each pair of states of that pattern (what a span of rows, with
edits, leads from and to), in Chomsky normal form: [p, q] -> [p, r] [r, q], and a row
alone by Keep, Rerole or Delete.  The cell of a span holds for each nonterminal the least
(cost, audit), and the insertion closure stands before each row and after the last one.
Cells are combined bottom-up by span length: 1, 2, 4, ...  One split of a span is enough:
the nonterminals are pairs of states, so every parse passes each row boundary in some
state r, and the least over r at one boundary is the least over all parses.  Concatenation
keeps the order of (cost, audit): of two parses of a span with one nonterminal and equal
cost neither audit is a proper prefix of the other (it would differ by Inserts, which
cost), so the least audit of a part is in the least audit of the whole.

A conversation is cut into blocks of ``BLOCK`` rows by their place in the sorted table, and
the cells of blocks are combined ``BLOCK`` at a time, so a conversation of any length is
parsed by many tasks.  Only the last step, one SHA-256 of a conversation's repaired text,
reads the rows of a conversation in order; it streams them.

Cases: a null is one space (role, text, and conv_id and turn inside the damage key); rows of
one turn are ordered by role, then text; rows whose conv_id is null are one conversation; a
role without a character cannot be kept; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegraph.llm.common import Tables, positions

#: Rows of a block, and blocks (or blocks of blocks) combined by one step of a task.
BLOCK = 256


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


COSTS = Costs()
# FIXED VALUES: states of (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after ua.
STATES = 4
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
ROLE = {"u": "user", "a": "assistant"}
#: The role that Insert and Rerole write in each state, and the state after it.
WRITTEN = {p: next((ROLE[c], q) for (s, c), q in NEXT.items() if s == p and c in ROLE) for p in range(STATES)}


def damaged(rows: DataFrame) -> DataFrame:
    """``conv, conv_id, turn, role, text, copy`` of the rows that damage leaves."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(say("text"), "[.!?]", "")).otherwise(say("text"))
    copies = F.when(fate == 0, F.array().cast("array<int>")).when(fate == 3, F.array(F.lit(0), F.lit(1))) \
        .otherwise(F.array(F.lit(0)))
    return rows.select(conversation(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.when(fate == 4, "user").otherwise(say("role")).alias("role"), text.alias("text"),
                       F.explode(copies).alias("copy"))


def conversation(conv_id: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


# ---- cells ---------------------------------------------------------------------

def least(a, b):
    return b if a is None or (b is not None and b < a) else a


def combine(left: list, right: list) -> list:
    """The cell of two spans in a row: [p, q] -> [p, r] [r, q]."""
    out = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            x = left[p * STATES + r]
            if x is None:
                continue
            for q in range(STATES):
                y = right[r * STATES + q]
                if y is not None:
                    at = p * STATES + q
                    both = (x[0] + y[0], x[1] + y[1])
                    if out[at] is None or both < out[at]:
                        out[at] = both
    return out


def _closure() -> list:
    """Cells of a span without rows: any number of Inserts."""
    cell = [None] * (STATES * STATES)
    for p in range(STATES):
        cell[p * STATES + p] = (0, "")
    step = list(cell)
    for p in range(STATES):
        q = WRITTEN[p][1]
        step[p * STATES + q] = least(step[p * STATES + q], (COSTS.insert, "I"))
    for _ in range(STATES):
        cell = combine(cell, step)
    return cell


INSERTED = _closure()


def row_cell(initial: str, gone: bool, truncated: bool) -> list:
    """The cell of one row, Inserts before it included."""
    cell = [None] * (STATES * STATES)
    more = COSTS.truncated if truncated else 0
    for p in range(STATES):
        cell[p * STATES + p] = (COSTS.delete, "D")
        if not gone:
            q = NEXT.get((p, initial))
            if q is not None:
                cell[p * STATES + q] = least(cell[p * STATES + q], (COSTS.keep + more, "K"))
            q = WRITTEN[p][1]
            cell[p * STATES + q] = least(cell[p * STATES + q], (COSTS.rerole + more, "R"))
    return combine(INSERTED, cell)


ROW_CELLS = {(c, gone, cut): row_cell(c, gone, cut) for c in ("s", "u", "a", "") for gone in (False, True)
             for cut in (False, True)}


def span_cell(cells: list) -> list:
    """Cells of adjacent spans, combined by span length."""
    while len(cells) > 1:
        paired = [combine(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = paired + cells[len(paired) * 2:]
    return cells[0]


def repair(cell: list) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    whole = combine(cell, INSERTED)
    return min(whole[q] for q in ACCEPTED if whole[q] is not None)


def replay(audit: str, rows):
    """The repaired (role, text) rows that an audit makes of ``rows``, one by one."""
    state, rows = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            role, state = WRITTEN[state]
            yield role, ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = NEXT[state, role[:1]]
            yield role, text
        elif edit == "R":
            role, state = WRITTEN[state]
            yield role, text


# ---- tasks ----------------------------------------------------------------------

_CELL = "conv string, block long, costs array<long>, audits array<string>, first string, last string, illegal long"


def _pack(conv, block, cell, first, last, illegal):
    return (conv, block, [-1 if x is None else x[0] for x in cell], ["" if x is None else x[1] for x in cell],
            first, last, illegal)


def _groups(batches, keys: int):
    """Runs of rows (as tuples) with equal first ``keys`` columns, of sorted batches."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _out(rows, schema: pa.Schema, size: int = 500):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


_CELL_ARROW = pa.schema([("conv", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64())),
                         ("audits", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()),
                         ("illegal", pa.int64())])


def _row_blocks(batches):
    """Sorted (conv, block, at, initial, gone, truncated) -> a cell for each block."""
    def cells():
        for (conv, block), rows in _groups(batches, 2):
            letters = [r[1] for r in rows]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
            known = [ROW_CELLS[c if c in ("s", "u", "a") else "", gone, cut] for _, c, gone, cut in rows]
            yield _pack(conv, block, span_cell(known), letters[0], letters[-1], bad)
    return _out(cells(), _CELL_ARROW)


def _wider_blocks(batches):
    """Sorted (conv, block, part, cell, ...) of adjacent spans -> a cell for each block."""
    def cells():
        for (conv, block), parts in _groups(batches, 2):
            known = [[None if c < 0 else (c, a) for c, a in zip(p[1], p[2], strict=True)] for p in parts]
            seams = sum(a[4] + b[3] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
            yield _pack(conv, block, span_cell(known), parts[0][3], parts[-1][4], sum(p[5] for p in parts) + seams)
    return _out(cells(), _CELL_ARROW)


_BEST_ARROW = pa.schema([("conv", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])


def _best(batches):
    def rows():
        for b in batches:
            for conv, _, costs, audits, _, _, illegal in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield conv, *repair([None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True)]), illegal
    return _out(rows(), _BEST_ARROW)


_HASH_ARROW = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def _hashes(batches):
    """Sorted (conv, at, role, text, audit; the audit in a conversation's first row only)
    -> the hash of the repaired text, streamed."""
    def rows():
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def hashes():
        stream = rows()
        row = next(stream, None)
        while row is not None:
            conv, audit, digest, between = row[0], row[4], hashlib.sha256(), b""

            def own():
                nonlocal row
                while row is not None and row[0] == conv:
                    now, row = row, next(stream, None)
                    yield now[2], now[3]

            for role, text in replay(audit, own()):
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
            yield conv, digest.hexdigest()
    return _out(hashes(), _HASH_ARROW)


def repaired(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256``."""
    store = Tables(spark, "conversations")
    order = ["conv", "turn", "role", "text", "copy", "_tie"]
    # rows that agree in all of them are the same row twice: any order of them will do
    placed = positions(store, damaged(rows).withColumn("_tie", F.monotonically_increasing_id()), order)
    firsts = store.write(placed.groupBy("conv").agg(F.min("pos").alias("first_pos")), "firsts")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    keyed = placed.withColumn("digest", F.sha2("text", 256))
    seen = keyed.groupBy("conv", "role", "digest").agg(F.min("pos").alias("seen_pos"))
    known = keyed.join(seen, ["conv", "role", "digest"]).join(firsts, "conv").select(
        "conv", (F.col("pos") - F.col("first_pos")).alias("at"), "turn", F.substring("role", 1, 1).alias("initial"),
        blank.alias("blank"), (~blank & (F.col("seen_pos") < F.col("pos"))).alias("duplicate"), cut.alias("cut"))
    flags = store.write(known.withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate")), "flags")

    n = F.countDistinct("turn")
    stats = flags.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - n, F.lit(0)).cast("long").alias("gaps"),
        F.count_if("blank").alias("blank"), F.count_if("duplicate").alias("duplicate"),
        F.count_if("truncated").alias("truncated"), F.max("at").alias("last_at"))
    stats = store.write(stats, "stats")
    longest = (stats.agg(F.max("last_at")).first()[0] or 0) // BLOCK

    def gathered(df: DataFrame, *more: str) -> DataFrame:
        return df.repartition("conv", "block").sortWithinPartitions("conv", "block", "at").select("conv", "block", "at", *more)

    cells = gathered(flags.withColumn("block", F.floor(F.col("at") / BLOCK))
                     .withColumn("gone", F.col("blank") | F.col("duplicate")), "initial", "gone", "truncated") \
        .mapInArrow(_row_blocks, _CELL)
    while longest:
        longest //= BLOCK
        cells = store.write(cells, "cells")
        wider = cells.withColumnRenamed("block", "at").withColumn("block", F.floor(F.col("at") / BLOCK))
        cells = gathered(wider, *cells.columns[2:]).mapInArrow(_wider_blocks, _CELL)
    best = store.write(cells.mapInArrow(_best, "conv string, cost long, audit string, illegal long"), "best")

    text = placed.join(firsts, "conv").select("conv", (F.col("pos") - F.col("first_pos")).alias("at"), "role", "text")
    audits = best.select("conv", F.lit(0).cast("long").alias("at"), "audit")
    hashes = text.join(audits, ["conv", "at"], "left").select("conv", "at", "role", "text", "audit") \
        .repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(_hashes, "conv string, repaired_sha256 string")

    zero, empty = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest()
    every = rows.select("conv_id").distinct().withColumn("conv", conversation(F.col("conv_id")))
    out = every.join(stats, "conv", "left").join(best, "conv", "left").join(hashes, "conv", "left")
    return out.select("conv_id", *[F.coalesce(F.col(c), zero).alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def oracle() -> str:
    """The repair as a recursion over rows that keeps the least (cost, audit) of each state."""
    say = lambda c: f"coalesce(CAST({c} AS VARCHAR), ' ')"
    key = f"{say('conv_id')} || ':' || {say('turn')}"
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    # the sum after each byte is shifted through eight bits before the next one comes in
    crc = (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), "
           f"lambda s: unicode(s)::BIGINT)), lambda c, b: {bits}))")

    def go(state: str, cost, letter: str, role: str | None = None, text: str = "''") -> str:
        more = "" if role is None else f" || chr(10) || {role} || ':' || {text}"
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', "
                f"'t': {state}.t{more}}} END")

    def best(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    kept = lambda state, c: when(f"NOT gone AND initial = '{c}'", go(state, "cut", "K", "role", "text"))
    made = lambda state, r: when("NOT gone", go(state, f"({COSTS.rerole} + cut)", "R", f"'{r}'", "text"))
    drop = lambda state: go(state, COSTS.delete, "D")
    add = lambda state, r: go(state, COSTS.insert, "I", f"'{r}'")
    row = {"n0": drop("t0"), "n1": best(drop("t1"), kept("t0", "s")),
           "n2": best(drop("t2"), *[f(s, x) for s in ("t0", "t1", "t3") for f, x in ((kept, "u"), (made, "user"))]),
           "n3": best(drop("t3"), kept("t2", "a"), made("t2", "assistant"))}
    users = best("n2", add("n0", "user"), add("n1", "user"), add("n3", "user"))
    none = "NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

    def closed(source: str, keys: str) -> str:
        return (f"SELECT {keys}, n0 AS t0, n1 AS t1, m2 AS t2, {best('n3', add('m2', 'assistant'))} AS t3 FROM "
                f"(SELECT *, {users} AS m2 FROM ({source}))")

    start = f"SELECT conv_id, 0::BIGINT AS place, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n0, {none} AS n1, {none} AS n2, {none} AS n3 FROM convs"
    step = (f"SELECT s.conv_id, s.place + 1 AS place, {', '.join(f'{e} AS {n}' for n, e in row.items())} "
            "FROM states s JOIN marked r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND s.place = r.place")
    return f"""
WITH RECURSIVE fated AS (SELECT conv_id, turn, {say("role")} AS role, {say("text")} AS text, {crc} % 20 AS fate FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE fate WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM fated),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS place,
  regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM placed),
marked AS (SELECT *, final = '' AS blank, final <> '' AND again AS dup, final = '' OR again AS gone,
  CASE WHEN final <> '' AND NOT again AND final NOT IN ('.', '!', '?') THEN {COSTS.truncated} ELSE 0 END AS cut FROM seen),
convs AS (SELECT DISTINCT conv_id FROM conversations),
states AS ({closed(start, "conv_id, place")} UNION ALL {closed(step, "conv_id, place")}),
stats AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut > 0) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1),
ended AS (SELECT conv_id, place, {best("t0", "t3")} AS w FROM states)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c AS cost, w.a AS audit,
  sha256(substr(w.t, 2)) AS repaired_sha256
FROM convs c LEFT JOIN stats s ON c.conv_id IS NOT DISTINCT FROM s.conv_id
JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id AND e.place = coalesce(s.n, 0)"""
