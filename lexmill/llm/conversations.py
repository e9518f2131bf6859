"""Conversation structure repair: error-correcting Earley parsing of role sequences.

The grammar of a sound conversation, ``(s? (u a)+)?``, is written left-linear over four nonterminals: what
has been accepted so far ends in nothing, system, user or a reply. Productions for errors stand beside those
for sound input: a row may be deleted, take another role, or a role be inserted. Each chart set keeps, for
every completed nonterminal, the least (cost, audit); the completed chart at the end yields the repair.

Since the grammar is left-linear, every item starts at the beginning, and a chart set is summed up by its four
completed nonterminals. So a long conversation is parsed in blocks: each block is parsed once for every nonterminal
that may stand before it, and the results are chained. Rows are put in order by a range partitioning over
conversation, turn, role and text, which splits a conversation of any size; all that is kept for each
conversation in one task is a row for each block, and the repaired text only streams through the hash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import discard, durable_at, out_of_the_way, small_batches

#: Rows of a conversation that are parsed at once, and characters of their texts, but for one longer text.
BLOCK_ROWS = 4096
BLOCK_CHARS = 4 << 20
#: Characters of the repaired text that a row of its pieces holds, about.
PIECE_CHARS = 1 << 20

# Fixed values of the contract: costs, and the initials of edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, REPLY = range(4)
#: Left-linear productions: (what stands before, role, what it completes).
GRAMMAR = ((START, "s", SYSTEM), (START, "u", USER), (SYSTEM, "u", USER), (REPLY, "u", USER), (USER, "a", REPLY))
GOAL = (START, REPLY)


def _insert(chart: list) -> list:
    """Complete by inserted roles, until nothing gets cheaper."""
    changed = True
    while changed:
        changed = False
        for before, role, done in GRAMMAR:
            if role in ROLES and chart[before] is not None:
                cost, audit = chart[before]
                item = (cost + INSERT, audit + "I")
                if chart[done] is None or item < chart[done]:
                    chart[done], changed = item, True
    return chart


def parse(rows: str, start: int = START) -> tuple:
    """(cost, audit) of each nonterminal after ``rows``, which begin after ``start``; None if it can't be reached.

    A row is two characters: its role's initial, and ``x`` if it must go, ``t`` if it is truncated, ``.`` else."""
    chart: list = [None] * 4
    chart[start] = (0, "")
    chart = _insert(chart)
    for at in range(0, len(rows), 2):
        initial, state = rows[at], rows[at + 1]
        following: list = [None] * 4
        extra = TRUNCATED if state == "t" else 0
        for done, item in enumerate(chart):
            if item is not None:
                following[done] = (item[0] + DELETE, item[1] + "D")
        if state != "x":
            for before, role, done in GRAMMAR:
                if chart[before] is not None and (role == initial or role in ROLES):
                    cost, audit = chart[before]
                    item = (cost + KEEP + extra, audit + "K") if role == initial else (cost + REROLE + extra, audit + "R")
                    if following[done] is None or item < following[done]:
                        following[done] = item
        chart = _insert(following)
    return tuple(chart)


_short = lru_cache(maxsize=1 << 16)(parse)


def _parsed(rows: str, start: int) -> tuple:
    return _short(rows, start) if len(rows) <= 64 else parse(rows, start)


def repaired(rows, audit: str, start: int = START):
    """The repaired (role, text) rows of one block, parsed with ``audit`` after ``start``."""
    state, rows = start, iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit != "K":
            role = ROLES["a" if state == USER else "u"]
        state = SYSTEM if state == START and role[:1] == "s" else REPLY if state == USER else USER
        yield role, text


class _Path:
    """The blocks parsed so far, as a chain that paths share."""

    __slots__ = ("audit", "back", "block", "cost", "entry")

    def __init__(self, back, cost, block, entry, audit):
        self.back, self.cost, self.block, self.entry, self.audit = back, cost, block, entry, audit


def _later(a: _Path, b: _Path) -> bool:
    """Whether a's audit comes after b's; both end after the same block."""
    x, y = [], []
    while a is not b:
        x.append(a.audit)
        y.append(b.audit)
        a, b = a.back, b.back
    return "".join(reversed(x)) > "".join(reversed(y))


def chain(paths: list, block: int, parsed: list) -> list:
    """The best path to each nonterminal after one more block; ``parsed``: its results by nonterminal before it."""
    out: list = [None] * 4
    for entry, path in enumerate(paths):
        if path is None:
            continue
        for done, item in enumerate(parsed[entry]):
            if item is None:
                continue
            new = _Path(path, path.cost + item[0], block, entry, item[1])
            if out[done] is None or new.cost < out[done].cost or new.cost == out[done].cost and _later(out[done], new):
                out[done] = new
    return out


def damaged(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, gone: rows with the contract's faults put in. A dropped row stays, marked ``gone``
    and without text, so that its conversation is known. Nulls count as one space, but for turn, which stays null."""
    or_space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(or_space(conv_id), F.lit(":"), or_space(turn)), "UTF-8")) % 20
    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"), kind.alias("kind"))
    new_text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    new_role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", new_role.alias("role"), new_text.alias("text"), (F.col("kind") == 0).alias("gone"), (F.col("kind") == 3).alias("twice"))
    return rows.withColumn("again", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice", "again")


def in_order(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with pos, their place in the order by conv_id, turn (nulls first),
    role and text, and block, the pos of the first row of a run of at most ``block_rows`` rows of one conversation (fewer, if their
    texts are long).

    Ties of the whole key are equal rows, whose order is of no matter; a row number deals them to several tasks."""
    spark = rows.sparkSession
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64)), F.xxhash64("text"), F.monotonically_increasing_id()]
    # conversations of many rows with one turn and role are told apart by the beginning and a hash of their texts
    keyed = rows.select("conv_id", "turn", "role", "text", "gone", by[3].alias("head"), by[4].alias("hash"), by[5].alias("salt"))
    order = [by[0], by[1], "role", "head", "hash", "salt"]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def number(batches):
        pos, last, block, chars = None, None, None, 0
        for batch in batches:
            at, blocks = [], []
            for i, (c, length) in enumerate(zip(batch.column(0).to_pylist(), pc.utf8_length(batch.column(3)).to_pylist(), strict=True)):
                if pos is None:
                    pos = batch.column(5)[i].as_py() << 40
                if block is None or c != last or pos - block >= block_rows or chars + length > BLOCK_CHARS:
                    last, block, chars = c, pos, 0
                chars += length
                at.append(pos)
                blocks.append(block)
                pos += 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(at, pa.int64()), pa.array(blocks, pa.int64())], names=["conv_id", "turn", "role", "text", "gone", "pos", "block"])

    return dealt.select("conv_id", "turn", "role", "text", "gone", F.spark_partition_id().alias("part")).mapInArrow(number, f"conv_id {kind}, turn long, role string, text string, gone boolean, pos long, block long")


def faults(ordered: DataFrame) -> DataFrame:
    """conv_id, block, pos, turn, initial, fault (``b``lank, ``d``uplicate, ``t``runcated, ``.`` none, ``-`` gone) of each row.

    The first row of each conversation with a role and text is found by a grouping, and met again by its place."""
    last = F.right(F.regexp_replace("text", "[ \\x09-\\x0D]+$", ""), F.lit(1))
    own = ordered.select("conv_id", "block", "pos", "turn", "gone", F.left("role", F.lit(1)).alias("initial"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "role", F.lit(2), "text").alias("k2"))
    first = own.where("NOT gone").groupBy("conv_id", "k1", "k2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    fault = F.when(F.col("gone"), "-").when(F.col("blank"), "b").when(F.col("is_first").isNull(), "d").when(F.col("open"), "t").otherwise(".")
    return own.join(first, "pos", "left").select("conv_id", "block", "pos", "turn", "initial", fault.alias("fault"))


BLOCKS = "conv_id {kind}, block long, rows string, first_turn long, last_turn long, turns long"
PARTS = "conv_id {kind}, block long, entry int, audit string, is_last boolean, is_first boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, full_audit string"
LEGAL = {"su", "ua", "au"}


def block_rows_of(marked: DataFrame) -> DataFrame:
    """One row for each block: its rows as initial and fault, and its turns."""
    kind = marked.schema["conv_id"].dataType.simpleString()
    dealt = marked.repartition("block").sortWithinPartitions("block", "pos").select("conv_id", "block", "turn", "initial", "fault")

    def gather(batches):
        now, out = None, []

        def closed():
            conv, block, marks, turns = now
            kept = [t for t in turns if t is not None]
            return conv, block, "".join(marks), kept[0] if kept else None, kept[-1] if kept else None, len(set(kept))

        for batch in batches:
            for conv, block, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[1] != block:
                    if now is not None:
                        out.append(closed())
                    now = (conv, block, [], [])
                if fault != "-":
                    # a role without letters counts as a blank
                    now[2].append((initial or "\0") + fault)
                    now[3].append(turn)
            if len(out) >= 1024:
                yield _table(out, schema)
                out = []
        if now is not None:
            out.append(closed())
        yield _table(out, schema)

    schema = BLOCKS.format(kind=kind)
    types = _arrow(dealt.sparkSession, schema)

    def _table(rows, _):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], schema=types)

    return dealt.mapInArrow(gather, schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def parsed_blocks(blocks: DataFrame) -> DataFrame:
    """Each block's part of its conversation's repair, and on the last one what the whole conversation comes to."""
    kind = blocks.schema["conv_id"].dataType.simpleString()
    schema = PARTS.format(kind=kind)
    types = _arrow(blocks.sparkSession, schema)
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").select("conv_id", "block", "rows", "first_turn", "last_turn", "turns")

    def finish(conv, paths, total):
        done = None
        for goal in GOAL:
            path = paths[goal]
            if path is not None and (done is None or path.cost < done.cost or path.cost == done.cost and _later(done, path)):
                done = path
        parts, path = [], done
        while path.back is not None:
            parts.append((path.block, path.entry, path.audit))
            path = path.back
        parts.reverse()
        low, high, turns = total["low"], total["high"], total["turns"]
        gaps = high - low + 1 - turns if turns else 0
        sums = (gaps, *(total[f] for f in "bdt"), total["illegal"], done.cost, "".join(p[2] for p in parts))
        for i, (block, entry, audit) in enumerate(parts):
            last = i == len(parts) - 1
            yield (conv, block, entry, audit, last, i == 0, *(sums if last else (None,) * 7))

    def walk(batches):
        conv, paths, total, out = None, None, None, []

        def tables():
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], schema=types)

        for batch in batches:
            for c, block, rows, first_turn, last_turn, turns in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if paths is None or c != conv:
                    if paths is not None:
                        out.extend(finish(conv, paths, total))
                    conv, paths = c, [_Path(None, 0, None, None, ""), None, None, None]
                    total = {"low": None, "high": None, "turns": 0, "b": 0, "d": 0, "t": 0, "illegal": 0, "role": None}
                marks = "".join(r + ("x" if f in "bd" else f) for r, f in zip(rows[::2], rows[1::2], strict=True))
                paths = chain(paths, block, [_parsed(marks, s) if paths[s] is not None else None for s in range(4)])
                for f in "bdt":
                    total[f] += rows[1::2].count(f)
                roles = ([total["role"]] if total["role"] is not None else []) + list(rows[::2])
                total["illegal"] += sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
                total["role"] = roles[-1] if roles else None
                if turns:
                    total["turns"] += turns - (total["high"] == first_turn)
                    total["low"] = first_turn if total["low"] is None else total["low"]
                    total["high"] = last_turn
            if len(out) >= 1024:
                yield tables()
        if paths is not None:
            out.extend(finish(conv, paths, total))
        yield tables()

    return dealt.mapInArrow(walk, schema)


def repaired_rows(ordered: DataFrame, parts: DataFrame) -> DataFrame:
    """conv_id, block, at, role, text: the rows of every conversation after the repair, in the order of (block, at)."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, block long, at long, role string, text string"
    types = _arrow(ordered.sparkSession, schema)

    def walk(batches):
        for rows in _blocks(batches):
            lines = repaired([(r["role"], r["text"]) for r in rows if not r["gone"]], rows[0]["audit"], rows[0]["entry"])
            out = [(rows[0]["conv_id"], rows[0]["block"], i, role, text) for i, (role, text) in enumerate(lines)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(types)], schema=types)

    return _joined(ordered, parts).mapInArrow(walk, schema)


def _joined(ordered: DataFrame, parts: DataFrame) -> DataFrame:
    own = ordered.select("conv_id", "block", "pos", "role", "text", "gone").join(parts.drop("conv_id"), "block")
    return own.repartition("block").sortWithinPartitions("block", "pos")


def _blocks(batches):
    """The rows of one block after another; a block has a bounded number of rows."""
    rows: list = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["block"] != row["block"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def digests(ordered: DataFrame, parts: DataFrame) -> DataFrame:
    """The contract's columns. A conversation of one block is hashed where it is repaired; of a longer one, the blocks'
    texts are put in order and stream through the hash, a row for about a million characters."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    sums = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    schema = f"conv_id {kind}, block long, at long, piece binary, whole boolean, is_last boolean, {sums}, repaired_sha256 string"
    types = _arrow(ordered.sparkSession, schema)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "full_audit")

    def piecewise(batches):
        out: list = []

        def table():
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(types)], schema=types)

        for rows in _blocks(batches):
            head = rows[0]
            lines = [f"{role}:{text}" for role, text in repaired([(r["role"], r["text"]) for r in rows if not r["gone"]], head["audit"], head["entry"])]
            own = [head[n] for n in names]
            if head["is_first"] and head["is_last"]:
                out.append((head["conv_id"], head["block"], 0, None, True, True, *own, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
                if len(out) >= 1024:
                    yield table()
                continue
            # lines carry their separator in front; the very first one is cut off by the reader
            at, piece, chars, none = 0, [], 0, [None] * 7
            for line in lines:
                piece.append("\n" + line)
                chars += len(line)
                if chars >= PIECE_CHARS:
                    out.append((head["conv_id"], head["block"], at, "".join(piece).encode(), False, False, *none, None))
                    at, piece, chars = at + 1, [], 0
                    yield table()
            out.append((head["conv_id"], head["block"], at, "".join(piece).encode(), False, head["is_last"], *own, None))
            yield table()
        yield table()

    pieces, path = durable_at(_joined(ordered, parts).mapInArrow(piecewise, schema), "repaired")
    result = f"conv_id {kind}, {sums}, repaired_sha256 string"
    out_types = _arrow(ordered.sparkSession, result)

    def stream(batches):
        digest, first = None, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if digest is None:
                    digest, first = hashlib.sha256(), True
                piece = row["piece"]
                if piece:
                    digest.update(piece[1:] if first else piece)
                    first = False
                if row["is_last"]:
                    out.append((row["conv_id"], *(row[n] for n in names[:-1]), row["audit"], digest.hexdigest()))
                    digest = None
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(out_types)], schema=out_types)

    long = pieces.where("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "block", "at").mapInArrow(stream, result)
    return pieces.where("whole").select(*long.columns).unionByName(long)


def repair(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(ordered, parts): the damaged rows in their order, and each block's part of the repair; both written to the
    shared folder. ``repaired_rows`` makes rows of them, ``digests`` the contract's columns.

    Rows of one turn stand by role, then by the first 64 characters and a hash of their text. Null roles and texts are
    one space, null turns come first, rows without conversation are one conversation. A conversation of which no
    row is left has an empty repair. Texts of any length are kept whole; a block's are held in one task. Other
    columns may have any name. An empty table gives empty tables."""
    out_of_the_way(conversations, conv_id, turn, role, text)
    small_batches(conversations.sparkSession)
    ordered, _ = durable_at(in_order(damaged(conversations, conv_id, turn, role, text), block_rows), "ordered")
    blocks, path = durable_at(block_rows_of(faults(ordered)), "blocks")
    parts, _ = durable_at(parsed_blocks(blocks), "parsed")
    discard(conversations.sparkSession, path)
    return ordered, parts


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over ``conversations``."""
    ordered, parts = repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return digests(ordered, parts)


def _after(item: str, cost: str, edit: str) -> str:
    """SQL: an item, cost in ten digits and audit, after one more edit."""
    return f"(printf('%010d', CAST(left({item}, 10) AS BIGINT) + {cost}) || substr({item}, 11) || {edit})"


def _took(item: str, role: str) -> str:
    cost = f"(CASE WHEN initial = '{role}' THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END)"
    edit = f"CASE WHEN initial = '{role}' THEN 'K' ELSE 'R' END"
    return f"(CASE WHEN fault NOT IN ('b', 'd') THEN {_after(item, cost, edit)} END)"


def _cut(item: str) -> str:
    return _after(item, "2", "'D'")


def _put(item: str) -> str:
    return _after(item, "5", "'I'")


OP11_SQL = f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM conversations, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM k JOIN (VALUES (1), (2)) c(again) ON again = 1 OR kind = 3 WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS initial, right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS final FROM d),
f AS MATERIALIZED (SELECT *, CASE WHEN final = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'd' WHEN final NOT IN ('.', '!', '?') THEN 't' ELSE '.' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS pair FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
p AS (SELECT conv_id, 0::BIGINT AS n, '0000000000' AS x0, NULL::VARCHAR AS xs, '0000000005I' AS xu, '0000000010II' AS xa FROM ids
  UNION ALL SELECT conv_id, n, y0, ys, zu, least(ya, {_put("zu")}) FROM (
    SELECT conv_id, n, y0, ys, ya, least(yu, {_put("y0")}, {_put("ys")}, {_put("ya")}) AS zu FROM (
      SELECT p.conv_id, f.n, {_cut("x0")} AS y0, least({_cut("xs")}, CASE WHEN initial = 's' THEN {_took("x0", "s")} END) AS ys,
        least({_cut("xu")}, {_took("x0", "u")}, {_took("xs", "u")}, {_took("xa", "u")}) AS yu, least({_cut("xa")}, {_took("xu", "a")}) AS ya
      FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1))),
b AS (SELECT conv_id, least(x0, xa) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
e AS (SELECT conv_id, i, substr(best, 10 + i, 1) AS edit, sum((substr(best, 10 + i, 1) <> 'I')::INT) OVER w AS n, sum((substr(best, 10 + i, 1) <> 'D')::INT) OVER w AS place
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 9)) AS i FROM b) WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
r AS (SELECT e.conv_id, e.i, edit, place, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text,
  max((place = 1 AND edit = 'K' AND f.initial = 's')::INT) OVER (PARTITION BY e.conv_id) AS led FROM e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n),
h AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS whole FROM r WHERE edit <> 'D' GROUP BY conv_id),
c AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  CAST(left(best, 10) AS BIGINT) AS cost, substr(best, 11) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM b.conv_id
"""
