import hashlib
import itertools
import random
import re
import zlib

import pytest

from lexmill.llm import conversations as C
from tests.oracle import same_rows

SMALL = "/root/testdata/sf0.001"
COLUMNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marks(rows):
    seen, out = set(), []
    for r, x in rows:
        bare = x.rstrip(" \t\n\x0b\x0c\r")
        out.append((r[:1], "blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((r, x))
    return out


def cheapest(rows):
    """Least (cost, audit) by trying every path over an own table of states: what was accepted ends in nothing, s, u or a."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "")}

    def inserted(b):
        for _, (at, role) in itertools.product(range(3), step):
            if role != "s" and at in b:
                new = (b[at][0] + 5, b[at][1] + "I")
                b[step[at, role]] = min(b.get(step[at, role], new), new)
        return b

    best = inserted(best)
    for initial, fault in rows:
        new = {}
        for at, (cost, audit) in best.items():
            options = [(at, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options += [(step[at, initial], more, "K")] if (at, initial) in step else []
                options += [(step[at, x], 1 + more, "R") for x in "ua" if (at, x) in step]
            for to, add, edit in options:
                item = (cost + add, audit + edit)
                new[to] = min(new.get(to, item), item)
        best = inserted(new)
    return min(best[x] for x in ("", "a") if x in best)


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = [r for r in damage(rows) if r[0] == c]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        if not own:
            out.append((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
            continue
        m, turns = marks([r[2:] for r in own]), [r[1] for r in own if r[1] is not None]
        cost, audit = cheapest(m)
        lines, at, left = [], "", iter(own)
        for edit in audit:
            row = next(left) if edit != "I" else None
            if edit == "D":
                continue
            role, x = (row[2], row[3]) if edit == "K" else ("assistant" if at == "u" else "user", row[3] if row else "")
            at = role[:1]
            lines.append(f"{role}:{x}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in lines))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(m))
        n = [sum(f == x for _, f in m) for x in ("blank", "duplicate", "truncated")]
        out.append((c, gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def digests(df, **kw):
    return sorted((tuple(r) for r in C.digests(*C.repair(df, **kw)).collect()), key=repr)


def conversation(r, c, n):
    roles = ["user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "cut off", "", " \t\n", None, "Why?", "One more. ", "é?"]
    return [(c, r.choice([i, i, i, i + r.randrange(3), None]), r.choice(roles[:2] if r.random() < 0.7 else roles), r.choice(texts) if r.random() < 0.4 else f"Turn {r.randrange(10**6)}.") for i in range(n)]


def test_equals_sql(spark):
    same_rows(C.op11_conversation_repair(spark, SMALL), C.OP11_SQL, SMALL)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [x for c in [*range(60), None] for x in conversation(r, c, r.randrange(1, 14))]
    df = spark.createDataFrame(r.sample(rows, len(rows)), COLUMNS).repartition(3)
    assert digests(df) == brute(rows)


@pytest.mark.parametrize("seed", range(40))
def test_chart_finds_the_cheapest_repair(seed):
    r = random.Random(seed)
    rows = [(r.choice("suatx"), r.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(r.randrange(9))]
    coded = "".join(i + {"": ".", "truncated": "t"}.get(f, "x") for i, f in rows)
    found = [x for x in (C.parse(coded)[g] for g in C.GOAL) if x is not None]
    assert min(found) == cheapest(rows)
    # and over every sequence of edits with at most two insertions
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.chain.from_iterable(itertools.combinations_with_replacement(range(len(rows) + 1), k) for k in range(3)):
            audit = "".join("I" * gaps.count(i) + e for i, e in enumerate(edits)) + "I" * gaps.count(len(rows))
            at, cost, left = "", 0, iter(rows)
            for e in audit:
                row = next(left) if e != "I" else ("", "")
                if e == "D":
                    cost += 2
                    continue
                to = row[0] if e == "K" else "a" if at == "u" else "u"
                if e != "I" and row[1] in ("blank", "duplicate") or (at, to) not in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    cost = None
                    break
                cost += {"K": 0, "R": 1, "I": 5}[e] + (5 if row[1] == "truncated" else 0)
                at = to
            if cost is not None and at in ("", "a"):
                best = min(best or (cost, audit), (cost, audit))
    assert len(rows) > 6 or best == min(found)


def test_long_conversations_are_parsed_in_blocks(spark):
    r = random.Random(7)
    rows = conversation(r, 1, 900) + conversation(r, 2, 150) + [(3, 0, "user", "Same.")] * 200 + conversation(r, 4, 3)
    df = spark.createDataFrame(r.sample(rows, len(rows)), COLUMNS).repartition(4)
    ordered, parts = C.repair(df, block_rows=16)
    assert parts.where("conv_id = 1").count() > 30
    # conversations 1 and 2 have ties of turn, role and text alike only
    assert sorted((tuple(x) for x in C.digests(ordered, parts).collect()), key=repr) == brute(rows)


def test_blocks_of_any_size_give_one_repair():
    r = random.Random(3)
    for _ in range(200):
        rows = "".join(r.choice("suax") + r.choice("...xt") for _ in range(r.randrange(1, 30)))
        paths, at = [C._Path(None, 0, None, None, ""), None, None, None], 0
        while at < len(rows):
            size = 2 * r.randrange(1, 5)
            paths = C.chain(paths, at, [C.parse(rows[at : at + size], s) for s in range(4)])
            at += size
        for goal, item in enumerate(C.parse(rows)):
            assert (paths[goal] is None) == (item is None)
            if item:
                path, audit = paths[goal], []
                while path.back is not None:
                    audit.append(path.audit)
                    path = path.back
                assert (paths[goal].cost, "".join(reversed(audit))) == item


def test_pieces_of_long_texts(spark, monkeypatch):
    rows = [(1, i, ("user", "assistant")[i % 2], f"{i} " + "word " * 20_000 + ".") for i in range(40)]
    monkeypatch.setattr(C, "PIECE_CHARS", 1000)
    assert digests(spark.createDataFrame(rows, COLUMNS).repartition(3), block_rows=7) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert digests(spark.createDataFrame([], COLUMNS)) == []
    rows = conversation(random.Random(1), 5, 12)
    df = spark.createDataFrame(rows, COLUMNS).selectExpr("*", "1 AS block", "2 AS pos", "3 AS gone", "4 AS cost", "5 AS kind")
    assert digests(df) == brute(rows)


def test_repaired_rows_follow_the_grammar(spark):
    r = random.Random(11)
    rows = [x for c in range(20) for x in conversation(r, c, 10)]
    ordered, parts = C.repair(spark.createDataFrame(rows, COLUMNS), block_rows=4)
    found = C.repaired_rows(ordered, parts).orderBy("conv_id", "block", "at").collect()
    for c in range(20):
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in found if x["conv_id"] == c))
