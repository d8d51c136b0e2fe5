"""Audit and repair of conversations against all edits of small ones and a plain program for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from marketlens.llm import conversation_repair as cr

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows):
    found = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        found += [(conv, turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    return found


def faults(rows):
    """Sorted rows of one conversation with their first fault."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, found = set(), []
    for _, turn, role, text in rows:
        body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((turn, role, text, fault))
    return found


def every_repair(rows):
    """The best of all edits of a small conversation: at most two insertions in a place help."""
    inserted = [""] + [x + y for x in ("", "u", "a") for y in ("u", "a")]
    names = {"u": "user", "a": "assistant"}
    choices = []
    for _, role, text, fault in rows:
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            extra = 5 if fault == "truncated" else 0
            own += [("K", extra, (role, text)), ("R", 1 + extra, ("user", text)), ("R", 1 + extra, ("assistant", text))]
        choices.append(own)
    best = None
    for edits in itertools.product(*choices):
        for gaps in itertools.product(inserted, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for k, gap in enumerate(gaps):
                cost, audit = cost + 5 * len(gap), audit + "I" * len(gap)
                lines += [(names[g], "") for g in gap]
                if k < len(rows):
                    letter, price, line = edits[k]
                    cost, audit = cost + price, audit + letter
                    lines += [line] if line else []
            if all(len(r) for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)):
                offer = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                best = offer if best is None or offer < best else best
    return best


def plain_repair(rows):
    """The same by whole strings, row by row."""
    held = {"": (0, "", ()), "u": (5, "I", (("user", ""),)), "a": (10, "II", (("user", ""), ("assistant", "")))}
    for _, role, text, fault in rows:
        new = {}

        def offer(state, value):
            if state not in new or value < new[state]:
                new[state] = value

        for state, (cost, audit, lines) in held.items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            for letter, price, name in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                if (state, name[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    offer(name[:1], (cost + price + extra, audit + letter, lines + ((name, text),)))
        for state in ("", "s", "a"):
            if state in new:
                cost, audit, lines = new[state]
                offer("u", (cost + 5, audit + "I", lines + (("user", ""),)))
        if "u" in new:
            cost, audit, lines = new["u"]
            offer("a", (cost + 5, audit + "I", lines + (("assistant", ""),)))
        held = new
    cost, audit, lines = min(held[s] for s in ("", "a") if s in held)
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)


def expected(rows, repair=plain_repair, damage=True):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in damaged(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]:
        convs[r[0]].append(r)
    found = {}
    for conv, own in convs.items():
        if not own:
            found[conv] = (0, 0, 0, 0, 0, 0, "", EMPTY)
            continue
        own = faults(own)
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == name for *_, f in own) for name in ("blank", "duplicate", "truncated")]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = repair(own)
        found[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def found(df, **options):
    out = cr.audit_conversations(df, **options)
    assert out.columns == ["conv_id", *cr.RESULT]
    rows = out.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \t", "Yes.", "A line.\nand", "Ends. \n"]


def rows_of(seed, convs, longest, turns=None):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        turn = rng.randrange(3)
        for _ in range(rng.randrange(longest + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c, rng.choice([turn, turn, None]) if turns is None else turn, role, rng.choice([*TEXTS, None, f"Number {rng.random()}."])))
            turn += rng.choice([0, 1, 1, 1, 2, 5])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("damage", [True, False])
def test_like_every_edit(frame, damage):
    rows = rows_of(1, 60, 3)
    assert found(frame(rows, SCHEMA), damage=damage) == expected(rows, every_repair, damage)


def test_like_plain_program(frame):
    rows = rows_of(2, 150, 9)
    assert found(frame(rows, SCHEMA).repartition(5)) == expected(rows)


@pytest.mark.parametrize("damage", [True, False])
def test_long_conversations_in_many_partitions(spark, frame, damage):
    rows = rows_of(3, 2, 400, turns=True) + [(7, 1, "user", "Same.")] * 300 + [(None, None, "assistant", "x")] * 50
    df = frame(rows, SCHEMA)
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "16")
    try:
        assert cr.segments(cr._seen_before(cr.damaged(df, *df.columns).filter("uid IS NOT NULL")), "bigint").groupBy("conv").count().agg({"count": "max"}).first()[0] > 3
        assert found(df, damage=damage) == expected(rows, damage=damage)
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_texts_that_are_not_held(frame, monkeypatch):
    rows = rows_of(4, 40, 6)
    want = expected(rows)
    monkeypatch.setattr(cr.Segment, "HELD", 3)
    assert found(frame(rows, SCHEMA)) == want


def test_empty_table_clashing_names_and_dropped_conversation(frame):
    assert found(frame([], SCHEMA)) == {}
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = frame([(gone, 0, "user", "Yes.", "x", 1)], SCHEMA + ", audit string, conv int")
    assert found(df) == {gone: (0, 0, 0, 0, 0, 0, "", EMPTY)}


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7, 1])
def test_order_of_audits(monkeypatch, modulus):
    """Whatever the hashes say, letters decide."""
    monkeypatch.setattr(cr, "MODULUS", modulus)
    rng = random.Random(5)
    nodes = [cr.Node(None, "")]
    for _ in range(600):
        nodes.append(cr.Node(rng.choice(nodes[-20:]), rng.choice("DIK")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        if a.text() != b.text():
            assert cr.before(a, b) == (a.text() < b.text())
        else:
            assert not cr.before(a, b)
