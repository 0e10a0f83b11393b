"""Repairs against all sequences of edits, and against a plain table per conversation."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallygrove.llm import turn_repair as tr

SCHEMA = "conv_id bigint, turn bigint, role string, text string, copies int, audit string, ckey int"


@pytest.fixture()
def table(spark):
    def build(*rows):
        return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], SCHEMA).repartition(3)

    return build


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def in_order(rows):
    """Rows by conversation, with their faults."""
    out = {}
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        out.setdefault(c, []).append((turn is not None, turn or 0, role.encode(), digest(role, text), role, text, turn))
    for c, found in out.items():
        found.sort()
        seen, marked = set(), []
        for *_, role, text, turn in found:
            visible = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, turn, fault))
        out[c] = marked
    return out


def by_table(rows):
    """(cost, audit, repaired rows) by a plain table over positions and states."""
    inserts = {(a, b): c for a, b, *c in [(0, 2, "u"), (1, 2, "u"), (3, 2, "u"), (2, 3, "a"), (0, 3, "u", "a"), (1, 3, "u", "a")]}
    inserts |= {(a, a): [] for a in range(4)}
    names = {"u": ("user", ""), "a": ("assistant", "")}

    def grown(best):
        new = {}
        for a, (cost, audit, out) in best.items():
            for (x, b), made in inserts.items():
                if x == a:
                    cell = (cost + 3 * len(made), audit + "I" * len(made), [*out, *[names[m] for m in made]])
                    new[b] = min(new.get(b, cell), cell)
        return new

    best = {0: (0, "", [])}
    for role, text, _, fault in rows:
        new = {}

        def offer(state, cell):
            new[state] = min(new.get(state, cell), cell)

        for a, (cost, audit, out) in grown(best).items():
            offer(a, (cost + 4, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more, to = 3 * (fault == "truncated"), {0: 2, 1: 2, 2: 3, 3: 2}[a]
            offer(to, (cost + 3 + more, audit + "R", [*out, ({2: "user", 3: "assistant"}[to], text)]))
            if a == 0 and role[:1] == "s":
                offer(1, (cost + more, audit + "K", [*out, (role, text)]))
            if role[:1] == {2: "u", 3: "a"}[to]:
                offer(to, (cost + more, audit + "K", [*out, (role, text)]))
        best = new
    return min(v for k, v in grown(best).items() if k in (0, 3))


def by_trial(rows):
    """(cost, audit) among all sequences with at most two inserts at a place."""
    best = None
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for *_, f in rows]
    places = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*options):
        for gaps in itertools.product(places, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for gap, e, row in itertools.zip_longest(gaps, edits, rows):
                roles, audit, cost = roles + "".join(gap), audit + "I" * len(gap), cost + 3 * len(gap)
                if e:
                    roles += {"D": "", "K": (row[0] or "?")[:1]}.get(e, e[1:])
                    audit += e[0]
                    cost += {"D": 4, "K": 0}.get(e, 3) + 3 * (e != "D" and row[3] == "truncated")
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def random_rows(rng, n, turns=None):
    out = []
    for i in range(n):
        role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "Usr"])
        text = rng.choice(["Fine.", "Fine.", "Cut", "", " \n", "Yes! \t", "Who?", None, "naïve…", "é.", f"n{rng.randrange(9)}."])
        out.append((rng.choice(turns or [None, 0, 1, 2, 3, 5, 8, 8, 20]), role, text))
    return out


def wanted(rows):
    out = {}
    for c, marked in in_order(rows).items():
        turns = [t for _, _, t, _ in marked if t is not None]
        count = [sum(f == name for *_, f in marked) for name in ("blank", "duplicate", "truncated")]
        initials = [r[:1] for r, *_ in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, repaired = by_table(marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[c] = (gaps, *count, illegal, cost, audit, sha)
    return out


def test_plain_table_finds_the_least():
    rng = random.Random(4)
    for _ in range(60):
        rows = in_order([(1, *r) for r in random_rows(rng, rng.randrange(1, 4))])[1]
        assert by_table(rows)[:2] == by_trial(rows)


def check(df, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in tr.repair(df, tr.turns(df)).collect()}
    assert got == wanted(rows)


def test_random(table):
    rng = random.Random(5)
    rows = [(c, *r) for c in [None, *range(200)] for r in random_rows(rng, rng.randrange(1, 12))]
    check(table(*rows), rows)


def test_long_conversations(spark, table, monkeypatch):
    """Chunks of a conversation, in several tasks, and long runs of equal rows."""
    monkeypatch.setattr(tr, "CHUNK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(6)
    rows = [(1, *r) for r in random_rows(rng, 900, list(range(600)))] + [(2, 3, "user", "same.")] * 100
    rows += [(c, t, ["user", "assistant"][t % 2], f"t{t}.") for c in range(3, 60) for t in range(20)]
    try:
        check(table(*rows), rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_turns_and_edits(table):
    df = table((1, 0, "assistant", "A."), (1, 1, "user", "Q?"), (2, 0, "system", "S."), (2, 1, "user", "Q"), (2, 2, "assistant", ""))
    planned = tr.plan(tr.turns(df))
    got = {}
    for r in tr.repaired_turns(tr.turns(df), planned).orderBy("ckey", "position").collect():
        got.setdefault(r["ckey"], []).append((r["role"], r["text"], r["edit"]))
    for c, marked in in_order([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]).items():
        assert [x[:2] for x in got.get(f"={c}", [])] == by_table(marked)[2]


def test_damage(table):
    rows = [(c, t, "assistant", "One. Two! x?") for c in [None, *range(40)] for t in [None, 0, 1, 2]] + [(50, 1, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text, role = (text or " "), (role or " ")
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            want.append((c, t, "user" if kind == 4 else role, text, 2 if kind == 3 else 1))
    assert sorted(map(str, map(tuple, tr.damage(table(*rows)).collect()))) == sorted(map(str, want))


def test_nothing_left(table):
    df = table((1, 0, "user", "x"))
    none = tr.turns(df).filter("false")
    sha = hashlib.sha256(b"").hexdigest()
    assert list(map(tuple, tr.repair(df, none).collect())) == [(1, 0, 0, 0, 0, 0, 0, "", sha)]
    assert tr.repair(df.filter("false"), none).count() == 0


def test_grammar_keeps_results():
    """The rules shorten the strings, and a string means the same with and without them."""
    rng = random.Random(7)
    strings = ["".join(rng.choice("abcdefgjkl") for _ in range(rng.randrange(1, 40))) for _ in range(200)] + ["dg" * 2000, "f" * 999]
    rules, left = [], strings
    for r in range(6):
        pairs = {}
        for s in left:
            for i in range(len(s) - 1):
                pairs[s[i : i + 2]] = pairs.get(s[i : i + 2], 0) + 1
        rules.append({p: chr(tr.FIRST_RULE + 100 * r + i) for i, p in enumerate(sorted(pairs, key=lambda p: (-pairs[p], p))[:100])})
        left = [tr.replace(s, rules[-1]) for s in left]
    assert sum(map(len, left)) < 0.5 * sum(map(len, strings))
    table = tr.evaluate(rules)
    for s in strings:
        with_rules, without = tr.Fold(rules, table), tr.Fold([], table)
        with_rules.add(s)
        for i in range(0, len(s), 7):
            without.add(s[i : i + 7])
        assert with_rules.result() == without.result()


def test_ropes():
    rng = random.Random(8)
    for _ in range(300):
        parts = ["".join(rng.choice("DK") for _ in range(rng.randrange(12))) for _ in range(6)]

        def grow():
            rope = ""
            for _ in range(rng.randrange(1, 6)):
                part = rng.choice(parts)
                rope = tr.join(rope, part) if rng.random() < 0.5 else tr.join(part, rope)
            return rope

        a, b = grow(), grow()
        assert tr.before(a, b) == (tr.text_of(a) < tr.text_of(b)) and tr.size(a) == len(tr.text_of(a))
