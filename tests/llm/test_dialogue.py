"""Conversation repair against a plain search over whole edit sequences."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from langatlas.llm import dialogue as D
from langatlas.llm.queries import op11_conversation_repair
from langatlas.llm.sha256state import Sha256, _by_rounds, START
from tests.llm.helpers import SF

SCHEMA = ("conv_id bigint, turn bigint, role string, text string, sig string, part int, "
          "state int, present boolean, audit string")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows, present=True):
    return spark.createDataFrame([(*r, "s", 1, 2, present, "a") for r in rows],
                                 SCHEMA).repartition(5)


def damaged(rows):
    kept = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(key.encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            kept += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return kept


GRAMMAR = re.compile("(s?(ua)+)?")


def moves(state):
    """Roles that may be added to initials ``state`` (its grammar state)."""
    return {"": "u", "s": "u", "u": "a", "a": "u"}[state]


def cheapest(rows, faults):
    """Least (cost, audit) and what it leaves, by a search over (row, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, left = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in ("", "a"):
            assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in left))
            return cost, audit, left
        new = "user" if moves(state) == "u" else "assistant"
        heapq.heappush(heap, (cost + 2, audit + "I", at, new[0], left + ((new, ""),)))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, left))
            if faults[at] not in ("blank", "duplicate"):
                more = cost + (faults[at] == "truncated")
                heapq.heappush(heap, (more + 2, audit + "R", at + 1, new[0],
                                      left + ((new, text),)))
                if role[:1] == moves(state) or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (more, audit + "K", at + 1, role[:1],
                                          left + ((role, text),)))


def brute(rows, convs):
    by = {c: [] for c in convs}
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or " " if role is None else role,
                         " " if text is None else text))
    out = []
    for conv, kept in by.items():
        kept.sort()
        said = [(role, text) for *_, role, text in kept]
        faults, seen = [], set()
        for role, text in said:
            tail = text.rstrip(SPACE)
            faults.append("blank" if not tail else "duplicate" if (role, text) in seen
                          else "truncated" if tail[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for known, t, *_ in kept if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
        cost, audit, left = cheapest(said, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def answer(repaired):
    found, hashed = repaired.conversations, D.digests(repaired)
    joined = found.join(hashed, found["conv_id"].eqNullSafe(hashed["conv_id"])).drop(
        hashed["conv_id"])
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated",
                                        "illegal", "cost", "audit", "sha256"))
                   for r in joined.collect()), key=str)


def some_rows(seed, convs, longest=9):
    r = random.Random(seed)
    texts = ["Yes.", "no", "", " \t", "What? ", "So on...\n", "fine!", "漢字。", None, "x" * 300 + "."]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", None, "", "User", "sys", "a"]
    return [(c, r.choice([None, t, t, t, t + r.randint(0, 3)]), r.choice(roles), r.choice(texts))
            for c in convs for t in range(r.randint(1, longest))]


def test_least_audits_of_all_short_signatures():
    signs = [D.symbol(c, f) for c in range(4) for f in (D.CLEAN, D.TRUNCATED, D.BLANK)]
    names, automaton = ["system", "user", "assistant", "tool"], D.SuffixAutomaton(depth=2)
    words = ["".join(w) for n in range(4) for w in itertools.product(signs, repeat=n)]
    faults = {D.CLEAN: "", D.TRUNCATED: "truncated", D.BLANK: "blank"}
    for back in sorted(w[::-1] for w in words):
        automaton.read(back)
        rows = [D.parts(s) for s in back[::-1]]
        cost, audit, _ = cheapest([(names[c], "t") for c, _ in rows], [faults[f] for _, f in rows])
        assert (automaton.nodes[-1].costs[0], automaton.audit()) == (cost, audit)


def test_long_signatures_share_the_text_of_their_ends():
    r = random.Random(6)
    for n in (1, 63, 64, 65, 300):
        rows = [(r.choice(["user", "assistant", "system"]), "t") for _ in range(n)]
        faults = [r.choice(["", "", "", "truncated", "blank"]) for _ in rows]
        sig = "".join(D.symbol(D.role_class(a), {"": 0, "truncated": 1, "blank": 3}[f])
                      for (a, _), f in zip(rows, faults))
        automaton = D.SuffixAutomaton()
        automaton.read(sig[::-1])
        assert (automaton.nodes[-1].costs[0], automaton.audit()) == cheapest(rows, faults)[:2]


@pytest.mark.parametrize("limits", [(512, 1 << 20), (3, 1 << 20), (512, 200)])
def test_repair_equals_brute_force(spark, limits):
    rows = some_rows(1, [*range(60), None])
    rows += rows[:25]                                  # repeated rows
    got = answer(D.repair(frame(spark, rows), chunk_rows=limits[0], chunk_bytes=limits[1]))
    assert got == brute(rows, {r[0] for r in rows})


def test_one_conversation_over_many_partitions(spark):
    r = random.Random(2)
    rows = some_rows(3, range(40)) + [
        (7, t, r.choice(["user", "assistant"]), r.choice(["ok.", "hm", f"line {t % 400}.", ""]))
        for t in range(1000)] + [(7, 5, "user", "ok.")] * 300
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        repaired = D.repair(frame(spark, rows), chunk_rows=50)
        legs = repaired.chunks.where("conv_id = 7").select("part").distinct().count()
        assert legs >= 4
        assert answer(repaired) == brute(rows, {r[0] for r in rows})
    finally:
        spark.conf.unset(key)


def test_messages_are_the_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Again?"),
            (1, 3, "assistant", "Yes")]
    got = [(m["role"], m["text"]) for m in D.messages(D.repair(frame(spark, rows))).orderBy(
        "part", "no", "place").collect()]
    assert got == [("user", "Hi."), ("assistant", ""), ("user", "Again?"), ("assistant", "Yes")]
    ((_, _, *counts, audit, _),) = answer(D.repair(frame(spark, rows)))
    assert (counts, audit) == ([0, 1, 1, 2, 6], "KDIKK")


def test_absent_rows_name_their_conversation(spark):
    got = answer(D.repair(frame(spark, [(3, 1, "user", "x"), (None, 2, None, None)], False),
                          present_col="present"))
    empty = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c in (3, None)], key=str)
    assert answer(D.repair(frame(spark, []))) == []


def test_extreme_turns(spark):
    rows = [(1, -2 ** 63, "user", "a."), (1, 2 ** 63 - 1, "assistant", "b.")]
    assert answer(D.repair(frame(spark, rows)))[0][1] == 2 ** 63 - 1


def test_damage(spark):
    rows = some_rows(4, [*range(30), None])
    got = [(r["conv_id"], r["turn"], r["role"], r["text"])
           for r in D.damage(frame(spark, rows)).where("present").collect()]
    assert sorted(got, key=str) == sorted(damaged(rows), key=str)


def test_query_on_the_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in op11_conversation_repair(spark, SF).collect()), key=str)
    assert got == brute(damaged(rows), {r[0] for r in rows})


def test_digest_goes_on_from_its_state():
    r = random.Random(8)
    for n in (0, 1, 55, 56, 63, 64, 65, 500):
        data, digest = r.randbytes(n), Sha256()
        for at in range(0, n, 37):
            digest = Sha256(digest.state())
            digest.update(data[at:at + 37])
        assert digest.hexdigest() == hashlib.sha256(data).hexdigest()
        plain = Sha256()
        plain.words, full = START, n // 64 * 64
        plain.words, plain.size, plain.rest = _by_rounds(START, data[:full]), n, data[full:]
        assert plain.hexdigest() == hashlib.sha256(data).hexdigest()
