"""Conversation structure repair over a suffix-shared automaton.

Every row is one symbol: its role's initial (s, u, a or another) and its first
fault (none, truncated, duplicate, blank).  A conversation's symbols are its
signature, and what its repair costs depends on nothing else.  So repair is
solved once per signature, and, as the cheapest way on from a place depends on
the symbols after it alone, once per signature *suffix*: signatures are sorted
from their ends, and neighbours share the automaton nodes of their common
suffix.  A node holds, for each of four grammar states, the cost to go and the
best audit suffix.

States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an
assistant row; 0 and 3 may end.  From a state each edit leads to one state only
(an inserted or rewritten role is the one that may come next), so the least
audit of equal cost is found letter by letter.

Rows are range-sorted by conversation and turn and cut into chunks: at most
``CHUNK_ROWS`` rows or ``CHUNK_BYTES`` bytes of one conversation in one
partition.  A conversation that is whole in one chunk (nearly all are) is done
there.  The others ("open") may span any number of partitions: their duplicates
are settled by one aggregate over (conversation, digest), their chunks' short
signatures meet in one row -- a byte a message, as the audit itself -- and their
messages never meet in one task: the digest goes from partition to partition.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from langatlas.llm.common import stage
from langatlas.llm.sha256state import Sha256

CHUNK_ROWS = 512
CHUNK_BYTES = 1 << 20
#: Nodes up to this depth hold their best audit suffixes as text; a longer audit
#: is read off letter by letter down to there.
SUFFIX_DEPTH = 64
#: Characters of role and text that the range bounds may hold.
KEY_CHARS = 64

# Costs of the edits, states and their moves.
DELETE, REROLE, INSERT, CUT_SHORT = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
CLEAN, TRUNCATED, DUPLICATE, BLANK = range(4)
SYSTEM, USER, ASSISTANT, OTHER = range(4)
#: The state after the role that an insertion or a new role brings.
MOVE = (2, 2, 3, 2)
#: The state after a kept row of a class; none where it may not stand.
KEEP = ({SYSTEM: 1, USER: 2}, {USER: 2}, {ASSISTANT: 3}, {USER: 2})
NAME = {2: "user", 3: "assistant"}
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def role_class(role: str) -> int:
    return "sua".find(role[0]) % 4 if role else OTHER


def symbol(cls: int, fault: int) -> str:
    return chr(ord("A") + 4 * cls + fault)


def parts(sign: str) -> tuple[int, int]:
    return divmod(ord(sign) - ord("A"), 4)


# --------------------------------------------------------------------- automaton
class Node:
    """One suffix: cost to go, first letter and (if short) audit for every state,
    and the counts of its faults."""

    __slots__ = ("costs", "letters", "audits", "counts", "cls")

    def __init__(self, costs, letters, audits, counts, cls) -> None:
        self.costs, self.letters, self.audits = costs, letters, audits
        self.counts, self.cls = counts, cls


END = Node((0, 2 * INSERT, INSERT, 0), "\0II\0", ("", "II", "I", ""), (0, 0, 0, 0), None)


def _before(sign: str, after: Node, deep: bool) -> Node:
    """The node of ``sign`` followed by the suffix of ``after``."""
    cls, fault = parts(sign)
    short = CUT_SHORT * (fault == TRUNCATED)
    ways: list[dict[str, int]] = []
    for state in range(4):
        way = {"D": DELETE + after.costs[state]}
        if fault in (CLEAN, TRUNCATED):
            if cls in KEEP[state]:
                way["K"] = short + after.costs[KEEP[state][cls]]
            way["R"] = REROLE + short + after.costs[MOVE[state]]
        ways.append(way)
    least = [min(w.values()) for w in ways]
    costs = [0] * 4
    costs[2] = min(least[2], INSERT + least[3])
    costs[3] = min(least[3], INSERT + least[2])
    for state in (0, 1):
        costs[state] = min(least[state], INSERT + costs[2])
    letters = ""
    for state in range(4):
        way = ways[state] | {"I": INSERT + costs[MOVE[state]]}
        letters += min(x for x, cost in way.items() if cost == costs[state])
    audits = None
    if not deep:
        found: dict[int, str] = {}
        # An inserted row is never followed by another: the state it leads to has
        # its audit by then.
        for state in sorted(range(4), key=lambda s: (letters[s] == "I", s not in (2, 3))):
            x = letters[state]
            found[state] = x + (found[MOVE[state]] if x == "I" else after.audits[
                {"D": state, "K": KEEP[state].get(cls), "R": MOVE[state]}[x]])
        audits = tuple(found[s] for s in range(4))
    blank, duplicate, truncated, illegal = after.counts
    illegal += after.cls is not None and (cls, after.cls) not in LEGAL
    counts = (blank + (fault == BLANK), duplicate + (fault == DUPLICATE),
              truncated + (fault == TRUNCATED), illegal)
    return Node(tuple(costs), letters, audits, counts, cls)


class SuffixAutomaton:
    """Nodes of the last signature's suffixes; the next one keeps those it shares."""

    def __init__(self, depth: int = SUFFIX_DEPTH) -> None:
        self.nodes, self.word, self.depth = [END], "", depth

    def read(self, backwards: str) -> None:
        same = len(os.path.commonprefix([self.word, backwards]))
        del self.nodes[same + 1:]
        for sign in backwards[same:]:
            self.nodes.append(_before(sign, self.nodes[-1], len(self.nodes) > self.depth))
        self.word = backwards

    def audit(self) -> str:
        at, state, out = len(self.nodes) - 1, 0, []
        while self.nodes[at].audits is None:
            x = self.nodes[at].letters[state]
            out.append(x)
            if x == "I":
                state = MOVE[state]
                continue
            if x != "D":
                state = KEEP[state][self.nodes[at].cls] if x == "K" else MOVE[state]
            at -= 1
        return "".join(out) + self.nodes[at].audits[state]


SOLVED = ("sig string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
          "cost bigint, audit string")


def solve(signatures: DataFrame) -> DataFrame:
    """One row per row of ``signatures`` (``sig``): fault counts, cost and audit.
    Signatures of one end stand side by side in one task; a task's nodes are
    those of one signature at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            rows = []
            for back in batch.column("back").to_pylist():
                automaton.read(back)
                top = automaton.nodes[-1]
                rows.append((back[::-1], *top.counts, top.costs[0], automaton.audit()))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()),
                 *(pa.array(c, pa.int64()) for c in columns[1:6]),
                 pa.array(columns[6], pa.string())],
                names=["sig", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    back = F.reverse("sig").alias("back")
    return (signatures.select(back).withColumn("key", F.substring("back", 1, KEY_CHARS))
            .repartitionByRange("key").sortWithinPartitions("back").select("back")
            .mapInArrow(run, SOLVED))


# ------------------------------------------------------------------------ chunks
class _Chunk:
    def __init__(self, conv, no: int) -> None:
        self.conv, self.no, self.bytes = conv, no, 0
        self.sig, self.roles, self.texts, self.firsts = [], [], [], []
        self.first_turn = self.last_turn = None
        self.new_turns = 0


def _chunks(rows: Iterator[tuple], most_rows: int,
            most_bytes: int) -> Iterator[tuple[_Chunk, bool]]:
    """Chunks of sorted (conv, turn, role, text, present) rows, and whether their
    conversation may go on outside."""
    chunk, first_conv, conv_first_no, turn_before, seen = None, True, 0, None, set()
    for conv, turn, role, text, present in rows:
        if chunk is None or (conv is None) != (chunk.conv is None) or conv != chunk.conv:
            if chunk is not None:
                yield chunk, first_conv or chunk.no > conv_first_no
                first_conv = False
            chunk = _Chunk(conv, 0 if chunk is None else chunk.no + 1)
            conv_first_no, turn_before, seen = chunk.no, None, set()
        elif len(chunk.sig) >= most_rows or chunk.bytes >= most_bytes:
            yield chunk, True
            chunk = _Chunk(conv, chunk.no + 1)
        if not present:
            continue
        digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        said = text.rstrip(SPACE)
        fault = (BLANK if not said else DUPLICATE if digest in seen
                 else CLEAN if said[-1] in ".!?" else TRUNCATED)
        if digest not in seen:
            seen.add(digest)
            if fault != BLANK:
                chunk.firsts.append({"i": len(chunk.sig), "digest": digest})
        chunk.sig.append(symbol(role_class(role), fault))
        chunk.roles.append(role)
        chunk.texts.append("" if fault in (BLANK, DUPLICATE) else text)
        chunk.bytes += len(role) + len(text)
        if turn is not None:
            chunk.first_turn = turn if chunk.first_turn is None else chunk.first_turn
            chunk.last_turn = turn
            chunk.new_turns += turn != turn_before
            turn_before = turn
    if chunk is not None:
        yield chunk, True


def cut_chunks(rows: DataFrame, most_rows: int = CHUNK_ROWS,
               most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Staged chunk rows of ``conv_id, turn, role, text, present`` rows (no nulls in
    the last three)."""
    conv_type = rows.schema["conv_id"].dataType
    firsts = T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()),
                                       T.StructField("digest", T.BinaryType())]))
    schema = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("part", T.IntegerType()),
        T.StructField("no", T.IntegerType()), T.StructField("open", T.BooleanType()),
        T.StructField("sig", T.StringType()), T.StructField("first_turn", T.LongType()),
        T.StructField("last_turn", T.LongType()), T.StructField("new_turns", T.LongType()),
        T.StructField("roles", T.ArrayType(T.StringType())),
        T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("firsts", firsts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        conv_arrow = None

        def stream() -> Iterator[tuple]:
            nonlocal conv_arrow
            for batch in batches:
                conv_arrow = batch.schema.field("conv_id").type
                for at in range(0, batch.num_rows, 512):
                    cut = batch.slice(at, 512)
                    yield from zip(*(cut.column(c).to_pylist()
                                     for c in ("conv_id", "turn", "role", "text", "present")))

        def batch_of(held: list[tuple[_Chunk, bool]]) -> pa.RecordBatch:
            strings, number = pa.list_(pa.string()), pa.int64()
            chunks = [c for c, _ in held]
            return pa.RecordBatch.from_arrays([
                pa.array([c.conv for c in chunks], conv_arrow),
                pa.array([part] * len(held), pa.int32()),
                pa.array([c.no for c in chunks], pa.int32()), pa.array([o for _, o in held]),
                pa.array(["".join(c.sig) for c in chunks]),
                pa.array([c.first_turn for c in chunks], number),
                pa.array([c.last_turn for c in chunks], number),
                pa.array([c.new_turns for c in chunks], number),
                pa.array([c.roles for c in chunks], strings),
                pa.array([c.texts for c in chunks], strings),
                pa.array([c.firsts if o else [] for c, o in held], pa.list_(pa.struct(
                    [("i", pa.int32()), ("digest", pa.binary())])))], names=schema.names)

        held, size = [], 0
        for chunk, is_open in _chunks(stream(), most_rows, most_bytes):
            held.append((chunk, is_open))
            size += chunk.bytes
            if size >= CHUNK_BYTES or len(held) >= 4096:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    # Ties of one turn: by role, then text (the start of long ones, then a digest).
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(),
            F.col("role_key"), F.col("text_key"), F.col("digest"), F.col("tie")]
    return stage(rows.select(
        "*", F.substring("role", 1, KEY_CHARS).alias("role_key"),
        F.substring("text", 1, KEY_CHARS).alias("text_key"),
        F.md5(F.concat_ws("\0", "role", "text").cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("tie"))       # equal rows may be parted, too
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
        .select("conv_id", "turn", "role", "text", "present").mapInArrow(run, schema), "chunks")


# ------------------------------------------------------------------------ repair
@dataclass
class Repaired:
    """``conversations``: one row each; ``chunks``: the repaired messages in order,
    as arrays (``conv_id, part, no, open, roles, texts``)."""

    conversations: DataFrame
    chunks: DataFrame


def _same(a: DataFrame, b: DataFrame, *more: str):
    on = a["conv_id"].eqNullSafe(b["conv_id"])
    for c in more:
        on = on & (a[c] == b[c])
    return on


def _settle_duplicates(chunks: DataFrame) -> DataFrame:
    """Open chunks with the faults of rows that an earlier partition has, too.  A
    digest counts once a partition, so a key has as many rows as partitions."""
    place = F.struct("part", "no", "i")
    rows = chunks.select("conv_id", "part", "no", F.explode("firsts").alias("f")).select(
        "conv_id", "part", "no", "f.i", "f.digest")
    first = rows.groupBy("conv_id", "digest").agg(F.min(place).alias("first"))
    late = (rows.join(first, _same(rows, first, "digest"))
            .where(place != F.col("first")).select(rows["part"], rows["no"], rows["i"])
            .groupBy("part", "no").agg(F.collect_list("i").alias("late")))

    def marked(sig, i):
        cls = F.floor((F.ascii(F.substring(sig, i + 1, 1)) - ord("A")) / 4)
        return F.overlay(sig, F.char(cls * 4 + ord("A") + DUPLICATE), i + 1, 1)

    late_or_none = F.coalesce("late", F.array().cast("array<int>"))
    return (chunks.join(late, ["part", "no"], "left")
            .withColumn("sig", F.aggregate(late_or_none, F.col("sig"), marked)))


def _gaps(first, last, distinct):
    """Turns missing between the first and the last (beyond a long: its maximum)."""
    wide = (last.cast("decimal(20,0)") - first.cast("decimal(20,0)") + 1
            - distinct.cast("decimal(20,0)"))
    most = F.lit(2 ** 63 - 1)
    return (F.when(wide.isNull(), F.lit(0).cast("bigint")).when(wide > most, most)
            .otherwise(wide.try_cast("bigint")).alias("gaps"))


def _gathered(chunks: DataFrame) -> DataFrame:
    """Open conversations: ``conv_id, sig, gaps, pieces``."""
    piece = F.struct("part", "no", F.length("sig").alias("n"), "sig", "first_turn", "last_turn",
                     "new_turns")
    rows = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.when(F.length("sig") > 0, piece))).alias("pieces"))
    n = F.greatest(F.size("pieces") - 1, F.lit(0))
    # A turn on both sides of a partition's end was counted twice.
    twice = F.size(F.filter(
        F.zip_with(F.slice("pieces", 1, n), F.slice("pieces", 2, n),
                   lambda a, b: (a["part"] != b["part"]) & (a["last_turn"] == b["first_turn"])),
        lambda x: x))
    each = lambda c: F.transform("pieces", lambda p: p[c])
    distinct = F.aggregate(each("new_turns"), F.lit(0).cast("bigint"), lambda a, b: a + b) - twice
    return rows.select(
        "conv_id", F.array_join(each("sig"), "").alias("sig"),
        _gaps(F.array_min(each("first_turn")), F.array_max(each("last_turn")), distinct),
        F.transform("pieces", lambda p: F.struct(p["part"], p["no"], p["n"])).alias("pieces"))


def _split_audits(gathered: DataFrame) -> DataFrame:
    """``part, no, audit, state``: the edits of each piece of ``pieces`` and the
    grammar state before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sig, audit, pieces in zip(*(batch.column(c).to_pylist()
                                            for c in ("sig", "audit", "pieces"))):
                at = row = state = 0
                for k, piece in enumerate(pieces):
                    begun, entered, stop = at, state, row + piece["n"]
                    while at < len(audit) and (row < stop or k == len(pieces) - 1):
                        x = audit[at]
                        if x == "K":
                            state = KEEP[state][parts(sig[row])[0]]
                        elif x != "D":
                            state = MOVE[state]
                        row, at = row + (x != "I"), at + 1
                    rows.append((piece["part"], piece["no"], audit[begun:at], entered))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int32())],
                names=["part", "no", "audit", "state"])

    shaped = F.transform("pieces", lambda p: F.struct(
        p["part"].alias("part"), p["no"].alias("no"), p["n"].alias("n"))).alias("pieces")
    return gathered.select("sig", "audit", shaped).mapInArrow(
        run, "part int, no int, audit string, state int")


def edited(roles: list[str], texts: list[str], audit: str,
           state: int) -> tuple[list[str], list[str]]:
    """The messages after the edits of ``audit``, entered in ``state``."""
    new_roles, new_texts, row = [], [], 0
    for x in audit:
        if x == "K":
            state = KEEP[state][role_class(roles[row])]
            new_roles.append(roles[row])
        elif x != "D":
            state = MOVE[state]
            new_roles.append(NAME[state])
        if x != "D":
            new_texts.append("" if x == "I" else texts[row])
        row += x != "I"
    return new_roles, new_texts


def _apply_edits(chunks: DataFrame) -> DataFrame:
    schema = T.StructType([chunks.schema[c] for c in
                           ("conv_id", "part", "no", "open", "roles", "texts")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                made = [edited(*row) for row in zip(*(cut.column(c).to_pylist() for c in (
                    "roles", "texts", "audit", "state")))]
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(cut.column(c) for c in ("conv_id", "part", "no", "open")),
                     pa.array([m[0] for m in made], strings),
                     pa.array([m[1] for m in made], strings)], names=schema.names)

    return chunks.select("conv_id", "part", "no", "open", "roles", "texts", "audit",
                         "state").mapInArrow(run, schema)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text",
           present_col: str | None = None, chunk_rows: int = CHUNK_ROWS,
           chunk_bytes: int = CHUNK_BYTES) -> Repaired:
    """Cheapest repair of every conversation's rows, taken by turn (nulls first).

    ``conversations``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit``.  A null role or text counts as one space; a null id is a conversation
    of its own.  Rows of one turn go by role, then text; equal rows are copies,
    the later of them duplicates.  Rows whose ``present_col`` is false only name
    their conversation: one without other rows has zeros and an empty audit.  An
    empty table gives empty tables; other columns are not read.
    """
    present = F.lit(True) if present_col is None else F.coalesce(F.col(present_col), F.lit(False))
    chunks = cut_chunks(rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"),
        present.alias("present")), chunk_rows, chunk_bytes)
    closed = chunks.where(~F.col("open")).drop("firsts")
    opened = stage(_settle_duplicates(chunks.where("open")).drop("firsts", "late"), "open-chunks")
    gathered = stage(_gathered(opened), "open-conversations")
    every = closed.select("conv_id", "sig", _gaps(
        F.col("first_turn"), F.col("last_turn"), F.col("new_turns"))).unionByName(
        gathered.select("conv_id", "sig", "gaps"))
    solved = stage(solve(every.select("sig").distinct()), "signatures")
    conversations = every.join(solved, "sig").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    audits = solved.select("sig", "audit")
    split = _split_audits(gathered.join(audits, "sig"))
    ends = opened.join(split, ["part", "no"], "left").withColumns(
        {"audit": F.coalesce("audit", F.lit("")), "state": F.coalesce("state", F.lit(0))})
    whole = closed.join(audits, "sig").withColumn("state", F.lit(0))
    columns = ["conv_id", "part", "no", "open", "roles", "texts", "audit", "state"]
    repaired = _apply_edits(whole.select(columns).unionByName(ends.select(columns)))
    return Repaired(conversations, stage(repaired, "repaired"))


def messages(repaired: Repaired) -> DataFrame:
    """``conv_id, part, no, place, role, text``: the repaired messages as rows; they
    are in order by part, no and place."""
    both = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"))
    return repaired.chunks.select(
        "conv_id", "part", "no", F.posexplode(both).alias("place", "m")).select(
        "conv_id", "part", "no", "place", "m.role", "m.text")


def digests(repaired: Repaired) -> DataFrame:
    """``conv_id, sha256`` (lowercase hex) of the messages as ``role:text``, joined by
    newlines.  A conversation in several partitions is hashed one partition a
    round, its state carried on in a table: no task reads more than one
    partition's share of it."""
    chunks = repaired.chunks
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    done = chunks.where(~F.col("open")).select(
        "conv_id", F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
    opened = chunks.where("open")
    order = Window.partitionBy("conv_id").orderBy("part")
    legs = stage(opened.select("conv_id", "part").distinct().select(
        "conv_id", "part", F.row_number().over(order).alias("leg"),
        F.lead("part").over(order).isNull().alias("last")), "legs")
    rounds = legs.agg(F.max("leg")).first()[0] or 0
    schema = T.StructType([chunks.schema["conv_id"], T.StructField("state", T.BinaryType()),
                           T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, last, conv_arrow = None, None, False, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], conv_arrow), pa.array([digest.state()], pa.binary()),
                 pa.array([digest.hexdigest() if last else None], pa.string())],
                names=schema.names)

        for batch in batches:
            conv_arrow = batch.schema.field("conv_id").type
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if digest is None or row["conv_id"] != conv:
                    if digest is not None:
                        yield result()
                    conv, last = row["conv_id"], row["last"]
                    digest = Sha256(row["state"])
                for role, text in zip(row["roles"], row["texts"]):
                    digest.update(f"{chr(10) if digest.size else ''}{role}:{text}".encode())
        if digest is not None:
            yield result()

    carried = None
    for leg in range(1, rounds + 1):
        legs_here = legs.where(F.col("leg") == leg)
        here = opened.join(legs_here, _same(opened, legs_here, "part")).select(
            opened["conv_id"], opened["part"], "no", "roles", "texts", "last")
        if carried is None:
            here = here.withColumn("state", F.lit(None).cast("binary"))
        else:
            here = here.join(carried, _same(here, carried)).select(
                here["conv_id"], "part", "no", "roles", "texts", "last", "state")
        after = stage(here.repartition("conv_id").sortWithinPartitions(
            "conv_id", "part", "no").mapInArrow(run, schema), "digests")
        carried = after.where(F.col("sha256").isNull()).select("conv_id", "state")
        done = done.unionByName(after.where(F.col("sha256").isNotNull())
                                .select("conv_id", "sha256"))
    return done


# ------------------------------------------------------------------------ damage
def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by crc32(``conv:turn``) mod 20 (nulls: one space): 0 takes it
    away (``present`` false), 1 empties the text, 2 removes its ``.!?``, 3 repeats
    the row, 4 sets role user."""
    def text(column: str):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    code = F.crc32(F.concat_ws(":", text(conv_col), text(turn_col)).cast("binary")) % 20
    said = text(text_col)
    return (rows.withColumn("code", code).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.when(F.col("code") == 4, "user").otherwise(text(role_col)).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate(said, ".!?", ""))
        .otherwise(said).alias("text"), (F.col("code") != 0).alias("present"),
        F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2)))
                  .otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy"))
