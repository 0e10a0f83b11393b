"""Conversation structure repair: the cheapest edits that give roles the order (s?(ua)+)?.

Faults. Each row of a conversation, in the order of its turns, has at most one: blank
(no visible character), duplicate (role and text seen earlier), truncated (the last
visible character is not one of .!?). Edits of a row: Keep (0), Rerole to user or
assistant (3), Delete (4; blank and duplicate rows must go). Rows of empty text by user
or assistant may be Inserted anywhere (3). A truncated row that stays adds 3. Among the
cheapest sequences of edits the one whose initials come first in ASCII order is taken.

Method. A row is a symbol: its role (system, user, assistant, other) and what its fault
asks for. Conversations become strings of symbols. Re-Pair gives all of them one grammar:
rounds count adjacent pairs over the distinct strings and make the most frequent ones
rules. Over the four states of the role order, each symbol has a (min, +) transfer matrix
whose entries are a cost and the audit of the edits, a rope that shares the ropes of the
symbols it was made of. Rules are evaluated bottom-up, once, whatever number of
conversations use them; a conversation is then the product of the few symbols left of it.

(Cost, audit) pairs form a semiring: two audits of equal cost over the same rows cannot
be prefixes of each other (the rest would be inserts, which cost), so the lesser of two
stays the lesser whatever follows.

Distribution. Texts take no part in finding the edits: rows are (conversation, turn,
role, digest of role and text), equal ones counted. They are dealt by ranges of
(conversation, turn), so a conversation may lie in many tasks, as chunks of at most CHUNK
symbols; chunks are folded in order, a byte per row. Texts are moved once, to the edits
of their conversation, and read there as a stream. A conversation's audit is one value,
and its repaired rows are a sequence, so these two steps take it in one task, holding
the audit and one batch of rows.

* A null conv_id is one conversation. Null roles and texts are read as one blank. Null
  turns come first. Rows of one turn are ordered by role, then by the SHA-256 of
  ``length of the role:role:text``. Repeated rows are rows.
* Roles other than s..., u..., a..., the empty one among them, can be kept in no valid order.
* No rows: no result. Other columns are not carried, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import cut, ship_package

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CHUNK = 4096
ROUNDS = 12
BATCH = 400  # new rules of a round; 12 rounds of them fit into the private use characters

SPACES = " \t\n\x0b\x0c\r"
INITIALS = "sua"  # the role classes; 3 is any other
FORCED = 2  # what a fault asks for: 0 nothing, 1 a surcharge, 2 deletion
TERMINALS = "abcdefghijkl"  # class * 3 + fault
FIRST_RULE = 0xE000

# States: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
STATES = range(4)
USER, ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}  # where a turn of that role leads
FINAL = (0, 3)

Rope = str | tuple  # text, or (length, left, right)


# ---- ropes ----


def size(rope: Rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def join(left: Rope, right: Rope) -> Rope:
    if not size(left) or not size(right):
        return left if size(left) else right
    if isinstance(left, str) and isinstance(right, str) and len(left) + len(right) <= 16:
        return left + right
    return size(left) + size(right), left, right


def text_of(rope: Rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += [r[2], r[1]]
    return "".join(out)


def before(one: Rope, two: Rope) -> bool:
    """Whether the text of ``one`` comes first. Shared parts at the same place are skipped."""
    x, y = [one], [two]
    while x and y:
        a, b = x.pop(), y.pop()
        if a is b:
            continue
        if isinstance(a, tuple) and (isinstance(b, str) or a[0] >= b[0]):
            x += [a[2], a[1]]
            y.append(b)
        elif isinstance(b, tuple):
            y += [b[2], b[1]]
            x.append(a)
        else:
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a < b
            x += [a[n:]] if a[n:] else []
            y += [b[n:]] if b[n:] else []
    return bool(y)


# ---- transfer matrices ----

Cell = tuple[int, Rope]
Matrix = list[list[Cell | None]]


def _least(old: Cell | None, new: Cell) -> Cell:
    if old is None or new[0] < old[0] or (new[0] == old[0] and before(new[1], old[1])):
        return new
    return old


def through(row: list[Cell | None], matrix: Matrix) -> list[Cell | None]:
    """One row of the (min, +) product."""
    out: list[Cell | None] = [None] * 4
    for have, cells in zip(row, matrix):
        if have is not None:
            for to, cell in enumerate(cells):
                if cell is not None:
                    cost, old = have[0] + cell[0], out[to]
                    if old is None or cost <= old[0]:
                        out[to] = _least(old, (cost, join(have[1], cell[1])))
    return out


def _inserts() -> Matrix:
    """Cheapest inserts from state to state."""
    step: Matrix = [[None] * 4 for _ in STATES]
    for moves in (USER, ASSISTANT):
        for a, b in moves.items():
            step[a][b] = (INSERT, "I")
    out: Matrix = [[(0, "") if a == b else None for b in STATES] for a in STATES]
    for _ in STATES:
        for a in STATES:
            for b, cell in enumerate(through(out[a], step)):
                if cell is not None:
                    out[a][b] = _least(out[a][b], cell)
    return out


INSERTS = _inserts()


def _terminal(kind: int, fault: int) -> Matrix:
    """Inserts, then one edit of the row."""
    edit: Matrix = [[(DELETE, "D") if a == b else None for b in STATES] for a in STATES]
    if fault != FORCED:
        more = TRUNCATED if fault else 0
        for moves, keeps in ((USER, kind == 1), (ASSISTANT, kind == 2)):
            for a, b in moves.items():
                edit[a][b] = _least((REROLE + more, "R"), (KEEP + more, "K") if keeps else (REROLE + more, "R"))
        if kind == 0:
            edit[0][1] = (KEEP + more, "K")
    return [through(row, edit) for row in INSERTS]


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


class Symbol:
    """What a string of rows does: its matrix, its illegal neighbours, its outer roles."""

    __slots__ = ("matrix", "illegal", "first", "last")

    def __init__(self, matrix: Matrix, illegal: int, first: int, last: int):
        self.matrix, self.illegal, self.first, self.last = matrix, illegal, first, last

    def then(self, other: Symbol) -> Symbol:
        illegal = self.illegal + other.illegal + (not legal(self.last, other.first))
        return Symbol([through(row, other.matrix) for row in self.matrix], illegal, self.first, other.last)


Rules = list[dict[str, str]]  # by round: pair -> symbol


def evaluate(rules: Rules) -> dict[str, Symbol]:
    """All symbols, bottom-up."""
    table = {t: Symbol(_terminal(i // 3, i % 3), 0, i // 3, i // 3) for i, t in enumerate(TERMINALS)}
    for made in rules:
        for pair, symbol in made.items():
            table[symbol] = table[pair[0]].then(table[pair[1]])
    return table


def replace(symbols: str, made: dict[str, str]) -> str:
    """Pairs replaced from the left."""
    out, i, n = [], 0, len(symbols)
    while i < n:
        new = made.get(symbols[i : i + 2])
        out.append(new or symbols[i])
        i += 2 if new else 1
    return "".join(out)


class Fold:
    """A conversation's chunks, in order. What all surviving audits share is settled at once,
    so only their short ends are kept apart and compared."""

    def __init__(self, rules: Rules, table: dict[str, Symbol]):
        self.rules, self.table = rules, table
        self.settled: list[str] = []
        self.row: list[Cell | None] = [(0, ""), None, None, None]
        self.illegal, self.last = 0, None

    def add(self, chunk: str) -> None:
        for made in self.rules:
            chunk = replace(chunk, made)
        for s in chunk:
            symbol = self.table[s]
            self.row = through(self.row, symbol.matrix)
            self.illegal += symbol.illegal + (self.last is not None and not legal(self.last, symbol.first))
            self.last = symbol.last
        ends = [cell and (cell[0], text_of(cell[1])) for cell in self.row]
        texts = [cell[1] for cell in ends if cell]
        low, high = min(texts), max(texts)
        n = next((i for i, c in enumerate(low) if c != high[i : i + 1]), len(low))
        self.settled.append(low[:n])
        self.row = [cell and (cell[0], cell[1][n:]) for cell in ends]

    def result(self) -> tuple[int, str, int]:
        """(cost, audit, illegal neighbours)."""
        ends = through(self.row, INSERTS)
        best = None
        for state in FINAL:
            if ends[state] is not None:
                best = _least(best, ends[state])
        return best[0], "".join(self.settled) + text_of(best[1]), self.illegal


# ---- tasks ----


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows joined into chunks of one conversation each."""
    part, out, have, key, seq = TaskContext.get().partitionId(), [], "", None, 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.string(), pa.int32(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ckey", "part", "seq", "symbols"])

    for b in batches:
        for k, run in zip(b.column("ckey").to_pylist(), b.column("run").to_pylist()):
            if have and (k != key or len(have) + len(run) > CHUNK):
                out.append((key, part, seq, have))
                have, seq = "", seq + 1
            key, have = k, have + run
        yield batch()
        out.clear()
    if have:
        out.append((key, part, seq, have))
        yield batch()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = Counter(s[i : i + 2] for s in b.column("symbols").to_pylist() for i in range(len(s) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["pair", "n"])


def _replaced(made: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([replace(s, made) for s in b.column("symbols").to_pylist()], pa.string())], ["symbols"])


def _folded(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules, table = shared.value
    key, fold, out, whole, known = None, None, [], [], {}

    def finish() -> None:
        """A conversation of one chunk is looked up; most share their string with others."""
        if fold is not None:
            out.append((key, *fold.result()))
        elif whole:
            if whole[0] not in known:
                one = Fold(rules, table)
                one.add(whole[0])
                if len(known) > 20_000:
                    known.clear()
                known[whole[0]] = one.result()
            out.append((key, *known[whole[0]]))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["ckey", "cost", "audit", "illegal"])

    for b in batches:
        for k, symbols in zip(b.column("ckey").to_pylist(), b.column("symbols").to_pylist()):
            if k != key:
                finish()
                key, fold, whole = k, None, [symbols]
                continue
            if fold is None:
                fold = Fold(rules, table)
                fold.add(whole[0])
            fold.add(symbols)
        yield batch()
        out.clear()
    finish()
    yield batch()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple[str, str, str]]]]:
    """(conversation, its next repaired (role, text, edit) rows), by conversation, in order. An
    audit comes before the rows of its conversation; the last list holds what is inserted at the end."""
    key, audit, at, state = None, "", 0, 0

    def inserted() -> list[tuple[str, str, str]]:
        nonlocal at, state
        out = []
        while at < len(audit) and audit[at] == "I":
            role, state = ("user", 2) if state in USER else ("assistant", 3)
            out.append((role, "", "I"))
            at += 1
        return out

    for b in batches:
        columns = (b.column(c).to_pylist() for c in ("ckey", "audit", "role", "text", "copies"))
        for k, new, role, text, copies in zip(*columns):
            if new is not None:
                if key is not None:
                    yield key, inserted()
                key, audit, at, state = k, new, 0, 0
                yield key, []
                continue
            for _ in range(copies):
                rows = inserted()
                edit = audit[at]
                at += 1
                if edit == "R":
                    role_now, state = ("user", 2) if state in USER else ("assistant", 3)
                    rows.append((role_now, text, "R"))
                elif edit == "K":
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                    rows.append((role, text, "K"))
                yield k, rows
    if key is not None:
        yield key, inserted()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"ckey": pa.string(), "position": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    key, position, out, held = None, 0, [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))

    for k, rows in _edited(batches):
        if k != key:
            key, position = k, 0
        for row in rows:
            out.append((k, position, *row))
            position, held = position + 1, held + len(row[1])
        if held > 2**22 or len(out) >= 10_000:
            yield batch()
            out, held = [], 0
    yield batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, started, sha, out = None, False, hashlib.sha256(), []

    def batch() -> pa.RecordBatch:
        keys, digests = list(zip(*out)) or ([], [])
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["ckey", "digest"])

    for k, rows in _edited(batches):
        if k != key:
            if key is not None:
                out.append((key, sha.hexdigest()))
            key, started, sha = k, False, hashlib.sha256()
            if len(out) >= 10_000:
                yield batch()
                out = []
        for role, text, _ in rows:
            sha.update((("\n" if started else "") + role + ":" + text).encode())
            started = True
    if key is not None:
        out.append((key, sha.hexdigest()))
    yield batch()


# ---- Spark ----


def _key(df: DataFrame) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) alone; ``copies`` is 1 where the table has no such column of its own."""
    return df.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies"),
    )


def damage(df: DataFrame) -> DataFrame:
    """Known faults, by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 removes its
    sentence ends, 3 repeats it, 4 makes it the user's."""
    rows = turns(df)
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(name[0], F.lit(":"), name[1]), "UTF-8")) % 20
    return rows.withColumn("kind", kind).filter("kind <> 0").select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.encode(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), "UTF-8"), 256))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def symbols(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn together: (ckey, turn, role, digest, n, blank, later, truncated, class)."""
    visible = F.rtrim(F.col("text"), F.lit(SPACES))
    ending = F.substring(visible, -1, 1)
    one = rows.select(
        _key(rows).alias("ckey"), "turn", "role", _digest().alias("digest"), "copies",
        (ending == "").alias("blank"), (~ending.isin(".", "!", "?")).alias("truncated"),
    )
    counted = cut(
        one.groupBy("ckey", "turn", "role", "digest").agg(
            F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated")
        ), "turn-rows",
    )
    known = F.struct(F.col("turn").isNotNull(), "turn")
    first = counted.groupBy("ckey", "digest").agg(F.min(known).alias("first"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return cut(
        counted.join(first, ["ckey", "digest"]).select(
            "ckey", "turn", "role", "digest", "n", "blank", "truncated",
            (~known.eqNullSafe(F.col("first"))).alias("later"), kind.alias("class"),
        ), "turn-symbols",
    )


def learn(strings: DataFrame) -> Rules:
    """Rules of the grammar, by rounds. ``strings``: (symbols), distinct."""
    rules: Rules = []
    for r in range(ROUNDS):
        pairs = strings.mapInArrow(_pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        top = pairs.filter("n > 1").orderBy(F.desc("n"), "pair").limit(BATCH).collect()
        if not top:
            break
        rules.append({row["pair"]: chr(FIRST_RULE + r * BATCH + i) for i, row in enumerate(top)})
        if r < ROUNDS - 1:
            strings = cut(strings.mapInArrow(partial(_replaced, rules[-1]), "symbols string"), "grammar")
    return rules


def plan(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit per conversation: (ckey, gaps, blank, duplicate, truncated, illegal, cost,
    audit). ``rows``: what :func:`turns` gives."""
    spark = rows.sparkSession
    ship_package(spark)
    rows = symbols(rows)
    fresh = ~F.col("blank") & ~F.col("later")
    faults = rows.groupBy("ckey").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((fresh & F.col("truncated")).cast("bigint")).alias("truncated"),
    )
    # Copies behind the first are to be deleted; a long run of them is dealt over several rows.
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / CHUNK))))
    count = F.least(F.lit(CHUNK).cast("bigint"), F.col("n") - F.col("piece") * CHUNK)
    fault = F.when(~fresh | (F.col("piece") > 0), FORCED).when(F.col("truncated"), 1).otherwise(0)

    def letter(f) -> Column:
        return F.substring(F.lit(TERMINALS), F.col("class") * 3 + f + 1, F.lit(1))

    run = F.concat(letter(fault), F.repeat(letter(F.lit(FORCED)), (count - 1).cast("int")))
    dealt = pieces.select("ckey", "turn", "role", "digest", "piece", run.alias("run"))
    order = [F.col("ckey").asc(), *_order(), F.col("piece").asc()]
    ranged = dealt.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = cut(ranged.mapInArrow(_chunks, "ckey string, part int, seq bigint, symbols string"), "turn-chunks")
    rules = learn(cut(chunks.select("symbols").distinct(), "turn-strings"))
    shared = spark.sparkContext.broadcast((rules, evaluate(rules)))
    in_order = chunks.repartition("ckey").sortWithinPartitions("ckey", "part", "seq")
    edits = in_order.mapInArrow(partial(_folded, shared), "ckey string, cost bigint, audit string, illegal bigint")
    return cut(faults.join(edits, "ckey"), "turn-plan")


def _with_audits(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows by conversation, in order, behind the audit of their conversation."""
    texts = rows.select(_key(rows).alias("ckey"), F.lit(None).cast("string").alias("audit"), "turn", "role", _digest().alias("digest"), "text", "copies")
    audits = planned.select(
        "ckey", "audit", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
        F.lit("").alias("text"), F.lit(0).alias("copies"),
    )
    return texts.unionByName(audits).repartition("ckey").sortWithinPartitions("ckey", F.col("audit").isNull(), *_order())


def repaired_turns(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(ckey, position, role, text, edit): the conversations as repaired."""
    return _with_audits(rows, planned).mapInArrow(_turns, "ckey string, position bigint, role string, text string, edit string")


def repaired_digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """(ckey, digest): SHA-256 of the repaired ``role:text`` rows, joined by newlines."""
    return _with_audits(rows, planned).mapInArrow(_digests, "ckey string, digest string")


def repair(df: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``df``, with what was found in ``rows`` of that conversation; zeros,
    an empty audit and the digest of nothing where there are none."""
    planned = plan(rows)
    everyone = df.groupBy(_key(df).alias("ckey")).agg(F.first("conv_id").alias("conv_id"))
    found = everyone.join(planned, "ckey", "left").join(repaired_digests(rows, planned), "ckey", "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
