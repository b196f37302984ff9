"""Conversation structure repair over a suffix-shared DAWG (operator 13).

A row's first fault is blank (no visible character), duplicate (role and text seen
earlier in the conversation) or truncated (the last visible character is not one of ``.!?``).
Edits: Keep 0; Rerole to user or assistant 1; Delete 2 (the only edit for blank and
duplicate rows); Insert an empty user or assistant row 5; a truncated row that stays adds 5.
The result must have the role initials ``(s?(ua)+)?``; the cheapest edits are taken,
of equally cheap ones those whose initials, in order, come first in ASCII.

1. Rows are reduced to a digest of role and text, their role's initial and what the
   text alone says.  Equal rows are counted (partial aggregation), and a second count
   finds where each (role, text) stands first.  No text takes part in steps 1 to 4.
2. The reduced rows are range-sorted by conversation, turn and digest (so a conversation with a
   third of all rows lies in many tasks) and cut into blocks of at most ``BLOCK`` rows.  A
   block's signature is a word over nine letters: role initial (s, u, a, other), each
   sound or truncated, and must-delete.
3. All signatures are range-sorted by their reversed word.  Neighbours then share
   suffixes, so a stack over the sorted words is the DAWG minimised from the end: its node is a
   suffix, and the cost and best audit of that suffix from each of the four grammar
   states to each state behind the block are computed once per node, however many
   conversations end that way (a task repeats at most one path of its neighbour).
4. Per conversation the blocks' summaries are put together in order, streaming: states that can no longer
   win are dropped (``SLACK``), and what all live states agree on is settled and given out, so a task holds some
   blocks; only where the rows leave it open to the end whose turn it is (say, none has a
   role) it holds about 30 bytes a row.
5. The settled edits meet the rows again by (conversation, digest).

Defined cases: a null role or text counts as one space; a null ``turn`` sorts first; a null
``conv_id`` is one conversation; rows with the same turn are ordered by their digest; a role that is
empty, or starts with anything but s, u or a, cannot be kept as it is; a conversation of a single or
no sound row is repaired like any other (possibly to nothing); repeated rows are duplicates of each
other; ``gaps`` is null where it does not fit into 64 bits; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

BLOCK = 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
ROLE = {"u": "user", "a": "assistant"}
#: grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a; what each state takes next
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FILL = ("u", "u", "a", "u")                 # the row that may be inserted in each state
#: inserted rows at the end of a conversation, by state
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: no state can make up for a lead of more than this: from any state the plan of another one
#: can be followed after at most two inserts and two reroles or deletes
SLACK = 2 * INSERT + 2 * DELETE + 2 * REROLE
BLANK = r"[^\x20\x09-\x0D]"


# ------------------------------------------------------------------ automaton

def insert_first(vector: list) -> list:
    """Allow inserted rows before what ``vector`` (per state: cost and audit, or None) covers."""
    out = list(vector)
    for _ in range(3):
        for q in range(4):
            got = out[NEXT[q][FILL[q]]]
            if got is not None:
                new = (got[0] + INSERT, "I" + got[1])
                if out[q] is None or new < out[q]:
                    out[q] = new
    return out


def step_back(letter: str, vector: list) -> list:
    """Cost and audit per state of a row with ``letter`` followed by what ``vector`` covers."""
    out = []
    role, extra = letter.lower(), CUT if letter.isupper() else 0
    for q in range(4):
        best = None
        got = vector[q]
        if got is not None:
            best = (got[0] + DELETE, "D" + got[1])
        if letter != "x":
            to = NEXT[q].get(role)
            if to is not None and vector[to] is not None:
                new = (vector[to][0] + KEEP + extra, "K" + vector[to][1])
                if best is None or new < best:
                    best = new
            to = NEXT[q][FILL[q]]
            if FILL[q] != role and vector[to] is not None:
                new = (vector[to][0] + REROLE + extra, "R" + vector[to][1])
                if best is None or new < best:
                    best = new
        out.append(best)
    return insert_first(out)


def node(letter: str, after: list[list]) -> list[list]:
    """A DAWG node: for each state behind the block, the vector over the states before."""
    return [step_back(letter, v) for v in after]


#: the node of the empty suffix
LEAF = [[(0, "") if q == to else None for q in range(4)] for to in range(4)]


class SuffixStack:
    """The DAWG path of the last word; words must come sorted by their reversed form."""

    def __init__(self):
        self.word, self.path, self.made = "", [LEAF], 0

    def transfer(self, word: str) -> list[list]:
        back, last = word[::-1], self.word
        same = 0
        for a, b in zip(back, last):
            if a != b:
                break
            same += 1
        del self.path[same + 1:]
        for letter in back[same:]:
            self.path.append(node(letter, self.path[-1]))
            self.made += 1
        self.word = back
        return self.path[-1]


def flat(transfer: list[list]) -> str:
    """A transfer as text: from:to:cost:audit, comma-joined."""
    return ",".join(f"{q}:{to}:{v[q][0]}:{v[q][1]}" for to, v in enumerate(transfer) for q in range(4) if v[q] is not None)


def parsed(text: str) -> list[tuple[int, int, int, str]]:
    return [(int(q), int(to), int(c), a) for q, to, c, a in (p.split(":") for p in text.split(","))]


class Fold:
    """The blocks of one conversation, put together from left to right.

    Audits are compared by rank: at a block's end two different audits have used the same rows, so neither is the
    beginning of the other, and whatever follows cannot change their order.
    """

    def __init__(self):
        self.live = {0: (0, 0)}                  # state -> cost, rank of its audit
        self.pending: list[tuple[str, bytes, dict]] = []    # word, digests, state -> (state before, audit of the block)
        self.limit = 8
        self.state, self.at = 0, 0               # grammar state and length of the settled result
        self.audit: list[str] = []

    def block(self, transfer, word: str, digests: bytes):
        """Add a block; yields what is settled by it (see ``replay``)."""
        best: dict[int, tuple] = {}
        for q, to, cost, audit in transfer:
            if q in self.live:
                c, rank = self.live[q]
                got = (c + cost, rank, audit, q)
                if to not in best or got < best[to]:
                    best[to] = got
        least = min(v[0] for v in best.values())
        best = {to: v for to, v in best.items() if v[0] <= least + SLACK}
        self.live = {to: (best[to][0], i) for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        self.pending.append((word, digests, {to: (v[3], v[2]) for to, v in best.items()}))
        if len(self.pending) >= self.limit:
            states = set(self.live)
            for k in range(len(self.pending) - 1, -1, -1):
                states = {self.pending[k][2][q][0] for q in states}
                if len(states) == 1:
                    yield from self.settle(k, states.pop())
                    break
            self.limit = max(8, 2 * len(self.pending))      # so that looking back costs a constant per block

    def settle(self, count: int, state: int):
        """The first ``count`` pending blocks end in ``state``."""
        audits = []
        for _, _, back in reversed(self.pending[:count]):
            state, audit = back[state]
            audits.append(audit)
        for (word, digests, _), audit in zip(self.pending, reversed(audits)):
            yield from self.replay(word, digests, audit)
        del self.pending[:count]

    def replay(self, word: str, digests: bytes, audit: str):
        """(position, digest, new role) of the rows that settled edits leave; None: inserted, own role."""
        row = used = 0
        for edit in audit:
            role = FILL[self.state]
            if edit != "I":
                letter, digest = word[row], None
                row += 1
                if letter != "x":
                    digest = digests[used:used + 16]
                    used += 16
                if edit == "D":
                    continue
                if edit == "K":
                    role = letter.lower()
            yield self.at, None if edit == "I" else digest, None if edit == "K" else ROLE[role]
            self.state = NEXT[self.state][role]
            self.at += 1
        self.audit.append(audit)

    def close(self):
        """Settle the rest; ``cost`` is set afterwards."""
        self.cost, _, q = min((c + END[q][0], rank, q) for q, (c, rank) in self.live.items())
        yield from self.settle(len(self.pending), q)
        yield from self.replay("", b"", END[q][1])


# ------------------------------------------------------------------ rows

def _order(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def plain_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null: one space) and ``digest`` of role and text."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))


def reduced(rows: DataFrame) -> DataFrame:
    """One row per (conv_id, turn, digest): how often, role initial, blank, truncated, and whether the
    (role, text) stands there first."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    one = F.substring("role", 1, 1)
    small = rows.select("conv_id", "turn", "digest", F.when(one.isin("s", "u", "a"), one).otherwise("o").alias("initial"),
                        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    kinds = ("initial", "blank", "cut")
    runs = cut_lineage(small.groupBy("conv_id", "turn", "digest", *kinds).agg(F.count(F.lit(1)).alias("n")))
    first = (runs.groupBy("conv_id", "digest", *kinds).agg(F.min(_order(F.col("turn"))).alias("o"))
             .select("conv_id", F.col("o.turn").alias("turn"), "digest", *kinds, F.lit(0).cast("long").alias("n"), F.lit(1).alias("first")))
    return (runs.withColumn("first", F.lit(0)).unionByName(first)
            .groupBy("conv_id", "turn", "digest", *kinds).agg(F.sum("n").alias("n"), F.max("first").alias("first")))


BLOCKS = ("conv_id {id}, part int, block long, word string, rows binary, blank long, duplicate long, truncated long, "
          "illegal long, head string, tail string, turn_low long, turn_high long, n_turns long")
_PAIRS = {("s", "u"), ("u", "a"), ("a", "u")}


class _Block:
    """The block under construction."""

    def __init__(self, conv, number):
        self.conv, self.number = conv, number
        self.word, self.rows = [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn, digest, initial, letter, fault):
        if self.tail is None:
            self.head = initial
        elif (self.tail, initial) not in _PAIRS:
            self.illegal += 1
        self.tail = initial
        if turn is not None and turn != self.high:
            self.n_turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.word.append(letter)
        if letter != "x":
            self.rows.append(digest)

    def row(self, part):
        return (self.conv, part, self.number, "".join(self.word), b"".join(self.rows), self.blank, self.duplicate,
                self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.n_turns)


def blocks(marks: DataFrame) -> DataFrame:
    """Signature words of at most ``BLOCK`` rows, in the order of the rows."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    ddl = BLOCKS.format(id=marks.schema["conv_id"].dataType.simpleString())
    target = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        part, now, out = TaskContext.get().partitionId(), None, []

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        for b in batches:
            for conv, turn, digest, initial, blank, cut, n, first in zip(*(b.column(c).to_pylist() for c in (
                    "conv_id", "turn", "digest", "initial", "blank", "cut", "n", "first"))):
                for copy in range(n):
                    if now is None or conv != now.conv:
                        if now is not None:
                            out.append(now.row(part))
                        now = _Block(conv, 0)
                    elif len(now.word) == BLOCK:
                        out.append(now.row(part))
                        now = _Block(conv, now.number + 1)
                    if blank:
                        now.add(turn, digest, initial, "x", "blank")
                    elif copy or not first:
                        now.add(turn, digest, initial, "x", "duplicate")
                    else:
                        now.add(turn, digest, initial, initial.upper() if cut else initial, "truncated" if cut else None)
                    if len(out) >= 1024:
                        yield batch()
        if now is not None:
            out.append(now.row(part))
        if out:
            yield batch()

    cols = ("conv_id", "turn", "digest", "initial", "blank", "cut", "n", "first")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    return (marks.select(*cols).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, ddl))


def transfers(words: DataFrame) -> DataFrame:
    """``words`` plus ``transfer``: the block's cheapest edits between all grammar states, from the shared DAWG."""
    from .common import with_column_schema
    schema = with_column_schema(words, "transfer", "string")

    def run(batches):
        stack = SuffixStack()
        for b in batches:
            got, last = [], None
            for w in b.column("word").to_pylist():
                if w != last:
                    text, last = flat(stack.transfer(w)), w
                got.append(text)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], schema=b.schema.append(pa.field("transfer", pa.string())))

    order = [F.reverse("word"), F.col("conv_id"), F.col("part"), F.col("block")]
    return words.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


EDITS = ("conv_id {id}, at long, digest binary, role string, blank long, duplicate long, truncated long, illegal long, cost long, "
         "audit string, turn_low long, turn_high long, n_turns long")


def edits(done: DataFrame) -> DataFrame:
    """Per conversation one summary row (``at`` null), and one row per row of the repaired conversation."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    ddl = EDITS.format(id=done.schema["conv_id"].dataType.simpleString())
    target = to_arrow_schema(StructType.fromDDL(ddl))
    names = done.columns

    def run(batches):
        out: list[tuple] = []
        fold, conv, total, tail, span = None, None, None, None, None

        def closed():
            for row in fold.close():
                yield (conv, *row, *[None] * 9)
            yield (conv, None, None, None, *total, fold.cost, "".join(fold.audit), *span)

        def batch():
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)

        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names)):
                r = dict(zip(names, r))
                if fold is None or r["conv_id"] != conv:
                    if fold is not None:
                        out.extend(closed())
                    fold, conv, total, tail, span = Fold(), r["conv_id"], [0, 0, 0, 0], None, [None, None, 0]
                for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
                    total[i] += r[c]
                if tail is not None and (tail, r["head"]) not in _PAIRS:
                    total[3] += 1
                tail = r["tail"]
                if r["turn_low"] is not None:
                    span[2] += r["n_turns"] - (span[1] == r["turn_low"])
                    span[0], span[1] = r["turn_low"] if span[0] is None else span[0], r["turn_high"]
                for row in fold.block(parsed(r["transfer"]), r["word"], r["rows"]):
                    out.append((conv, *row, *[None] * 9))
                if len(out) >= 4096:
                    yield batch()
        if fold is not None:
            out.extend(closed())
        if out:
            yield batch()

    order = ("conv_id", "part", "block")
    return done.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, ddl)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired).

    ``summary``: one row per conversation with rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``repaired``: conv_id, at (0, 1, ..), role, text, inserted of the repaired conversations.
    """
    rows = plain_rows(conversations)
    words = cut_lineage(blocks(cut_lineage(reduced(rows))))
    done = cut_lineage(edits(cut_lineage(transfers(words))))
    wide = (F.col("turn_high").cast("decimal(38,0)") - F.col("turn_low") + 1 - F.col("n_turns"))
    summary = done.filter("at is null").select(
        "conv_id", F.coalesce(wide, F.lit(0).cast("decimal(38,0)")).try_cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    kept = done.filter("at is not null")
    # equal rows are the same row of the result, so one text is enough (partial aggregation before the shuffle)
    texts = rows.groupBy("conv_id", "digest").agg(F.first("role").alias("own"), F.first("text").alias("text"))
    k, t = kept.filter("digest is not null").alias("k"), texts.alias("t")
    same = F.col("k.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("k.digest") == F.col("t.digest"))
    found = t.join(k, same).select("k.conv_id", "k.at", F.coalesce("k.role", "t.own").alias("role"), "t.text", F.lit(False).alias("inserted"))
    added = kept.filter("digest is null").select("conv_id", "at", "role", F.lit("").alias("text"), F.lit(True).alias("inserted"))
    return summary, found.unionByName(added)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and sha256 of its ``role:text`` lines in order.

    The hash is a sequential function of the whole conversation, so its rows pass one task,
    sorted and streamed (never held together).
    """
    ddl = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches):
        conv, state = None, None
        for b in batches:
            ids, out = [], []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if state is not None and c == conv:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    ids.append(conv)
                    out.append(state.hexdigest())
                conv, state = c, hashlib.sha256(line)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], b.schema.field(0).type), pa.array([state.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return (repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "role", "text", "at")
            .mapInArrow(run, ddl))


def damage(conversations: DataFrame) -> DataFrame:
    """The stated damage by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1 empties
    its text, 2 removes ``.!?``, 3 repeats it, 4 sets role user."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
            .filter("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repair_report(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """One row per conv_id of ``conversations`` with the summary and the digest of its repaired form."""
    summary, repaired = repair(damaged)
    zero = F.lit(0).cast("long")
    every = conversations.select("conv_id").distinct().select(
        "conv_id", *[F.lit(None).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.lit(None).cast("string").alias("audit"), F.lit(None).cast("string").alias("repaired_sha256"), F.lit(0).alias("known"))
    parts = (every.unionByName(summary.withColumn("known", F.lit(1)), allowMissingColumns=True)
             .unionByName(digests(repaired), allowMissingColumns=True))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    got = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in (*counts, "audit", "repaired_sha256", "known")])
    return got.select("conv_id", F.when((F.col("known") == 1), F.col("gaps")).otherwise(zero).alias("gaps"),
                      *[F.coalesce(c, zero).alias(c) for c in counts[1:]], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
