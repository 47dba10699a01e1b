"""Conversations repaired by the cheapest edits, found by a stream over the turns in order.

A repaired conversation is an optional system turn and then user and assistant in turn, ending with the assistant, or
nothing. Edits of a turn: Keep (0), Rerole to user or assistant (1), Delete (2); Insert an empty user or assistant turn
anywhere (5). A turn's first fault counts: blank (must be deleted), duplicate (role and text stood earlier: must be
deleted), truncated (its last character ends no sentence: 5 more unless deleted). Of equally cheap edits those stay whose
initials, in order, are least in ASCII.

Method: rows are dealt by conversation and sorted by turn (nulls first; ties by role, then by the SHA-256 of the text), and
a dynamic program over four states (nothing yet, system, user, assistant) runs through them. Its vector of costs to the end
takes few values once its least is subtracted, so a step is a look in a table, and what a turn leaves behind is the two
bytes of that table's row: compact backpointers. Conversations of over `most_rows` turns or `most_chars` characters never
come to one task with their texts: their faults come from grouped joins, sorted range partitions pack them to a byte a
turn, the program streams over those bytes (state carried over Arrow batches, backpointers spilled to a file of the task's
own), and the text is hashed in blocks of at most 1 MB that range partitions have put together. Only the audit, a letter
an edit, and the digest's state are held for a whole conversation, since each is one value of one row.

Nulls: a null role or text is one space, a null turn comes first, all rows without a conversation are one conversation.
A role with no characters has no initial and can't be kept. Very long texts: see above; none is cut. Repeated rows are
duplicates. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from .common import attach, fresh, saved, sieved

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MOST_ROWS, MOST_CHARS = 4096, 4_000_000
PACK, BLOB = 65_536, 1_000_000

# States: nothing yet, system, user, assistant. Kinds of a turn: fine, truncated, to be deleted.
START, SYSTEM, USER, ASSISTANT = range(4)
FINE, CUT, GONE = range(3)
TURN_TO = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled turn leads
KEPT_TO = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
INITIALS = "sua"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: An edit's letter in a plan: its initial, and whether it makes a user or an assistant turn.
INSERTED, REROLED = {USER: "i", ASSISTANT: "j"}, {USER: "r", ASSISTANT: "q"}
INITIAL_OF = str.maketrans("dijkrq,", "DIIKRR ")
END = (0, INSERT * 2, INSERT, 0)  # costs from each state where no turn is left
INF = 1 << 30


def code(initial: str, kind: int) -> int:
    """A turn as the program sees it, in a byte."""
    return (INITIALS.index(initial) if initial in INITIALS and initial else 3) * 3 + kind


class Steps:
    """The program's steps, each worked out once: from (costs to the end after a turn, the turn) to those before it."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.plans: list[tuple] = []  # per number: for each state the letters of the edits and the state after them

    def back(self, after: tuple, turn: int) -> tuple[int, tuple, int]:
        """The number of the step, the costs before the turn less their least, and that least."""
        found = self.known.get((after, turn))
        if found is None:
            found = self.known[after, turn] = self._worked_out(after, turn)
        return found

    def _worked_out(self, after: tuple, turn: int) -> tuple[int, tuple, int]:
        own, kind = divmod(turn, 3)
        kept = KEPT_TO[INITIALS[own]] if own < 3 else {}
        more = TRUNCATED if kind == CUT else 0
        keep = [KEEP + more + after[kept[q]] if kind != GONE and q in kept else INF for q in range(4)]
        role = [REROLE + more + after[TURN_TO[q]] if kind != GONE else INF for q in range(4)]
        gone = [DELETE + after[q] for q in range(4)]
        here = [min(x) for x in zip(keep, role, gone, strict=True)]
        costs = list(here)
        for _ in range(3):  # no cheapest edits insert more than two turns on end
            costs = [min(c, INSERT + costs[TURN_TO[q]]) for q, c in enumerate(costs)]
        plans = []
        for q in range(4):
            letters, at = "", q
            while True:
                if gone[at] == costs[at]:  # in the order of the initials: Delete, Insert, Keep, Rerole
                    letters, to = letters + "d", at
                elif INSERT + costs[TURN_TO[at]] == costs[at]:
                    at = TURN_TO[at]
                    letters += INSERTED[at]
                    continue
                elif keep[at] == costs[at]:
                    letters, to = letters + "k", kept[at]
                else:
                    to = TURN_TO[at]
                    letters += REROLED[to]
                break
            plans.append((letters, to))
        self.plans.append(tuple(plans))
        least = min(costs)
        return len(self.plans) - 1, tuple(c - least for c in costs), least

    @staticmethod
    def last(state: int) -> str:
        """What is inserted after the last turn."""
        return {START: "", SYSTEM: "ij", USER: "j", ASSISTANT: ""}[state]


def cheapest(turns: bytes, steps: Steps) -> tuple[int, list[str]]:
    """Cost, and the letters of each turn's edits; what is inserted at the end comes with the last turn."""
    costs, total, numbers = END, 0, []
    for turn in reversed(turns):
        number, costs, least = steps.back(costs, turn)
        total += least
        numbers.append(number)
    state, out = START, []
    for number in reversed(numbers):
        letters, state = steps.plans[number][state]
        out.append(letters)
    if out:
        out[-1] += Steps.last(state)
    return total + costs[START], out


def lines(letters: str, role: str, text: str) -> list[str]:
    """The turns, as role:text, that an original turn's edits leave."""
    made = {"i": "user:", "j": "assistant:", "k": f"{role}:{text}", "r": f"user:{text}", "q": f"assistant:{text}"}
    return [made[x] for x in letters if x != "d"]


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str, gone: Column | None) -> DataFrame:
    """The table's rows under names of our own, with what the program needs to know of each."""
    said = F.coalesce(F.col(text), F.lit(" "))
    name = F.coalesce(F.col(role), F.lit(" "))
    out = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), name.alias("role"), said.alias("text"), (gone if gone is not None else F.lit(False)).alias("gone"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    kind = F.when(bare == "", F.lit(GONE)).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), F.lit(FINE)).otherwise(F.lit(CUT))
    return out.withColumn("kind", kind.cast("int")).withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("conv", "turn", "role", "digest")


def _ordered(*more: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*ORDER, *more)]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _small(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task: dealt by conversation, sorted by turn, judged as they pass by."""
    schema = StructType([*rows.select("conv").schema.fields, *StructType.fromDDL(RESULT).fields])
    arrow, names = to_arrow_schema(schema), schema.names

    def judged(held: list[tuple], steps: Steps) -> tuple:
        seen: set = set()
        faults = [0, 0, 0]  # blank, duplicate, truncated
        codes, initials = bytearray(), []
        for _, role, text, kind in held:
            first = role[:1]
            if kind == GONE:
                faults[0] += 1
            elif (role, text) in seen:
                faults[1] += 1
                kind = GONE
            elif kind == CUT:
                faults[2] += 1
            seen.add((role, text))
            codes.append(code(first, kind))
            initials.append(first)
        numbers = {t for t, *_ in held if t is not None}
        gaps = int(max(numbers) - min(numbers)) + 1 - len(numbers) if numbers else 0
        illegal = sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))
        cost, edits = cheapest(bytes(codes), steps)
        text = "\n".join(x for e, (_, role, said, _) in zip(edits, held, strict=True) for x in lines(e, role, said))
        audit = "".join(edits).translate(INITIAL_OF)
        return gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps, held, at, begun, done = Steps(), [], None, False, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types, strict=True)], names)

        for batch in batches:
            for conv, turn, role, text, kind, gone in zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True):
                if begun and conv != at:
                    done.append((at, *judged(held, steps)))
                    held = []
                at, begun = conv, True
                if not gone:
                    held.append((turn, role, text, kind))
                if len(done) >= 1000:
                    yield flushed()
        if begun:
            done.append((at, *judged(held, steps)))
        if done:
            yield flushed()

    sorted_rows = rows.repartition("conv").sortWithinPartitions(*_ordered())
    return sorted_rows.select("conv", "turn", "role", "text", "kind", "gone").mapInArrow(run, schema)


# ---- Conversations that must not come to one task with their texts ----


def _judged_rows(rows: DataFrame) -> DataFrame:
    """rows (with uid) with the program's code of each, duplicates found by grouped joins. No texts."""
    narrow = rows.select("conv", "turn", "role", "digest", "uid", "kind")
    same = F.sha2(F.concat_ws("\x00", F.coalesce(F.concat(F.lit("+"), F.col("conv").cast("string")), F.lit("-")), F.hex("digest"), F.col("role")), 256)
    narrow = narrow.withColumn("same", F.unhex(same))
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "uid")
    firsts = narrow.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("same", F.col("first.uid").alias("first"))
    narrow = attach(narrow, "same", "uid", firsts, "left").withColumn("again", F.coalesce(F.col("first") != F.col("uid"), F.lit(False)) & (F.col("kind") != GONE))
    place_of = F.position(F.left("role", F.lit(1)), F.lit(INITIALS))
    initial = F.when((F.col("role") == "") | (place_of == 0), 3).otherwise(place_of - 1)
    fault = F.when(F.col("kind") == GONE, "blank").when(F.col("again"), "duplicate").when(F.col("kind") == CUT, "truncated")
    kind = F.when(F.col("again"), F.lit(GONE)).otherwise(F.col("kind"))
    return narrow.select("conv", "turn", "role", "digest", "uid", (initial * 3 + kind).cast("int").alias("code"), fault.alias("fault"))


def _packed(judged: DataFrame) -> DataFrame:
    """conv, part, chunk, codes, uids: sorted range partitions, at most PACK turns of a conversation to a row."""
    schema = StructType([*judged.select("conv").schema.fields, *StructType.fromDDL("part int, chunk int, codes binary, uids array<long>").fields])
    arrow, names, most = to_arrow_schema(schema), schema.names, PACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, uids, at, begun, chunk, part = bytearray(), [], None, False, 0, 0

        def packed() -> pa.RecordBatch:
            row = [[at], [part], [chunk], [bytes(codes)], [uids]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, arrow.types, strict=True)], names)

        for batch in batches:
            for conv, uid, value, p in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if begun and (conv != at or len(codes) >= most):
                    yield packed()
                    codes, uids, chunk = bytearray(), [], chunk + 1
                at, begun, part = conv, True, p
                codes.append(value)
                uids.append(uid)
        if codes:
            yield packed()

    placed = judged.select(*ORDER, "uid", "code").repartitionByRange(*_ordered("uid")).sortWithinPartitions(*_ordered("uid"))
    return placed.select("conv", "uid", "code", F.spark_partition_id().alias("part")).mapInArrow(run, schema)


def _edited(packed: DataFrame) -> DataFrame:
    """conv, part, chunk, edits (commas between turns) of each row of packed, and rows without part that hold the
    conversation's illegal, cost and audit. The last turns come first, with the costs to the end carried along; what a turn
    leaves behind goes to a file of the task's own, which is then read from its end."""
    schema = StructType([*packed.select("conv").schema.fields, *StructType.fromDDL("part int, chunk int, edits string, illegal long, cost long, audit string").fields])
    arrow, names = to_arrow_schema(schema), schema.names

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, arrow.types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Steps()
        trail, chunks, at, begun = None, [], None, False
        costs, total, illegal, later = END, 0, 0, None

        def ended() -> Iterator[pa.RecordBatch]:
            state, audit, place = START, [], trail.tell()
            for i, (part, chunk, n) in enumerate(reversed(chunks)):
                place -= 2 * n
                trail.seek(place)
                numbers = array("H", trail.read(2 * n))
                edits = []
                for number in reversed(numbers):
                    letters, state = steps.plans[number][state]
                    edits.append(letters)
                if i == len(chunks) - 1:
                    edits[-1] += Steps.last(state)
                joined = ",".join(edits)
                audit.append(joined.replace(",", "").translate(INITIAL_OF))
                yield row(at, part, chunk, joined, None, None, None)
            yield row(at, None, None, None, illegal, total + costs[START], "".join(audit))
            trail.close()

        for batch in batches:
            for conv, part, chunk, codes in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if begun and conv != at:
                    yield from ended()
                    trail = None
                if trail is None:
                    trail, chunks, at, begun = tempfile.SpooledTemporaryFile(max_size=1 << 23), [], conv, True
                    costs, total, illegal, later = END, 0, 0, None
                numbers = array("H")
                for turn in reversed(codes):
                    number, costs, least = steps.back(costs, turn)
                    total += least
                    numbers.append(number)
                    initial = INITIALS[turn // 3] if turn < 9 else ""
                    if later is not None and (initial, later) not in LEGAL:
                        illegal += 1
                    later = initial
                trail.write(numbers.tobytes())
                chunks.append((part, chunk, len(codes)))
        if begun:
            yield from ended()

    back = [F.col("part").desc(), F.col("chunk").desc()]
    return packed.select("conv", "part", "chunk", "codes").repartition("conv").sortWithinPartitions("conv", *back).mapInArrow(run, schema)


def _hashed(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256 of ordered lines (conv, order columns, lines array): put together to blocks by range partitions,
    which hold any conversation in parts, then hashed block by block."""
    blocks = StructType([*repaired.select("conv").schema.fields, *StructType.fromDDL("part int, block int, text string").fields])
    arrow, most = to_arrow_schema(blocks), BLOB

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at, part, block, begun = [], 0, None, 0, 0, False

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((at, part, block, "\n".join(held)), arrow.types, strict=True)], blocks.names)

        for batch in batches:
            for conv, said, p in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if begun and (conv != at or size >= most):
                    yield made()
                    held, size, block = [], 0, block + 1
                at, part, begun = conv, p, True
                held += said
                size += sum(map(len, said))
        if held:
            yield made()

    placed = repaired.where(F.size("lines") > 0).repartitionByRange(*_ordered("uid")).sortWithinPartitions(*_ordered("uid"))
    made = placed.select("conv", "lines", F.spark_partition_id().alias("part")).mapInArrow(together, blocks)
    digests = StructType([*repaired.select("conv").schema.fields, *StructType.fromDDL("repaired_sha256 string").fields])
    kinds = to_arrow_schema(digests).types

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at], kinds[0]), pa.array([state.hexdigest()], kinds[1])], digests.names)
        for batch in batches:
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and conv != at:
                    yield row()
                    state = None
                if state is None:
                    at, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.encode("utf-8", "surrogatepass"))
        if state is not None:
            yield row()

    return made.repartition("conv").sortWithinPartitions("conv", "part", "block").select("conv", "text").mapInArrow(hashed, digests)


def _edits_of_rows(packed: DataFrame, edited: DataFrame) -> DataFrame:
    """uid, letters: each turn's edits."""
    both = packed.select("part", "chunk", "uids").join(edited.where("part IS NOT NULL").select("part", "chunk", F.split("edits", ",").alias("edits")), ["part", "chunk"])
    return both.select(F.explode(F.arrays_zip("uids", "edits")).alias("e")).select(F.col("e.uids").alias("uid"), F.col("e.edits").alias("letters"))


def _lines() -> Column:
    """The turns, as role:text, that a row's edits leave."""
    made = lambda x: (
        F.when(x == "i", "user:").when(x == "j", "assistant:").when(x == "k", F.concat("role", F.lit(":"), "text")).when(x == "r", F.concat(F.lit("user:"), "text")).otherwise(F.concat(F.lit("assistant:"), "text"))
    )
    return F.transform(F.split(F.regexp_replace("letters", "d", ""), ""), made)


def _large(rows: DataFrame) -> DataFrame:
    """The same results for conversations of any size, in parts; see the module's text."""
    rows = saved(rows.withColumn("uid", F.monotonically_increasing_id()), "turns")
    there = rows.where("NOT gone")
    judged = saved(_judged_rows(there), "judged")
    packed = saved(_packed(judged), "packed")
    edited = saved(_edited(packed), "edited")
    changed = there.join(_edits_of_rows(packed, edited), "uid")
    texts = _hashed(changed.select(*ORDER, "uid", F.when(F.regexp_replace("letters", "d", "") == "", F.array().cast("array<string>")).otherwise(_lines()).alias("lines")))
    faults = judged.groupBy("conv").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = judged.where("turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg((F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("*")).alias("gaps"))
    out = rows.select("conv").distinct()
    for part in (faults, gaps, edited.where("part IS NULL").select("conv", "illegal", "cost", "audit"), texts):
        out = out.join(part.withColumnRenamed("conv", "_of"), F.col("conv").eqNullSafe(F.col("_of")), "left").drop("_of")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _parted(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """rows of conversations that fit a task, and those of others, if there are any."""
    sizes = rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))
    of = fresh(rows, "_giant")
    giants = saved(sizes.where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select(F.col("conv").alias(of)), "giants")
    if giants.isEmpty():
        return rows, None
    known = F.coalesce(F.concat(F.lit("+"), F.col("conv").cast("string")), F.lit("-"))
    keys = giants.select(F.coalesce(F.concat(F.lit("+"), F.col(of).cast("string")), F.lit("-")).alias(of))
    maybe, others = sieved(rows, known, keys, of)
    small = others.unionByName(maybe.join(giants, F.col("conv").eqNullSafe(F.col(of)), "left_anti"))
    return small, maybe.join(giants, F.col("conv").eqNullSafe(F.col(of)), "left_semi")


def audited(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    gaps: numbers that are missing between the first and the last turn; illegal: neighbours whose roles' initials aren't su,
    ua or au; audit: the initials of the edits in order; repaired_sha256: of the repaired turns as role:text, a line each.
    gone: rows that only say that there is such a conversation."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col, gone)
    small, large = _parted(rows, most_rows, most_chars)
    out = _small(small) if large is None else _small(small).unionByName(_large(large))
    return out.withColumnRenamed("conv", conv_col)


def repaired(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired turns: conv_col, turn_col (of the original turn; of an inserted one that of the turn it stands beside),
    place (from 0 within what that turn has become), role, text. In order by conv_col, turn_col, role and digest of the
    original, and place; a conversation of any size stays spread over tasks."""
    rows = saved(_rows(turns, conv_col, turn_col, role_col, text_col, None).withColumn("uid", F.monotonically_increasing_id()), "turns")
    packed = saved(_packed(_judged_rows(rows)), "packed")
    changed = rows.join(_edits_of_rows(packed, saved(_edited(packed), "edited")), "uid").where("letters <> 'd'")
    changed = changed.select(*ORDER, "uid", "text", F.posexplode(F.split(F.regexp_replace("letters", "d", ""), "")).alias("place", "letter"))
    role = F.when(F.col("letter").isin("i", "r"), "user").when(F.col("letter").isin("j", "q"), "assistant").otherwise(F.col("role"))
    text = F.when(F.col("letter").isin("i", "j"), "").otherwise(F.col("text"))
    out = changed.repartitionByRange(*_ordered("uid", "place")).sortWithinPartitions(*_ordered("uid", "place"))
    return out.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), "place", role.alias("role"), text.alias("text"))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns with faults put in by crc32(conv:turn) % 20: 0 is marked as gone, 1 loses its text, 2 its ends of sentences, 3 is
    said twice, 4 is said by the user. Nulls are one space. Columns: conv_col, turn_col, role_col, text_col, gone."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), part(role_col).alias("role"), part(text_col).alias("text"), F.pmod(F.crc32(F.concat(part(conv_col), F.lit(":"), part(turn_col))), F.lit(20)).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    rows = rows.select("conv", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), twice.alias("_copy"))
    return rows.select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "gone")
