"""Repair of conversation structure: the cheapest edits after which roles
alternate, user first, assistant last, after at most one system turn.

Edits keep, rerole, delete or insert turns; turns that are blank or repeat an
earlier one must go, truncated ones that stay cost extra. The costs of all ways
from a turn to the end form a vector over four states (nothing yet, after
system, after user, after assistant). Vectors are kept only at checkpoints,
some root of the length apart; a forward walk that takes the ASCII-least edit
on a cheapest way recomputes the vectors of one stretch at a time.

A conversation may hold any part of all rows. Its turns are numbered by range
partitions, and cut into chunks; a chunk needs one byte for each turn. How a
chunk changes cost vectors is a 4 x 4 matrix under (min, +), so chunks are
summed up on their own, a fold over a conversation's matrices gives the vector
at each chunk's end, chunks are walked from every state they may be entered in,
and a second fold picks the states. Only those folds (a matrix for 4,096 turns)
and the hash over the repaired text, which is a stream in order, see a whole
conversation; no task holds its turns.

Edge cases: null roles and texts count as one blank; null turns come first;
turns with the same number stand in the order of role and text; a null conv_id
is a conversation like others; a conversation without turns has zeros and
empty results; an empty table gives no rows. Columns other than the four are
dropped before anything is named.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranked import ranked
from .scratch import stored

#: turns in a chunk, and between the checkpoints within it
CHUNK, STRETCH = 4096, 64
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 50
#: where a role leads from each state; None: it may not stand there
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: the role that may follow a state when a turn is made
NEXT = ("u", "u", "a", "u")
#: state costs of a conversation that ends: nothing left, or an assistant's turn
END = (0, FAR, FAR, 0)
#: a turn as one byte: its role's initial (or another), and 1 cut off, 2 to be deleted
ROLES = "?sua"
SPACES = r"[^\x20\x09-\x0D]"


def with_inserts(v: tuple) -> tuple:
    """Costs when turns may be inserted first."""
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


@functools.cache
def _moves(code: int) -> tuple:
    """For each state the edits of a turn, but inserts: (letter, cost, next state)."""
    role, fault = ROLES[code & 3], code >> 2
    out = []
    for state in range(4):
        moves = [("D", DELETE, state)]
        if fault != 2:
            kept = AFTER[role][state] if role in AFTER else None
            if kept is not None:
                moves.append(("K", KEEP + CUT * (fault == 1), kept))
            moves.append(("R", REROLE + CUT * (fault == 1), AFTER[NEXT[state]][state]))
        out.append(tuple(moves))
    return tuple(out)


def back(codes: bytes, v: tuple) -> tuple:
    """Costs before the turns, inserts included, from those after them (``v``, inserts included)."""
    for code in reversed(codes):
        v = with_inserts(tuple(min(c + v[to] for _, c, to in moves) for moves in _moves(code)))
    return v


def matrix(codes: bytes) -> list[int]:
    """Costs from each state before to each state after the turns, row by row."""
    columns = [back(codes, tuple(0 if s == t else FAR for t in range(4))) for s in range(4)]
    return [min(columns[after][before], FAR) for before in range(4) for after in range(4)]


def through(m: list[int], v: tuple) -> tuple:
    return tuple(min(m[4 * s + t] + v[t] for t in range(4)) for s in range(4))


#: an edit as it is stored, by its letter and the role it makes; ``audit`` has the plain letters again
TOLD = {("R", "u"): "U", ("R", "a"): "A", ("I", "u"): "i", ("I", "a"): "j"}


def walk(codes: bytes, state: int, after: tuple, last: bool, stretch: int = STRETCH) -> tuple[list[str], int]:
    """For each turn its edit, with inserts before it, and the state reached;
    where the conversation ends, the last one's also those after it."""
    marks = [after]
    for i in range((len(codes) - 1) // stretch * stretch, -1, -stretch):
        marks.append(back(codes[i : i + stretch], marks[-1]))
    edits = []
    for k, i in enumerate(range(0, len(codes), stretch)):
        part = codes[i : i + stretch]
        costs = [marks[-2 - k]]
        for code in reversed(part):
            costs.append(back(bytes([code]), costs[-1]))
        costs.reverse()
        for j, code in enumerate(part):
            here, letter = "", ""
            while letter in ("", "I"):
                step = AFTER[NEXT[state]][state]
                moves = [("I", INSERT, step, costs[j]), *((*m, costs[j + 1]) for m in _moves(code)[state])]
                letter, to = min((x, to) for x, c, to, rest in moves if c + rest[to] == costs[j][state])
                here += TOLD.get((letter, NEXT[state]), letter)
                state = to
            edits.append(here)
    while last and END[state]:
        edits[-1] += TOLD["I", NEXT[state]]
        state = AFTER[NEXT[state]][state]
    return edits, state


def illegal(codes: bytes) -> int:
    roles = "".join(ROLES[c & 3] for c in codes)
    return sum(roles[i : i + 2] not in ("su", "ua", "au") for i in range(len(roles) - 1))


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _of(batch: pa.RecordBatch, keep: list[str], **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: batch.column(batch.schema.get_field_index(n)) for n in keep} | more)


def _matrices(batches):
    for b in batches:
        codes = [c for (c,) in _lists(b, "codes")]
        yield _of(b, ["g", "chunk"], matrix=pa.array(map(matrix, codes), pa.list_(pa.int64())), illegal=pa.array(map(illegal, codes), pa.int64()), ends=pa.array([c[:1] + c[-1:] for c in codes], pa.binary()))


def _ends(batches):
    """For a conversation's chunks in order: the costs after each, and totals."""
    for b in batches:
        for g, parts in _lists(b, "g", "parts"):
            v, after = with_inserts(END), []
            for p in reversed(parts):
                after.append(list(v))
                v = through(p["matrix"], v)
            joints = sum(illegal(a["ends"][-1:] + c["ends"][:1]) for a, c in zip(parts, parts[1:]))
            n = len(parts)
            yield pa.RecordBatch.from_pydict({
                "g": pa.array([g] * n), "chunk": pa.array([p["chunk"] for p in parts], pa.int64()), "after": pa.array(after[::-1], pa.list_(pa.int64())), "last": pa.array([k == n - 1 for k in range(n)]),
                "cost": pa.array([v[START]] * n, pa.int64()), "illegal": pa.array([sum(p["illegal"] for p in parts) + joints] * n, pa.int64()),
            })


def _walks(batches):
    for b in batches:
        ways = []
        for codes, chunk, after, last in _lists(b, "codes", "chunk", "after", "last"):
            from_each = [walk(codes, s, tuple(after), last) if s == START or chunk else ([], 0) for s in range(4)]
            ways.append([{"edits": e, "state": s} for e, s in from_each])
        yield _of(b, ["g", "chunk", "cost", "illegal"], ways=pa.array(ways, pa.list_(pa.struct([("edits", pa.list_(pa.string())), ("state", pa.int64())]))))


def _chosen(batches):
    for b in batches:
        for g, parts in _lists(b, "g", "parts"):
            state, begins = START, []
            for p in parts:
                begins.append(state)
                state = p["states"][state]
            yield pa.RecordBatch.from_pydict({"g": pa.array([g] * len(parts)), "chunk": pa.array([p["chunk"] for p in parts], pa.int64()), "begin": pa.array(begins, pa.int64())})


def edits(chunks: DataFrame) -> DataFrame:
    """(g, chunk, cost, illegal, edits) from (g, chunk, codes): the cheapest
    edits, of several the ASCII-least, by turn."""

    def folded(parts: DataFrame, f, out: str) -> DataFrame:
        item = F.struct("chunk", *(c for c in parts.columns if c not in ("g", "chunk")))
        return parts.groupBy("g").agg(F.array_sort(F.collect_list(item)).alias("parts")).mapInArrow(f, f"g string, chunk long, {out}")

    ends = folded(chunks.mapInArrow(_matrices, "g string, chunk long, matrix array<long>, illegal long, ends binary"), _ends, "after array<long>, last boolean, cost long, illegal long")
    walked = chunks.join(ends, ["g", "chunk"]).mapInArrow(_walks, "g string, chunk long, cost long, illegal long, ways array<struct<edits array<string>, state long>>")
    walked = stored(walked, "walks")
    begins = folded(walked.select("g", "chunk", F.col("ways.state").alias("states")), _chosen, "begin long")
    return walked.join(begins, ["g", "chunk"]).select("g", "chunk", "cost", "illegal", F.get("ways", F.col("begin").cast("int"))["edits"].alias("edits"))


def _hashed(batches):
    """SHA-256 over the lines of each group, which come in order."""
    held, state = None, None
    done: dict = {"g": [], "repaired_sha256": []}
    for b in batches:
        for g, lines in _lists(b, "g", "lines"):
            if g != held:
                if held is not None:
                    done["g"].append(held), done["repaired_sha256"].append(state.hexdigest())
                held, state, joint = g, hashlib.sha256(), b""
            for line in lines or ():
                state.update(joint + line.encode())
                joint = b"\n"
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string()) for k, v in done.items()})
        done = {k: [] for k in done}
    if held is not None:
        yield pa.RecordBatch.from_pydict({"g": pa.array([held]), "repaired_sha256": pa.array([state.hexdigest()])})


def _lines(edit: Column) -> Column:
    """The lines that a turn's edits leave."""
    line = {"K": F.concat("role", F.lit(":"), "text"), "U": F.concat(F.lit("user:"), "text"), "A": F.concat(F.lit("assistant:"), "text"), "i": F.lit("user:"), "j": F.lit("assistant:")}
    of = lambda x: F.coalesce(*(F.when(x == k, v) for k, v in line.items()))
    return F.filter(F.transform(F.split(edit, ""), of), lambda x: x.isNotNull())


def _id(c: Column) -> Column:
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit("="), c.cast("string")))


def damaged(rows: DataFrame) -> DataFrame:
    """(g, turn, role, text): conversations with faults by crc32 of id and turn."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    d = rows.select(_id(F.col("conv_id")).alias("g"), "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("g", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def faults(turns: DataFrame) -> DataFrame:
    """Adds ``fault`` (the first of blank, duplicate, truncated, or null) to numbered turns, and drops texts."""
    content = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    light = turns.select("g", "at", "turn", F.substring("role", 1, 1).alias("initial"), (content == "").alias("blank"), (~F.substring(content, -1, 1).isin(".", "!", "?")).alias("cut"), same.alias("same"))
    # a turn is the first of its kind or not: joined by its own place, so that a turn repeated at will is no hot key
    first = light.groupBy("g", "same").agg(F.min("at").alias("at")).select("g", "at", F.lit(True).alias("first"))
    met = light.drop("same").join(first, ["g", "at"], "left")
    return met.withColumn("fault", F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")).select("g", "at", "turn", "initial", "fault")


def repair(turns: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Numbered turns with their ``edit``, and a row for each g: its faults, cost and audit."""
    told = stored(faults(turns), "faults")
    role = F.when(F.col("initial") == "", 0).otherwise(F.instr(F.lit(ROLES[1:]), F.col("initial")))
    code = role + F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isNotNull(), 8).otherwise(0)
    coded = told.select("g", F.floor(F.col("at") / chunk).cast("long").alias("chunk"), "at", code.cast("long").alias("code"))
    each = coded.groupBy("g", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))
    codes = F.unhex(F.array_join(F.transform("c", lambda x: F.lpad(F.hex(x["code"]), 2, "0")), ""))
    edited = stored(edits(stored(each.select("g", "chunk", codes.alias("codes")), "chunks")), "edits")
    by_turn = edited.select("g", "chunk", F.posexplode("edits").alias("k", "edit")).select("g", (F.col("chunk") * chunk + F.col("k")).alias("at"), "edit")
    kinds = ("blank", "duplicate", "truncated")
    counts = told.groupBy("g", "turn").agg(*(F.coalesce(F.sum((F.col("fault") == x).cast("long")), F.lit(0)).alias(x) for x in kinds)).groupBy("g").agg(*(F.sum(x).alias(x) for x in kinds), (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    letters = F.translate(F.array_join("edits", ""), "UAij", "RRII").alias("s")
    audit = edited.select("g", "chunk", "cost", "illegal", letters).groupBy("g").agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_sort(F.collect_list(F.struct("chunk", "s"))).alias("s"))
    audit = audit.select("g", "cost", "illegal", F.array_join(F.transform("s", lambda x: x["s"]), "").alias("audit"))
    return turns.join(by_turn, ["g", "at"]), counts.join(audit, "g")


def digest(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Damages and repairs conversations: a row for each conv_id."""
    rows = rows.select("conv_id", "turn", "role", "text")
    turns = ranked(damaged(rows), "g", ["turn", "role", "text"])
    edited, summary = repair(turns, chunk)
    lines = edited.select("g", "at", _lines(F.col("edit")).alias("lines")).repartition("g").sortWithinPartitions("g", "at").select("g", "lines")
    hashes = lines.mapInArrow(_hashed, "g string, repaired_sha256 string")
    every = rows.select("conv_id", _id(F.col("conv_id")).alias("g")).distinct()
    out = every.join(summary, "g", "left").join(hashes, "g", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
