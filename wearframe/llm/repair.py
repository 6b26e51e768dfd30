"""Conversation structure repair: the cheapest edits that make the roles alternate, found with big-integer weights.

A conversation is a path through a small acyclic graph: a node is (rows read, what the output ends with), an edge is one edit. A path's weight is one integer:
its high digits are the cost, its low digits (three bits a letter, a fixed width, zeros behind the last letter) spell the edits in order. The smaller integer
is the cheaper repair and, at equal cost, the ASCII-least spelling, so an ordinary minimum over integers decides everything.

Rows are cut into cells of consecutive rows. A cell becomes a table of best weights from every state to every state, the tables of a conversation are joined
in order, and no task has to hold the rows of a long conversation. Only narrow facts (keys, checksums, flags) take that way; texts are shuffled
once, at the end, where each conversation streams through one task into its digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type

from wearframe.llm.common import staged

#: Rows of a cell: 2 to this power.
CELL_BITS = 12
#: Tables of short cells that a worker remembers.
KNOWN = 1 << 16
#: What the output ends with: nothing, a system row, a user row, an assistant row.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: Where a user or assistant row that is inserted or given a new role leads.
TURN = (USER, USER, ASSISTANT, USER)
#: Letters of the edits, in ASCII order, so that their digits order like the letters.
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
DIGIT = 3
ROLE = {"u": "user", "a": "assistant"}


class Weights:
    """Integers of `width` letters: cost in the high digits, letters in the low ones."""

    def __init__(self, width: int):
        self.bits = DIGIT * width
        self.low = (1 << self.bits) - 1

    def before(self, letter: int, cost: int, rest: int | None) -> int | None:
        """The weight of an edit followed by `rest` (None: no way)."""
        if rest is None:
            return None
        code = rest & self.low
        return rest - code + (cost << self.bits) + (letter << self.bits - DIGIT) + (code >> DIGIT)

    def of(self, cost: int, letters: str) -> int:
        code = 0
        for x in letters:
            code = code << DIGIT | LETTERS.index(x)
        return (cost << self.bits) + (code << self.bits - DIGIT * len(letters))

    def read(self, weight: int) -> tuple[int, str]:
        code = weight & self.low
        out = []
        for at in range(self.bits - DIGIT, -1, -DIGIT):
            digit = code >> at & 7
            if not digit:
                break
            out.append(LETTERS[digit])
        return weight >> self.bits, "".join(out)


def least(*weights: int | None) -> int | None:
    return min((w for w in weights if w is not None), default=None)


def over_row(weights: Weights, initial: str, fault: str, rest: list[int | None]) -> list[int | None]:
    """Best weights in front of a row, given those behind it; the row may be preceded by inserted rows."""
    late = int(fault == "t")
    level: list[int | None] = []
    for q in STATES:
        ways = [weights.before(DELETE, COST[DELETE], rest[q])]
        if fault not in "bd":
            ways.append(weights.before(REROLE, COST[REROLE] + late, rest[TURN[q]]))
            if initial == "s" and q == NOTHING:
                ways.append(weights.before(KEEP, late, rest[SYSTEM]))
            elif initial == "ua"[TURN[q] == ASSISTANT]:
                ways.append(weights.before(KEEP, late, rest[TURN[q]]))
        level.append(least(*ways))
    # a third insertion in a row would come back to a state already passed, at a higher cost
    once = [least(level[q], weights.before(INSERT, COST[INSERT], level[TURN[q]])) for q in STATES]
    return [least(level[q], weights.before(INSERT, COST[INSERT], once[TURN[q]])) for q in STATES]


def cell_table(rows: list[tuple[str, str]]) -> list[list[tuple[int, str] | None]]:
    """Best (cost, letters) from every state before the rows to every state behind them; rows are (initial, fault)."""
    weights = Weights(3 * len(rows))
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for end in STATES:
        rest: list[int | None] = [0 if q == end else None for q in STATES]
        for initial, fault in reversed(rows):
            rest = over_row(weights, initial, fault, rest)
        for q in STATES:
            if rest[q] is not None:
                table[q][end] = weights.read(rest[q])
    return table


#: Behind the last row: rows to insert until the output is empty or ends with an assistant row.
ENDING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def join_cells(tables: list[list[list[tuple[int, str] | None]]]) -> tuple[int, str, list[tuple[int, str]]]:
    """Cost, audit, and for every cell the state before it and its letters (those behind the last row in one more entry)."""
    width = sum(max(len(x[1]) for row in t for x in row if x) for t in tables) + 2
    weights = Weights(width)
    best: list[int | None] = [weights.of(COST[INSERT] * len(ENDING[q]), ENDING[q]) for q in STATES]
    chosen: list[list[int]] = []
    for table in reversed(tables):
        ways: list[list[tuple[int, int]]] = [[] for _ in STATES]
        for q in STATES:
            for end in STATES:
                if table[q][end] is not None and best[end] is not None:
                    cost, letters = table[q][end]
                    code = best[end] & weights.low
                    ahead = weights.of(cost, letters) + best[end] - code + (code >> DIGIT * len(letters))
                    ways[q].append((ahead, end))
        best = [min(w)[0] if w else None for w in ways]
        chosen.append([min(w)[1] if w else 0 for w in ways])
    cost, audit = weights.read(best[NOTHING])
    state, parts = NOTHING, []
    for table, ends in zip(tables, reversed(chosen), strict=True):
        parts.append((state, table[state][ends[state]][1]))
        state = ends[state]
    return cost, audit, [*parts, (state, ENDING[state])]


def row_edits(state: int, rows: list[tuple[str, int]], letters: str, behind: str) -> list[dict]:
    """Edits of a cell by row: roles inserted before it, what happens to it, its new role, and roles inserted behind it.

    Rows are (initial, copies). A row takes a letter for each copy; of its copies only the first can stay. `behind` are the letters after the last row.
    """
    out: list[dict] = []
    at = 0

    def inserted() -> str:
        nonlocal state, at
        roles = ""
        while at < len(letters) and letters[at] == "I":
            state = TURN[state]
            roles += "u" if state == USER else "a"
            at += 1
        return roles

    for initial, copies in rows:
        edit = {"pre": inserted(), "act": letters[at], "to": None, "post": ""}
        at += 1
        if edit["act"] != "D":
            state = SYSTEM if edit["act"] == "K" and initial == "s" else TURN[state]
        if edit["act"] == "R":
            edit["to"] = "user" if state == USER else "assistant"
        for _ in range(copies - 1):
            edit["post"] += inserted()
            at += 1
        out.append(edit)
    for _ in behind:
        state = TURN[state]
        out[-1]["post"] += "u" if state == USER else "a"
    return out


# Between tasks a cell's rows are written as `<initial><fault><copies>` joined by commas, and its table as `<from><to><cost>:<letters>` joined by commas.


def parse_rows(spec: str) -> list[tuple[str, str, int]]:
    return [(x[0], x[1], int(x[2:])) for x in spec.split(",")]


def written_table(spec: str) -> str:
    rows = []
    for initial, fault, copies in parse_rows(spec):
        rows.append((initial, fault))
        rows += [(initial, "b" if fault == "b" else "d")] * (copies - 1)
    table = cell_table(rows)
    return ",".join(f"{q}{e}{table[q][e][0]}:{table[q][e][1]}" for q in STATES for e in STATES if table[q][e])


@arrow_udf(T.StringType())
def cell_tables(specs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # short conversations look alike; only those are remembered
    known: dict[str, str] = {}
    for column in specs:
        out = []
        for spec in column.to_pylist():
            table = known.get(spec) or written_table(spec)
            if len(spec) < 64 and len(known) < KNOWN:
                known[spec] = table
            out.append(table)
        yield pa.array(out, pa.string())


def parse_table(text: str) -> list[list[tuple[int, str] | None]]:
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
    for entry in text.split(","):
        head, letters = entry.split(":")
        table[int(head[0])][int(head[1])] = (int(head[2:]), letters)
    return table


PATH = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("parts", pa.list_(pa.struct([("state", pa.int32()), ("letters", pa.string()), ("behind", pa.string())])))])


@arrow_udf(from_arrow_type(PATH))
def best_path(tables: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in tables:
        out = []
        for cells in column.to_pylist():
            cost, audit, parts = join_cells([parse_table(t) for t in cells])
            last = len(parts) - 2
            out.append({"cost": cost, "audit": audit, "parts": [{"state": s, "letters": x, "behind": parts[-1][1] if i == last else ""} for i, (s, x) in enumerate(parts[:-1])]})
        yield pa.array(out, PATH)


EDIT = pa.struct([("pre", pa.string()), ("act", pa.string()), ("to", pa.string()), ("post", pa.string())])


@arrow_udf(from_arrow_type(pa.list_(EDIT)))
def cell_edits(specs: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for columns in specs:
        out = []
        for spec, state, letters, behind in zip(*[c.to_pylist() for c in columns], strict=True):
            out.append(row_edits(state, [(i, n) for i, _, n in parse_rows(spec)], letters, behind))
        yield pa.array(out, pa.list_(EDIT))


#: Rows that become Python objects at a time while texts stream into digests.
ROWS = 128
KEYS = ["__c", "turn", "role", "__digest"]


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order (an edit, then the texts it is about) -> `__c`, `repaired_sha256`. Of a conversation only a running digest is held."""
    conversation, key, digest, empty = None, None, None, True
    edit: dict | None = None
    done: list[tuple[str, str]] = []

    def write(line: str) -> None:
        nonlocal empty
        digest.update((line if empty else "\n" + line).encode("utf-8", "surrogatepass"))
        empty = False

    def close_edit() -> None:
        nonlocal edit
        if edit is not None:
            for x in edit["post"]:
                write(f"{ROLE[x]}:")
        edit = None

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], names=["__c", "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            for r in batch.slice(at, ROWS).to_pylist():
                if r["__c"] != conversation:
                    close_edit()
                    if conversation is not None:
                        done.append((conversation, digest.hexdigest()))
                    conversation, key, digest, empty = r["__c"], None, hashlib.sha256(), True
                if r["__edit"]:
                    close_edit()
                    key, edit = (r["turn"], r["role"], r["__digest"]), r
                    for x in r["pre"]:
                        write(f"{ROLE[x]}:")
                elif key == (r["turn"], r["role"], r["__digest"]):
                    # of equal rows the first one is written
                    key = None
                    if edit["act"] != "D":
                        write(f"{edit['to'] or r['role']}:{r['text']}")
        if done:
            yield flush()
    close_edit()
    if conversation is not None:
        done.append((conversation, digest.hexdigest()))
        yield flush()


def damage(rows: DataFrame) -> DataFrame:
    """Damaged `conv_id`, `turn`, `role`, `text` and `copies`, by the checksum of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's. Nulls count as one space, in the checksum and in role and text."""
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    hit = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("__d"))
    text = F.when(F.col("__d") == 1, "").when(F.col("__d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__d") == 4, "user").otherwise(F.col("role"))
    return hit.filter("__d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("__d") == 3, 2).otherwise(1).alias("copies"))


def facts_of(damaged: DataFrame) -> DataFrame:
    """One narrow row per different row: keys, text digest, initial (s, u, a or x), fault in itself (b, t or o) and how often it stands."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    first = F.substring("role", 1, 1)
    own = F.when(stripped == "", "b").when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), "o").otherwise("t")
    narrow = damaged.select(key_of_conversation().alias("__c"), "turn", "role", F.md5("text").alias("__digest"), F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"), own.alias("own"), "copies")
    return narrow.groupBy(*KEYS).agg(F.min("initial").alias("initial"), F.min("own").alias("own"), F.sum("copies").alias("copies"))


def key_of_conversation() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def cells_of(facts: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """Cells of consecutive rows: `__c`, `cell`, `rows` in order, `spec`, counts of faults and `illegal` pairs inside, and the initials at both ends.

    Rows are dealt by range of their whole key, so one conversation spreads over many tasks; a row's number grows with its place.
    """
    order = [F.col(k).asc_nulls_first() for k in KEYS]
    placed = staged(facts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "repair-facts")
    said = placed.groupBy("__c", "role", "__digest").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").drop("__n")
    fault = F.when(F.col("own") == "b", "b").when(F.col("__at") > F.col("__first"), "d").otherwise(F.col("own"))
    judged = placed.join(said, ["__c", "role", "__digest"], "left").withColumn("fault", fault).withColumn("cell", F.shiftright("__at", cell_bits))
    row = F.struct("__at", "turn", "role", "__digest", "initial", "fault", "copies")
    late = F.col("copies") - 1
    cells = judged.groupBy("__c", "cell").agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.sum(F.when(F.col("fault") == "b", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "b", 0).when(F.col("fault") == "d", F.col("copies")).otherwise(late)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "t", 1).otherwise(0)).alias("truncated"), F.sum(late).alias("__same"),
    )
    pair = F.concat(F.col("rows")[F.lit(0)]["initial"], F.lit(""))
    initials = F.array_join(F.transform("rows", lambda r: r["initial"]), "")
    # consecutive initials, two by two
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows")), lambda i: F.substring(F.col("__initials"), i, F.lit(2)))
    bad = F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au")))
    return cells.withColumn("__initials", initials).select(
        "__c", "cell", "rows", F.array_join(F.transform("rows", lambda r: F.concat(r["initial"], r["fault"], r["copies"].cast("string"))), ",").alias("spec"),
        "blank", "duplicate", "truncated", (F.col("__same") + bad).cast("long").alias("illegal"), pair.alias("head"), F.right("__initials", F.lit(1)).alias("tail"),
    )


def repair(rows: DataFrame, *, cell_bits: int = CELL_BITS) -> DataFrame:
    """The cheapest repair of every conversation of damaged rows (`conv_id`, `turn`, `role`, `text`, optionally `copies`; no nulls in role and text).

    One row per conversation: `__c` (its key), gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256. Rows are taken by turn (nulls
    first), then role, then text digest. Edits: keep (0; initial s only as the first row of the output), give the role user or assistant (2), delete (3; the
    only way for blank and repeated rows), insert an empty user or assistant row (2); a truncated row that stays costs 1 more. Null conversation ids are one
    conversation. An empty table gives no rows. The audit of a conversation is one value, as long as its edits.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1))
    cells = staged(cells_of(facts_of(rows), cell_bits).withColumn("table", cell_tables("spec")), "repair-cells")
    ordered = cells.groupBy("__c").agg(
        F.array_sort(F.collect_list(F.struct("cell", "table", "head", "tail"))).alias("cells"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    )
    steps = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.when(i == 0, "ua").otherwise(F.concat(F.get("cells", i - 1)["tail"], F.get("cells", i)["head"])))
    solved = ordered.select(
        "__c", "blank", "duplicate", "truncated", (F.col("illegal") + F.size(F.filter(steps, lambda p: ~p.isin("su", "ua", "au")))).alias("illegal"),
        F.transform("cells", lambda c: c["cell"]).alias("__order"), best_path(F.transform("cells", lambda c: c["table"])).alias("path"),
    )
    solved = staged(solved, "repair-paths")
    parts = solved.select("__c", F.explode(F.arrays_zip("__order", F.col("path.parts").alias("part"))).alias("p"))
    parts = parts.select("__c", F.col("p.__order").alias("cell"), "p.part.state", "p.part.letters", "p.part.behind")
    edits = cells.select("__c", "cell", "rows", "spec").join(parts, ["__c", "cell"])
    edits = edits.select("__c", F.explode(F.arrays_zip("rows", cell_edits("spec", "state", "letters", "behind").alias("edit"))).alias("e"))
    edits = edits.select("__c", "e.rows.turn", "e.rows.role", "e.rows.__digest", F.lit(True).alias("__edit"), "e.edit.pre", "e.edit.act", "e.edit.to", "e.edit.post", F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast("string").alias(c) for c in ("pre", "act", "to", "post")]
    texts = rows.select(key_of_conversation().alias("__c"), "turn", "role", F.md5("text").alias("__digest"), F.lit(False).alias("__edit"), *none, "text")
    needed = edits.filter("act <> 'D' or pre <> '' or post <> ''")
    ordered = needed.unionByName(texts).repartition("__c").sortWithinPartitions("__c", F.col("turn").asc_nulls_first(), "role", "__digest", F.desc("__edit"))
    digests = ordered.mapInArrow(streamed_digests, "__c string, repaired_sha256 string")
    turns = rows.select(key_of_conversation().alias("__c"), "turn").groupBy("__c", "turn").agg(F.lit(1).alias("one"))
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = turns.groupBy("__c").agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")).alias("g")).select("__c", F.coalesce(F.col("g").try_cast("long"), F.lit(0)).alias("gaps"))
    return solved.select("__c", "blank", "duplicate", "truncated", "illegal", "path.cost", "path.audit").join(digests, "__c").join(gaps, "__c")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of `rows`, damaged (see `damage`) and repaired (see `repair`): conv_id and the columns of `repair`.

    A conversation whose rows are all dropped has zeros, an empty audit and the digest of nothing. Other columns of `rows` are not read.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    named = rows.select("conv_id").distinct().withColumn("__c", key_of_conversation())
    found = named.join(repair(damage(rows)), "__c", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
