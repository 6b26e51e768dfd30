"""Chat formatting by columnar byte assembly.

Rows are shuffled by conversation and sorted by turn; each Arrow batch is formatted at once: segment lengths give cumulative offsets, offsets give
scatter indices, and headers and contents are copied into one preallocated buffer that becomes the Arrow column. A conversation is one row unless it is
larger than a chunk; then it is cut between turns into numbered rows, so no size of conversation fills a worker's memory.

Template: `<|im_start|>` role newline text `<|im_end|>` newline. Inside roles and texts, every `<`, any number of backslashes, `|` gets one more backslash,
so no control string can appear there, and taking one away restores the text. A role's backslashes and newlines are written as backslash escapes first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
CHUNK = 8 << 20
TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    lined = pc.replace_substring(pc.replace_substring(column, pattern="\\", replacement="\\\\"), pattern="\n", replacement="\\n")
    return escape(lined)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array without nulls."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return at - at[0], raw


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of all rows, where each row's five segments start (rows x 5), and the lengths of the texts."""
    role_at, role_raw = column_bytes(roles)
    text_at, text_raw = column_bytes(texts)
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = len(START), len(MIDDLE), len(END)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel())
    starts = (ends - lengths.ravel()).reshape(n, 5)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for segment, constant in ((0, START), (2, MIDDLE), (4, END)):
        out[starts[:, segment, None] + np.arange(len(constant))] = np.frombuffer(constant, np.uint8)
    for segment, at, raw in ((1, role_at, role_raw), (3, text_at, text_raw)):
        out[np.arange(len(raw)) + np.repeat(starts[:, segment] - at[:-1], np.diff(at))] = raw
    return out, starts, lengths[:, 3]


def format_rows(ids: list, roles: pa.Array, texts: pa.Array, mask_role: str) -> tuple[list, list[int], pa.Array, pa.Array]:
    """Runs of equal ids as (ids, turns, formatted strings, loss spans in code points)."""
    first = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
    trains = np.array(pc.fill_null(pc.equal(roles, mask_role), False).to_pylist(), bool)
    out, starts, lengths = assemble(escape_role(roles), escape(texts))
    bounds = np.append(starts[first, 0], len(out))
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    points = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    turns = np.diff(np.append(first, len(ids)))
    base = np.repeat(points[bounds[:-1]], turns)
    begin = points[starts[:, 3]] - base
    end = points[starts[:, 3] + lengths] - base
    per_run = np.add.reduceat(trains.astype(np.int64), first)
    spans = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(per_run)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(begin[trains]), pa.array(end[trains])], ["start", "end"]),
    )
    return [ids[i] for i in first], turns.tolist(), formatted, spans


def format_conversations(
    rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", mask_role: str = "assistant", chunk: int = CHUNK,
) -> DataFrame:
    """One row per conversation (or chunk of one): id, `chunk`, `n_turns`, `formatted`, `loss_spans` (code points of `formatted`, end exclusive).

    Turns are ordered by turn (null first), then role, then text, so ties and repeated rows have a fixed order; each row is a turn. Null texts and roles
    count as empty. Rows without a conversation id form one conversation of their own. Other columns are not kept. An empty table gives an empty result.
    """
    kind = rows.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("__id", kind), T.StructField("chunk", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    narrow = rows.select(
        F.col(id_col).alias("__id"), F.col(turn_col).alias("__turn"), F.coalesce(F.col(role_col), F.lit("")).alias("__role"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        last, number = object(), 0

        def emit(table: pa.Table) -> pa.RecordBatch:
            nonlocal last, number
            table = table.combine_chunks()
            column = lambda k: table.column(k).combine_chunks() if isinstance(table.column(k), pa.ChunkedArray) else table.column(k)
            ids, turns, formatted, spans = format_rows(table.column("__id").to_pylist(), column("__role"), column("__text"), mask_role)
            numbers = []
            for i in ids:
                number = number + 1 if i == last else 0
                last = i
                numbers.append(number)
            columns = [pa.array(ids, table.schema.field("__id").type), pa.array(numbers, pa.int32()), pa.array(turns, pa.int64()), formatted, spans]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            for part in bounded(batch, chunk):
                table = pa.Table.from_batches([part])
                held = table if held is None else pa.concat_tables([held, table])
                ids = held.column("__id").to_pylist()
                cut = len(ids) - 1
                while cut > 0 and ids[cut - 1] == ids[-1]:
                    cut -= 1
                if held.nbytes > chunk and cut == 0:
                    cut = len(ids)  # one conversation above the chunk size
                if cut:
                    yield emit(held.slice(0, cut))
                    held = held.slice(cut) if cut < len(ids) else None
        if held is not None and held.num_rows:
            yield emit(held)

    # one conversation's rows meet in order; the sort spills, and the worker holds a chunk at a time
    ordered = narrow.repartition("__id").sortWithinPartitions("__id", F.col("__turn").asc_nulls_first(), "__role", "__text")
    return ordered.select("__id", "__role", "__text").mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def bounded(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each, or one row."""
    lengths = np.array(pc.binary_length(batch.column("__text")).to_pylist(), np.int64)
    block = np.cumsum(lengths) // size
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(lengths)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


#: Chunks that become Python objects at a time when they are read back.
ROWS = 16


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Parses formatted conversations: id, `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`.

    Turns are hashed as role, newline, text, newline; the loss text is what the spans mark, unescaped. Chunks are read in order.
    """
    kind = formatted.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def close(s) -> dict:
            return {id_col: s["id"], "n_turns": s["n"], "turns_sha256": s["turns"].hexdigest(), "loss_chars": s["loss_n"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["chars"]}

        for batch in batches:
            done = []
            # a few chunks at a time become Python objects
            for r in (r for at in range(0, batch.num_rows, ROWS) for r in batch.slice(at, ROWS).to_pylist()):
                if state is None or r["chunk"] == 0:
                    if state is not None:
                        done.append(close(state))
                    state = {"id": r[id_col], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
                text = r["formatted"]
                at = 0
                for m in TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {r[id_col]}: text outside of turns at {at}")
                    at = m.end()
                    state["turns"].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                    state["n"] += 1
                if at != len(text):
                    raise ValueError(f"conversation {r[id_col]}: text outside of turns at {at}")
                for s in r["loss_spans"]:
                    part = unescape(text[s["start"] : s["end"]])
                    state["loss"].update(part.encode())
                    state["loss_n"] += len(part)
                state["chars"] += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([close(state)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return formatted.repartition(id_col).sortWithinPartitions(id_col, "chunk").mapInArrow(run, schema)
