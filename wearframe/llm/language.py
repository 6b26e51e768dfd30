"""Language identification of (possibly code-switched) text with a linear-chain conditional random field over words.

Features of a word: its byte n-grams with the blanks around it (so that prefixes and suffixes are features of their own) and, for words of the lexicon, the
word itself. Weights and label transitions are learned from a bounded sample of labelled documents; training sequences splice runs of words of different
languages, so that transitions describe switching. Words are labelled by forward-backward; a document gets the language with the largest posterior sum.

Everything is vectorised over a batch of documents. Long texts are cut into segments whose transfer matrices are combined exactly, so the number
of sequential steps does not grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from wearframe.llm.common import aside, utf8_bytes

#: Bound of the labelled sample: documents of each language, and the longest document (bytes) that is taken.
FIT_DOCS = 150
MOST_LANGUAGES = 500
FIT_BYTES = 65_536
#: Words of the spliced training sequences, their length, and the mean run of one language.
FIT_WORDS = 200_000
SEQUENCE = 64
RUN = 16
ORDERS = (2, 3, 4)
TABLE_BITS = 17
#: A word belongs to the lexicon if the sample has it this often.
LEXICON_COUNT = 5
#: Words of a segment, and bytes of text handled at a time.
SEGMENT = 1024
#: Segments whose posteriors are held at a time, and bytes of a long text that are read at a time.
SEGMENTS = 1 << 14
WINDOW = 2 << 20
BATCH = 2 << 20
UNKNOWN = "und"

#: Letters a-z (A-Z folded) and all non-ASCII bytes are word bytes; the rest become blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


@dataclass
class Words:
    """Words of a buffer: `first` and `last` byte (exclusive) of each, n-gram table rows by order, and a 64-bit hash of each word."""

    first: np.ndarray
    grams: list[np.ndarray]
    hashes: np.ndarray


def read_words(folded: np.ndarray) -> Words:
    """`folded` starts with a blank and ends with four; table row 0 stands for no feature."""
    letter = folded != 32
    first = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    last = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    n = len(folded) - 3
    wide = folded.astype(np.uint32)
    grams = []
    for order in ORDERS:
        h = np.full(n, order * 0x9E37, np.uint32)
        for k in range(order):
            h = h * np.uint32(0x01000193) ^ wide[k : n + k]
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - TABLE_BITS)
        ok = letter[:n] | letter[1 : n + 1]
        for k in range(1, order - 1):
            ok &= letter[k : n + k]
        grams.append(np.where(ok, np.maximum(h, 1), 0).astype(np.int32))
    terms = np.cumsum(folded.astype(np.uint64) * _powers(_PRIME, len(folded)))
    hashes = (terms[last - 1] - terms[first - 1]) * _powers(_INVERSE, len(folded))[first]
    return Words(first, grams, hashes)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # labels x 2^TABLE_BITS
    lexicon: np.ndarray  # sorted word hashes
    lexical: np.ndarray  # labels x (lexicon + 1), the last column for other words
    moves: np.ndarray  # transition log weights


def lexicon_rows(hashes: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    at = np.searchsorted(lexicon, hashes)
    at[at == len(lexicon)] = 0
    return np.where(lexicon[at] == hashes, at, len(lexicon)) if len(lexicon) else np.zeros(len(hashes), np.int64)


def emissions(words: Words, model: Model) -> np.ndarray:
    """Log weights, words x labels."""
    starts = words.first - 1
    out = np.empty((len(starts), len(model.labels)), np.float32)
    row = lexicon_rows(words.hashes, model.lexicon)
    for label in range(len(model.labels)):
        total = model.lexical[label][row]
        for gram in words.grams:
            total = total + np.add.reduceat(model.table[label][gram], starts)
        out[:, label] = total
    return out


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def posterior_sums(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """Sum of the words' label posteriors of each document (documents x labels); `lengths` has the words of each, 0 allowed."""
    n_labels = emission.shape[1]
    weight = np.exp(emission - emission.max(axis=1, keepdims=True, initial=-np.inf)) if len(emission) else emission
    step = np.exp(moves - moves.max()).astype(np.float64)
    step /= step.sum(axis=1, keepdims=True)
    doc_start = np.cumsum(lengths) - lengths
    per_doc = -(-lengths // segment)
    seg_doc = np.repeat(np.arange(len(lengths)), per_doc)
    seg_no = np.arange(len(seg_doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = doc_start[seg_doc] + seg_no * segment
    size = np.minimum(lengths[seg_doc] - seg_no * segment, segment)
    order = np.argsort(-size, kind="stable")
    active = lambda sizes, t: int(np.searchsorted(-sizes, -t, side="left"))  # noqa: E731  rows with more than t words; sizes descend

    prior = np.full((len(seg_doc), n_labels), 1.0 / n_labels)
    after = np.ones((len(seg_doc), n_labels))
    long_segments = order[per_doc[seg_doc[order]] > 1]
    if len(long_segments):
        # transfer matrix of each segment: what a prior on its first word becomes at its last word
        sizes, at = size[long_segments], start[long_segments]
        matrix = np.broadcast_to(np.eye(n_labels), (len(long_segments), n_labels, n_labels)).copy() * weight[at][:, None, :]
        log_scale = np.zeros((len(long_segments), n_labels))
        for t in range(int(sizes[0])):
            k = active(sizes, t)
            if t:
                matrix[:k] = (matrix[:k].reshape(-1, n_labels) @ step).reshape(k, n_labels, n_labels) * weight[at[:k] + t][:, None, :]
            total = np.maximum(matrix[:k].sum(axis=2), 1e-300)
            matrix[:k] /= total[:, :, None]
            log_scale[:k] += np.log(total)
        matrix *= np.exp(log_scale - log_scale.max(axis=1, keepdims=True))[:, :, None]
        place = np.empty(len(seg_doc), np.int64)
        place[long_segments] = np.arange(len(long_segments))
        for i in np.sort(long_segments):
            if seg_no[i]:
                prior[i] = _scaled(prior[i - 1] @ matrix[place[i - 1]]) @ step
        for i in np.sort(long_segments)[::-1]:
            if seg_no[i] < per_doc[seg_doc[i]] - 1:
                after[i] = _scaled(step @ (matrix[place[i + 1]] @ after[i + 1]))

    out = np.zeros((len(lengths), n_labels))
    # segments are independent now; a bounded number at a time, longest first
    for first in range(0, len(order), SEGMENTS):
        part = order[first : first + SEGMENTS]
        sizes, at = size[part], start[part]
        own = np.cumsum(sizes) - sizes
        forward = np.empty((int(sizes.sum()), n_labels))
        alpha = prior[part]
        for t in range(int(sizes[0])):
            k = active(sizes, t)
            alpha = alpha[:k] @ step if t else alpha[:k]
            alpha = _scaled(alpha * weight[at[:k] + t])
            forward[own[:k] + t] = alpha
        sums = np.zeros((len(part), n_labels))
        beta = after[part]
        for t in range(int(sizes[0]) - 1, -1, -1):
            k = active(sizes, t)
            sums[:k] += _scaled(forward[own[:k] + t] * beta[:k])
            beta[:k] = _scaled((beta[:k] * weight[at[:k] + t]) @ step.T)
        np.add.at(out, seg_doc[part], sums)
    return out


def fit(samples: list[tuple[str, bytes]], rounds: int = 5, parts: int = 4, rate: float = 0.5, decay: float = 1e-6, seed: int = 5) -> Model:
    """Learns a model from (language, text) pairs by adaptive gradient steps on the conditional likelihood of spliced sequences."""
    labels = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    pools = []
    for lang in labels:
        joined = b" ".join(t for name, t in samples if name == lang).translate(FOLD)
        pools.append(read_words(np.frombuffer(b" " + joined + b"    ", np.uint8)))
    found, times = np.unique(np.concatenate([p.hashes for p in pools]), return_counts=True) if pools else (np.empty(0, np.uint64), np.empty(0))
    lexicon = found[times >= LEXICON_COUNT]
    n = len(labels)
    model = Model(labels, np.zeros((n, 1 << TABLE_BITS), np.float32), lexicon, np.zeros((n, len(lexicon) + 1), np.float32), np.zeros((n, n)))
    usable = [i for i, p in enumerate(pools) if len(p.first)]
    if not usable:
        return model
    # spliced sequences: (label, word of the label's pool)
    total = min(FIT_WORDS, 4 * sum(len(p.first) for p in pools)) // SEQUENCE * SEQUENCE or SEQUENCE
    turn = np.cumsum(rng.random(total) < 1 / RUN)
    run_start = np.flatnonzero(np.diff(turn, prepend=-1))
    run_label = rng.choice(usable, len(run_start))
    run_from = np.array([rng.integers(len(pools[i].first)) for i in run_label])
    of_run = np.cumsum(np.diff(turn, prepend=turn[0])) if total else turn
    label = run_label[of_run]
    offset = np.arange(total) - run_start[of_run]
    word = (run_from[of_run] + offset) % np.array([max(len(p.first), 1) for p in pools])[label]
    # features of every word of the sequences, flattened
    feature, owner, lexical = [], [], np.empty(total, np.int64)
    for i in usable:
        mine = np.flatnonzero(label == i)
        pool = pools[i]
        ends = np.append(pool.first[1:] - 1, len(pool.grams[0]))
        begin, length = pool.first[word[mine]] - 1, (ends - (pool.first - 1))[word[mine]]
        where = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        for gram in pool.grams:
            got = gram[where]
            feature.append(got[got > 0])
            owner.append(np.repeat(mine, length)[got > 0])
        lexical[mine] = lexicon_rows(pool.hashes[word[mine]], lexicon)
    feature, owner = np.concatenate(feature), np.concatenate(owner)
    by_owner = np.argsort(owner, kind="stable")
    feature, owner = feature[by_owner], owner[by_owner]
    seen = [np.full_like(a, 1e-8, dtype=np.float64) for a in (model.table, model.lexical, model.moves)]
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(total // SEQUENCE), parts):
            position = (part[:, None] * SEQUENCE + np.arange(SEQUENCE)).ravel()
            inside = np.zeros(total, np.int64) - 1
            inside[position] = np.arange(len(position))
            mine = inside[owner] >= 0
            f, o = feature[mine], inside[owner[mine]]
            lex, truth = lexical[position], label[position]
            e = np.stack([np.bincount(o, model.table[k][f], len(position)) + model.lexical[k][lex] for k in range(n)], axis=1)
            unary, pairs = marginals(e.reshape(-1, SEQUENCE, n), model.moves)
            error = np.eye(n)[truth] - unary.reshape(-1, n)
            t2 = truth.reshape(-1, SEQUENCE)
            counted = np.zeros((n, n))
            np.add.at(counted, (t2[:, :-1].ravel(), t2[:, 1:].ravel()), 1)
            scale = 1.0 / len(position)
            gradients = [
                np.stack([np.bincount(f, error[o, k], 1 << TABLE_BITS) for k in range(n)]) * scale - decay * model.table,
                np.stack([np.bincount(lex, error[:, k], len(lexicon) + 1) for k in range(n)]) * scale - decay * model.lexical,
                (counted - pairs) * scale - decay * model.moves,
            ]
            for weights, g, s in zip((model.table, model.lexical, model.moves), gradients, seen, strict=True):
                s += g * g
                weights += (rate * g / np.sqrt(s)).astype(weights.dtype)
    model.table[:, 0] = 0
    return model


def marginals(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (sequences x words x labels) and expected transitions of equally long sequences; the transition weights are not normalised here."""
    weight = np.exp(e - e.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    length = e.shape[1]
    alpha, beta = np.empty_like(weight), np.ones_like(weight)
    alpha[:, 0] = _scaled(weight[:, 0])
    for t in range(1, length):
        alpha[:, t] = _scaled((alpha[:, t - 1] @ step) * weight[:, t])
    for t in range(length - 2, -1, -1):
        beta[:, t] = _scaled((beta[:, t + 1] * weight[:, t + 1]) @ step.T)
    pairs = np.zeros_like(moves)
    for t in range(length - 1):
        joint = alpha[:, t, :, None] * step[None] * (weight[:, t + 1] * beta[:, t + 1])[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return _scaled(alpha * beta), pairs


def windowed(folded: bytes, model: Model) -> np.ndarray:
    """`emissions` of a long text, read in windows that end between words. Features lie inside a word and its blanks, so the result is that of the whole."""
    out, at = [np.empty((0, len(model.labels)), np.float32)], 0
    while at < len(folded):
        stop = folded.find(b" ", at + WINDOW)
        stop = len(folded) if stop < 0 else stop
        words = read_words(np.frombuffer(b" " + folded[at:stop] + b"    ", np.uint8))
        if len(words.first):
            out.append(emissions(words, model))
        at = stop
    return np.concatenate(out)


def predict(raws: list[bytes | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Label number (-1 without words) and mean posterior of each text."""
    folded = [(t or b"").translate(FOLD) for t in raws]
    label, score = np.full(len(raws), -1, np.int64), np.zeros(len(raws))
    if len(raws) == 1 and len(folded[0]) > WINDOW and model.labels:
        found = windowed(folded[0], model)
        if len(found):
            sums = posterior_sums(found, np.array([len(found)]), model.moves)
            label[0], score[0] = sums[0].argmax(), min(sums[0].max() / len(found), 1.0)
        return label, score
    buffer = np.frombuffer(b" " + b" ".join(folded) + b"    ", np.uint8)
    words = read_words(buffer)
    sizes = np.array([len(t) + 1 for t in folded], np.int64)
    edges = np.cumsum(sizes) + 1
    counts = np.diff(np.searchsorted(words.first, edges, side="left"), prepend=0)
    if len(words.first) and model.labels:
        sums = posterior_sums(emissions(words, model), counts, model.moves)
        some = counts > 0
        label[some] = sums[some].argmax(axis=1)
        score[some] = np.minimum(sums[some].max(axis=1) / counts[some], 1.0)
    return label, score


def batches(raws: list[bytes | None], size: int = BATCH) -> Iterator[list[bytes | None]]:
    held, total = [], 0
    for t in raws:
        if held and total + len(t or b"") > size:
            yield held
            held, total = [], 0
        held.append(t)
        total += len(t or b"")
    if held:
        yield held


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose CRC-32 of the id as text is a multiple of 5; a null id is not held out and is not learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str, most: int = FIT_DOCS) -> list[tuple[str, bytes]]:
    """At most `most` documents of each language, the first by hash of the id, for learning; of rows that share an id and a language one is taken."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.filter(F.octet_length(text_col) <= FIT_BYTES)
    # the commonest languages are a small table of known size, so texts are thinned out where they lie
    counts = usable.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.desc("__n"), "__lang").limit(MOST_LANGUAGES)
    draw = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)
    rows = usable.select(F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"), F.xxhash64(id_col).alias("__h"), draw.alias("__draw"))
    # a draw with twice the wanted number comes before the exact cut, so no task orders a whole language
    drawn = rows.join(F.broadcast(counts), "__lang").filter(F.col("__draw") * F.col("__n") < 2.0 * most + 20)
    single = drawn.groupBy("__lang", "__draw", "__h").agg(F.min("__text").alias("__text"))
    cut = single.withColumn("__rank", F.row_number().over(Window.partitionBy("__lang").orderBy("__draw", "__h"))).filter(F.col("__rank") <= most)
    chosen = cut.select("__lang", F.lower("__text").cast("binary").alias("t"), "__h").collect()
    return [(r[0], bytes(r.t)) for r in sorted(chosen, key=lambda r: (r[0], r[2], bytes(r.t)))]


def identify(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """Adds `held_out`, `lang_pred` and `score` (0 to 1); columns of these names are replaced.

    Learns from rows that are not held out and have a language, an id and a text; predicts every row from its text alone. Null texts and texts without a letter
    are `und` with score 0, and so is everything if nothing could be learned. Repeated rows get equal results; an empty table gives an empty result.
    """
    model = fit(labelled_sample(docs, text_col, lang_col, id_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<label:int,score:double>")
    def classify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            labels, scores = [], []
            for part in batches(utf8_bytes(column)):
                label, score = predict(part, shared.value)
                labels.append(label)
                scores.append(score)
            joined = [np.concatenate(x) if x else np.empty(0) for x in (labels, scores)]
            yield pa.StructArray.from_arrays([pa.array(joined[0], pa.int32()), pa.array(joined[1], pa.float64())], ["label", "score"])

    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    names = F.array(*[F.lit(x) for x in model.labels]) if model.labels else F.array(F.lit(UNKNOWN))
    known = F.col("__lang_label.label").isNotNull() & (F.col("__lang_label.label") >= 0) & F.col("__letter")
    marked = docs.withColumn("__letter", has_letter).withColumn("__lang_label", classify(F.lower(F.col(text_col))))
    out = marked.withColumn("held_out", held_out(id_col))
    out = out.withColumn("lang_pred", F.when(known, F.get(names, F.col("__lang_label.label"))).otherwise(F.lit(UNKNOWN)))
    return out.withColumn("score", F.when(known, F.col("__lang_label.score")).otherwise(F.lit(0.0))).drop("__letter", "__lang_label")


def keep_identified(docs: DataFrame, least: float = 0.4, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """The rows whose language is known with at least `least` mean posterior, with the columns of `docs`."""
    hidden, place, back = aside(docs)
    marked = identify(hidden, text_col=place[text_col.lower()], lang_col=place[lang_col.lower()], id_col=place[id_col.lower()])
    return back(marked.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))
