"""Personal data by weak supervision.

Four strict patterns give base spans, which always stay. Looser patterns propose further candidates. Labelers of three sorts vote on every candidate: regular
expressions (strict form, shape, checksum), gazetteers (issuers, dialling codes, mail endings, key prefixes) and context (words before it, what it touches). Vote patterns
of all documents are counted by Spark; expectation-maximisation on that small table estimates how reliable each labeler is per kind, and a logistic span
classifier is trained on its posteriors. A candidate that is no base span stays if the classifier says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

#: Order of kinds in results: the base kinds, then kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
LABELERS = ("strict", "shape", "checksum", "gazetteer", "before", "touching")

#: Fixed patterns of the base kinds, in parts that run in linear time.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Looser candidates.
LOOSE_PHONE = re.compile(r"(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){2,4}")
TOKEN = re.compile(r"[A-Za-z0-9_-]{20,}")
SPELLED_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(](?:dot|DOT)[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}")

#: Gazetteers.
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "2221", "2720", "30", "36", "38", "35")
DIALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "61", "81", "82", "86", "90", "91")
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "at", "ch", "us")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "pk-", "xoxb-", "xoxp-", "glpat-", "AIza")
SPEAKS_FOR = frozenset("email e-mail mail correo courriel contact tel telephone phone call fax mobile handy card visa ip host server token key secret password passwd pwd api apikey iban account".split())
SPEAKS_AGAINST = frozenset("version isbn issn page pages section figure table chapter license v doi rev build commit".split())

CANDIDATES = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Leftmost matches of the address pattern, found outwards from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1)
        if m and start < at:
            yield start, m.end(), True
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int, bool]]:
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            length = sum(map(len, four)) + 3
            yield at, at + length, all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in four)
            at += length + 1


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def cards(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 12 <= len(d) <= 20:
            yield m.start(), m.end(), 14 <= len(d) <= 19 and luhn(d)


def phones(text: str) -> Iterator[tuple[int, int, bool]]:
    for m in PHONE.finditer(text):
        yield m.start(), m.end(), 10 <= len(digits_of(m[0])) <= 15


def vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


def votes_of(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """The labelers' votes (+, -, 0 each), and two coarse features: length and share of digits."""
    span = text[start:end]
    digits = digits_of(span)
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text[max(0, start - 40) : start].lower())[-3:]
    if kind == "email":
        shape, checksum = vote(3 <= end - start <= 254, True), 0
        gazetteer = vote(span.lower().rsplit(".", 1)[-1].strip(" )]") in MAIL_ENDINGS, False)
    elif kind == "ip":
        shape, checksum, gazetteer = vote(all(len(p) <= 3 for p in span.split(".")), True), 0, vote(span.startswith(("10.", "192.168.", "127.")), False)
    elif kind == "card":
        shape = vote(len(digits) in (14, 15, 16, 19), len(digits) < 14 or len(digits) > 19)
        checksum, gazetteer = vote(luhn(digits), True), vote(digits.startswith(ISSUERS), len(set(digits)) < 3)
    elif kind == "phone":
        shape, checksum = vote(10 <= len(digits) <= 15 and len(set(digits)) > 2, True), 0
        gazetteer = vote(span.startswith("+") and digits.startswith(DIALLING), not span.startswith("+") and digits.startswith("0000"))
    else:
        letters = sum(c.isalpha() for c in span)
        hexadecimal = re.fullmatch(r"[0-9a-fA-F]+", span) is not None
        shape = vote((hexadecimal and len(span) in (32, 40, 48, 56, 64, 96, 128)) or (len(digits) >= 3 and letters >= 8 and not hexadecimal), True)
        checksum, gazetteer = vote(len(set(span)) >= 10, len(set(span)) < 6), vote(span.startswith(KEY_PREFIXES), False)
    context = vote(bool(SPEAKS_FOR & set(before)), bool(SPEAKS_AGAINST & set(before)))
    touching = vote(False, text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())
    ballots = (vote(strict, kind in BASE), shape, checksum, gazetteer, context, touching)
    return "".join("-0+"[v + 1] for v in ballots) + f"/{min((end - start) // 8, 8)}/{min(int(4 * len(digits) / (end - start)), 4)}"


def candidates(text: str | None) -> list[dict]:
    """Base spans and looser candidates that do not overlap them, in order of start, then kind."""
    if not text:
        return []
    found: list[tuple[int, int, str, bool]] = []
    has_digit = DIGIT.search(text) is not None
    if "@" in text:
        found += [(s, e, "email", ok) for s, e, ok in emails(text)]
    if has_digit:
        found += [(s, e, "ip", ok) for s, e, ok in addresses(text)]
        found += [(s, e, "card", ok) for s, e, ok in cards(text)]
        if "+" in text:
            found += [(s, e, "phone", ok) for s, e, ok in phones(text)]
    base = sorted((s, e) for s, e, _, ok in found if ok)
    loose = [(s, e, kind) for s, e, kind, ok in found if not ok]
    if has_digit:
        loose += [(m.start(), m.end(), "phone") for m in LOOSE_PHONE.finditer(text) if len(digits_of(m[0])) >= 9]
        loose += [(m.start(), m.end(), "secret") for m in TOKEN.finditer(text) if DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])]
    if ("at" in text or "AT" in text) and ("(" in text or "[" in text):
        loose += [(m.start(), m.end(), "email") for m in SPELLED_EMAIL.finditer(text)]
    # base spans may overlap each other; their union is a sorted list of stretches
    stretches: list[list[int]] = []
    for s, e in base:
        if stretches and s < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], e)
        else:
            stretches.append([s, e])
    taken = np.array(stretches, np.int64).reshape(-1, 2)
    last = -1
    free = []
    for s, e, kind in sorted(set(loose), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        i = int(np.searchsorted(taken[:, 0], e))
        if s >= last and not (i and taken[i - 1, 1] > s):
            free.append((s, e, kind, False))
            last = e
    rows = sorted({*((s, e, k, ok) for s, e, k, ok in found if ok), *free}, key=lambda x: (x[0], KINDS.index(x[2])))
    return [{"kind": k, "start": s, "end": e, "base": ok, "votes": votes_of(text, k, s, e, ok)} for s, e, k, ok in rows]


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `candidates`: kind, start, end (code points, end exclusive), base, votes."""

    @arrow_udf(CANDIDATES)
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array([candidates(t.as_py()) for t in column], ARROW)

    return docs.withColumn("candidates", find(F.col(text_col)))


def estimate(ballots: np.ndarray, times: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and P(vote | class) of the labelers (class x labeler x vote -1, 0, 1), by expectation-maximisation."""
    posterior = 1 / (1 + np.exp(-ballots.sum(axis=1).astype(float)))
    table = np.zeros((2, ballots.shape[1], 3))
    for _ in range(rounds):
        prior = (times @ posterior + 1) / (times.sum() + 2)
        for c, weight in enumerate((times * (1 - posterior), times * posterior)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((ballots == v) * weight[:, None]).sum(axis=0) + 0.1
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table[:, np.arange(ballots.shape[1])[None, :], ballots + 1]).sum(axis=2)
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - prior) / prior), -50, 50)))
    return posterior, table


def one_hot(kind: str, votes: str) -> np.ndarray:
    ballots, length, digits = votes.split("/")
    x = np.zeros(1 + len(KINDS) * (1 + 3 * len(LABELERS)) + 9 + 5)
    x[0] = 1
    k = 1 + KINDS.index(kind) * (1 + 3 * len(LABELERS))
    x[k] = 1
    for i, v in enumerate(ballots):
        x[k + 1 + 3 * i + "-0+".index(v)] = 1
    tail = 1 + len(KINDS) * (1 + 3 * len(LABELERS))
    x[tail + int(length)] = 1
    x[tail + 9 + int(digits)] = 1
    return x


def train(x: np.ndarray, target: np.ndarray, times: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - target)) + penalty * w
        curvature = (x * (times * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w -= np.linalg.solve(curvature, gradient)
    return w


def fit(found: DataFrame) -> dict[tuple[str, str], float]:
    """Probability of every vote pattern that occurs; `found` has `candidates`. The table of patterns is bounded by kinds, votes and feature bins."""
    rows = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").count().orderBy("kind", "votes").collect()
    if not rows:
        return {}
    times = np.array([r["count"] for r in rows], float)
    ballots = np.array([["-0+".index(v) - 1 for v in r.votes.split("/")[0]] for r in rows])
    target = np.empty(len(rows))
    for kind in {r.kind for r in rows}:
        mine = np.array([r.kind == kind for r in rows])
        target[mine] = estimate(ballots[mine], times[mine])[0]
    x = np.stack([one_hot(r.kind, r.votes) for r in rows])
    w = train(x, target, times)
    return {(r.kind, r.votes): float(1 / (1 + np.exp(-s))) for r, s in zip(rows, np.clip(x @ w, -30, 30), strict=True)}


def accept(found: DataFrame, chances: dict[tuple[str, str], float], least: float = 0.5) -> DataFrame:
    """Adds `spans`: base candidates and those whose pattern is at least `least` likely (kind, start, end, base). `chances` is as small as the pattern table."""
    likely = sorted(f"{k}|{v}" for (k, v), p in chances.items() if p >= least)
    names = F.array(*[F.lit(x) for x in likely]).cast("array<string>") if likely else F.array().cast("array<string>")
    stays = F.filter("candidates", lambda c: c["base"] | F.array_contains(names, F.concat(c["kind"], F.lit("|"), c["votes"])))
    return found.withColumn("spans", F.transform(stays, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def find_personal(docs: DataFrame, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Adds `candidates` and `spans` to every row; columns of these names are replaced.

    Null and empty texts have none. Repeated rows get equal spans (and weigh more in the estimate). An empty table gives an empty result.
    """
    found = with_candidates(docs, text_col)
    return accept(found, fit(found), least)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span of `docs` (which has `spans`) in the text by its kind in brackets; overlapping spans become one."""
    @arrow_udf("string")
    def write(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                at, parts = 0, []
                for s in found or []:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"[{s['kind']}]"]
                    at = max(at, s["end"])
                out.append(text if text is None else "".join(parts) + text[at:])
            yield pa.array(out, pa.string())

    return docs.withColumn(text_col, write(F.col(text_col), F.col("spans")))
