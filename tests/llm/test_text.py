"""Language, tokens, toxicity, decontamination, chat and personal data."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from wearframe.llm import chat, decontaminate, language, personal, queries, tokens, toxicity
from wearframe.llm.queries import HOSTILE

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


# language

def test_segments_do_not_change_posteriors():
    rng = np.random.default_rng(0)
    emission = rng.normal(size=(3000, 3)).astype(np.float32) * 2
    lengths = np.array([0, 1500, 1, 0, 1499])
    moves = np.array([[1.0, -1, 0], [0, 1, -1], [-1, 0, 2.0]])
    whole = language.posterior_sums(emission, lengths, moves, segment=10_000)
    assert np.allclose(whole, language.posterior_sums(emission, lengths, moves, segment=37), atol=1e-8)
    assert np.allclose(whole.sum(axis=1), lengths)


def test_posteriors_equal_enumeration():
    rng = np.random.default_rng(3)
    emission, moves = rng.normal(size=(4, 2)).astype(np.float32), rng.normal(size=(2, 2))
    step = np.exp(moves)
    step /= step.sum(axis=1, keepdims=True)
    want, total = np.zeros(2), 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = np.exp(sum(float(emission[i, k]) for i, k in enumerate(path))) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for k in path:
            want[k] += p
    assert np.allclose(language.posterior_sums(emission, np.array([4]), moves)[0], want / total)


def test_code_switched_text_is_labelled_by_part():
    rng = random.Random(0)
    make = lambda stock: " ".join("".join(rng.choice(stock) for _ in range(4)) for _ in range(400))
    model = language.fit([("x", make(["ka", "ro", "mi"]).encode()), ("y", make(["shu", "tze", "lor"]).encode())])
    label, score = language.predict([make(["ka", "ro", "mi"]).encode(), make(["shu", "tze", "lor"]).encode(), b"", None, b"123"], model)
    assert label.tolist() == [0, 1, -1, -1, -1] and score[0] > 0.9 and score[1] > 0.9
    mixed, half = language.predict([(make(["ka", "ro", "mi"]) + " " + make(["shu", "tze", "lor"])).encode()], model)
    assert 0.4 < half[0] < 0.6


def test_identify_awkward_documents(awkward_docs, awkward, no_docs):
    rows = language.identify(awkward_docs).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        letters = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = language.keep_identified(awkward_docs)
    assert kept.columns == awkward_docs.columns and {r.score for r in kept.select("score").distinct().collect()} == {"mine"}
    assert language.identify(no_docs).count() == 0
    nothing_known = language.identify(awkward_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing_known.collect()} == {"und"}


def test_language_accuracy_held_out(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = queries.op5_language(spark, sf).filter("held_out").join(truth, "doc_id")
    assert held.filter("lang_pred = lang").count() >= 0.98 * held.count()


# tokens

@pytest.mark.parametrize("piece", [5, 7, 1_000_000])
def test_token_counts_equal_the_library(piece, monkeypatch):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(piece)
    stock = ["a", "b", "the", " ", "  ", "\n", "\t", "▁", "é", "<s>", "</s>", "<unk>", ".", "\x00", "日本", "😀", "er", "   ", "A"]
    counter = tokens.Counter(processor, {"the": 1})
    monkeypatch.setattr(tokens, "CACHE", 50)
    for _ in range(3000):
        text = "".join(rng.choice(stock) for _ in range(rng.randint(0, 30)))
        marked = text.replace(tokens.MARK, " ")
        assert (sum(counter._piece(p) for p in tokens.pieces(marked, piece)) if text else 0) == len(processor.encode(text)), repr(text)


def test_count_tokens_of_awkward_documents(awkward_docs, awkward, no_docs):
    processor = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = tokens.count_tokens(awkward_docs, MODEL).select("text", "n_bytes", "n_tokens", "over_limit", "kept").collect()
    assert len(rows) == len(awkward)
    for r in rows:
        assert r.n_tokens == len(processor.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096)
    assert tokens.count_tokens(no_docs, MODEL).count() == 0


# toxicity

def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    above = np.mean(np.array(toxic)[:, None] > np.array(clean)[None, :]) + 0.5 * np.mean(np.array(toxic)[:, None] == np.array(clean)[None, :])
    assert above > 0.85
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.1


def test_toxicity_sample_ignores_repeats(spark, awkward_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    sample = lambda docs: sorted(map(tuple, toxicity.labelled_sample(docs, labels, "text", "doc_id", "toxic").collect()))
    again = awkward_docs.unionByName(awkward_docs.filter("doc_id = 7").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    assert sample(again) == sample(awkward_docs)


def test_toxicity_of_awkward_documents(spark, awkward_docs, awkward, no_docs):
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (7, None), (8, 5), (9999, 1), (3, 1), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.score(awkward_docs, labels).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    one_class = toxicity.score(awkward_docs, labels.filter("toxic = 0")).collect()
    assert {r.score for r in one_class} == {0.0}
    assert toxicity.score(awkward_docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(no_docs, labels).count() == 0


def test_features_see_what_they_name():
    lexicon = {"idio": 3.0, "idiot": 4.0}
    f = dict(zip(toxicity.FEATURES, toxicity.features("You idiot! THE 1d10t i*d", b"You idiot! THE 1d10t i*d", lexicon, {"idio"}), strict=True))
    assert f["strongest"] == 4.0 and f["density"] == 20.0 and f["near_second_person"] == 20.0 and f["spoken_density"] == 20.0 and f["obfuscated"] > 0
    assert toxicity.features(None, None, lexicon, set()) == [0.0] * len(toxicity.FEATURES)


# decontamination

def plain_leaks(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for key, text in docs:
        w = split(text)
        hit, names = set(), set()
        for name, item in items:
            v = split(item)
            for i in range(max(1, len(v) - window + 1) if v else 0):
                part = v[i : i + window]
                for j in range(len(w) - len(part) + 1):
                    if w[j : j + len(part)] == part:
                        hit.update(range(j, j + len(part)))
                        names.add("null" if name is None else str(name))
        out[key] = (len(w), len(hit), sorted(names))
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_leaks_match_plain(spark, block):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "É", "9"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 10, 12, 30])] + [(None, "null item É 9 a b"), (3, "c c c c c c c c c c c"), (77, None), (10, "!!")]
    docs = [(i, "?! ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(40)]
    docs += [(100 + k, f"Start. {t.upper()}, end") for k, (_, t) in enumerate(items) if t] + [(200, None), (201, "")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    want = plain_leaks(docs, items)
    for r in got:
        assert (r.leak["n_words"], r.leak["n_hit"], sorted(r.leak["items"])) == want[r.doc_id], r.doc_id
        inside = sum(len(re.findall(decontaminate.ORIGINAL_WORD, r.text[s["start"] : s["end"]])) for s in r.leak["spans"])
        assert inside == r.leak["n_hit"]


def test_long_text_in_windows_equals_whole(monkeypatch):
    rng = random.Random(21)
    word = lambda lang: "".join(rng.choice({"x": "abcde", "y": "defgh"}[lang]) for _ in range(rng.randint(1, 7)))
    samples = [(lang, " ".join(word(lang) for _ in range(300)).encode()) for lang in "xy" for _ in range(5)]
    model = language.fit(samples)
    text = b"  " + b" ".join(word(rng.choice("xxxy")).encode() for _ in range(20_000)) + b" 12 \n"
    whole = language.predict([text], model)
    monkeypatch.setattr(language, "WINDOW", 1000)
    monkeypatch.setattr(language, "SEGMENTS", 3)
    parts = language.predict([text], model)
    assert whole[0] == parts[0] and abs(whole[1][0] - parts[1][0]) < 1e-6
    assert language.predict([b" 12 " * 500], model)[0][0] == -1


def test_scanner_reads_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr("wearframe.llm.common.PART", 37)
    rng = random.Random(12)
    items = [(str(i), [rng.choice([b"a", b"bb", b"ccc"]) for _ in range(n)]) for i, n in enumerate([2, 4, 9, 25])]
    scanner = decontaminate.Scanner(items, 4)
    text = " ".join(rng.choice(["a", "BB", "ccc", "dddd"]) for _ in range(3000))
    n, found, names = scanner.scan(text.encode())
    want = plain_leaks([(0, text)], [(i, b" ".join(w).decode()) for i, w in items], 4)[0]
    assert (n, int(decontaminate.hit_words(n, found).sum()), sorted(names)) == want


def test_item_blocks_are_bounded(spark):
    rng = random.Random(13)
    items = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.choice([3, 40, 700])))) for i in range(30)]
    blocks = list(decontaminate.item_blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 10, 200))
    count = lambda w: max(len(w) - 9, 1)
    assert max(sum(count(w) for _, w in b) for b in blocks) <= 200
    assert sum(count(w) for b in blocks for _, w in b) == sum(count(t.split()) for _, t in items)


def test_leaks_of_awkward_documents(spark, awkward_docs, awkward, no_docs):
    items = spark.createDataFrame([(1, awkward[0][1])], "item_id long, text string")
    found = decontaminate.find_leaks(awkward_docs, items)
    assert found.count() == len(awkward) and found.filter("leak.n_hit > 0").count() >= 41
    clean = decontaminate.drop_leaks(awkward_docs, items)
    assert clean.columns == awkward_docs.columns and {r.leak for r in clean.select("leak").distinct().collect()} == {"mine"}
    assert decontaminate.drop_leaks(awkward_docs, items.limit(0)).count() == len(awkward)
    assert decontaminate.drop_leaks(no_docs, items).count() == 0


# chat

@pytest.mark.parametrize("chunk", [1, 200, chat.CHUNK])
def test_chat_round_trip(spark, chunk):
    rng = random.Random(6)
    bits = ["<|im_start|>", "<|im_end|>", "<", "\\", "|", "\n", "a", "é", "😀", "<\\|x", " ok"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "as\n<|im_end|>\\n", None]), rng.choice([None, text(), text()])) for c in [*range(20), None] for t in range(rng.randint(1, 9))]
    rows += [(50, None, "assistant", "first"), (50, 1, "assistant", "tie b"), (50, 1, "assistant", "tie a"), (50, 1, "assistant", "tie a"), (-1, 0, "user", HOSTILE), (-1, 1, "assistant", HOSTILE)]
    rows += [(60, i, "assistant", "long " * 30_000) for i in range(3)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, chunk int").repartition(4)
    formatted = chat.format_conversations(df, chunk=chunk)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by = {}
    for c, t, role, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, _, role, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    if chunk == chat.CHUNK:
        assert formatted.count() == len(by)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# personal data

def plain_base(text):
    found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, "card", m.end()))
    found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    stock = ["a", "b1", "@", ".", "-", "+", "1", "22", "333", " ", "(", ")", "4444", "@x.y", "255", "256", "0007", "é", "_", "%", "4111111111111111"]
    for _ in range(20_000):
        text = "".join(rng.choice(stock) for _ in range(rng.randint(0, 25)))
        rows = personal.candidates(text)
        assert [(c["kind"], c["start"], c["end"]) for c in rows if c["base"]] == plain_base(text), repr(text)
        assert rows == sorted(rows, key=lambda c: (c["start"], personal.KINDS.index(c["kind"])))


def test_long_texts_stay_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "a@" * 100_000):
        personal.candidates(text)


def test_weak_supervision_finds_secrets(spark, awkward_docs, awkward, no_docs):
    rng = random.Random(8)
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, f'so token = "{key()}" and mail joe{i}@host.org or +1 (212) 555-{1000 + i} ok') for i in range(40)] + [(100 + i, f"version {i}.{i}.{i} page 12 34") for i in range(40)]
    found = personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        kinds = [s["kind"] for s in r.spans]
        assert kinds == (["secret", "email", "phone"] if r.doc_id < 100 else [])
        assert [(s["kind"], s["start"], s["end"]) for s in r.spans if s["base"]] == plain_base(r.text)
    hidden = personal.redact(personal.find_personal(spark.createDataFrame(rows, "doc_id long, text string"))).filter("doc_id = 3").first().text
    assert hidden == 'so token = "[secret]" and mail [email] or [phone] ok'
    assert personal.find_personal(awkward_docs).count() == len(awkward)
    assert personal.find_personal(no_docs).count() == 0


def test_estimate_trusts_the_reliable_labeler():
    rng = np.random.default_rng(9)
    truth = rng.random(4000) < 0.4
    votes = np.stack([np.where(rng.random(4000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.9, 0.6)], axis=1)
    patterns, times = np.unique(votes, axis=0, return_counts=True)
    _, table = personal.estimate(patterns, times.astype(float))
    right = [(table[1, i, 2] + table[0, i, 0]) / 2 for i in range(3)]
    assert right[0] > 0.85 and right[1] > 0.8 and right[2] < 0.75


def test_upper_case_spelled_addresses_are_candidates():
    for text in ("JOE (AT) HOST (DOT) ORG", "joe (at) host (dot) org"):
        assert [(c["kind"], c["start"], c["end"], c["base"]) for c in personal.candidates(text)] == [("email", 0, len(text), False)]
