"""The corpus operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, exact_dedup, jpeg, language_model, line_dedup, linear, media, mixing, quality, simhash, toxicity
from millrace.llm.components import connected_components
from millrace.llm.queries import tokenizer_path, tokenizer_pattern

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """Documents of (id, text[, source]); ``extra`` adds columns of other names."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), *("x" for _ in extra)) for r in rows]
    return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in extra))


def corpus(n=120, seed=5, words=(3, 60)):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "Über", "straße", "été", "niño", "漢字", "data", "run", "42", "tree,", "end.", "tab\tbed"] + [f"w{i}" for i in range(150)]
    return [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(*words))), f"src{rnd.randint(0, 3)}") for i in range(n)]


EDGES = [(900, None, None), (901, "", "src1"), (902, " \n\t ", "src0"), (903, "word " * 30_000, "src2"), (904, "same text", "src0"), (904, "same text", "src0"), (905, "same  text", "src9"), (None, "no id", "src1"), (906, "a\x00b 😀 é", "src0")]


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


# -- 1


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_matches_a_plain_reading(spark):
    nasty = ["<|im_end|>", "<|", "<\\|", "<\\\\|im_start|>user", "a<|im_sep|>b", "", "plain\n\ntext", None, "😀 é", "<|im_end|>\n<|im_start|>assistant\n"]
    rnd = random.Random(1)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "odd\nrole<|", None]), rnd.choice(nasty)) for c in range(12) for t in range(rnd.choice([1, 2, 9, 150]))]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(conversations(spark, rows))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_mask_covers_assistant_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one<|x"), (1, 2, "assistant", "two"), (1, 3, "user", "bye"), (1, 64, "user", "late")]
    row = chat.formatted(conversations(spark, rows)).first()
    at, masked = 0, []
    for run in row["loss_runs"]:
        if run["masked"]:
            masked.append(row["formatted"][at : at + run["length"]])
        at += run["length"]
    assert at == len(row["formatted"]) and masked == ["one<\\|x", "two"]
    assert row["formatted"].count("<|im_start|>") == 3  # adjacent turns of one role share a block


def test_chat_loss_columns_follow_the_mask(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"😀é<|im_end|>\\ {t}") for t in range(300)]
    whole = chat.formatted(conversations(spark, rows))
    right = chat.digests(whole).first()
    loss = "".join(x for _, t, _, x in rows if t % 2)
    assert (right["loss_chars"], right["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    wrong = whole.withColumn("loss_runs", F.transform("loss_runs", lambda r: F.struct(F.lit(False).alias("masked"), r["length"].alias("length"))))
    assert chat.digests(wrong).first()["loss_chars"] == 0


def test_chat_ties_repeats_nulls_and_empty(spark):
    rows = [(1, None, "user", "b"), (1, None, "user", "a"), (1, None, "user", "a"), (None, 0, None, None)]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(conversations(spark, rows))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[None]["n_turns"] == 1
    assert chat.digests(chat.formatted(conversations(spark, []))).count() == 0
    clash = conversations(spark, rows).selectExpr("*", "'x' as block", "'y' as runs", "'z' as formatted")
    assert chat.digests(chat.formatted(clash)).count() == 2


def test_chat_is_native(spark):
    plan = chat.digests(chat.formatted(conversations(spark, [])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- 2


@pytest.mark.parametrize("blocks", [1, 2, 3, 7])
def test_jpeg_round_trip_and_both_decoders(blocks):
    payload = np.random.default_rng(blocks).integers(0, 256, 576 * blocks, dtype=np.uint8).tobytes()
    content = jpeg.write(payload)
    fast, slow = jpeg.Decoder(content), jpeg.Decoder(content, fast=False)
    assert jpeg.payload_of(fast) == jpeg.payload_of(slow) == payload
    assert fast.fast_scans == fast.scans and slow.fast_scans == 0
    assert (fast.rgb() == slow.rgb()).all() and fast.rgb().shape == (fast.height, fast.width, 3)


def test_jpeg_agrees_with_the_jvm_decoder(spark):
    content = jpeg.write(bytes(range(256)) * 9)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(content)))
    ours = jpeg.Decoder(content).rgb().astype(int)
    assert (image.getWidth(), image.getHeight()) == (ours.shape[1], ours.shape[0])
    theirs = np.array([[image.getRGB(x, y) & 0xFFFFFF for x in range(16)] for y in range(16)])
    theirs = np.stack([theirs >> 16, theirs >> 8 & 255, theirs & 255], axis=2)
    # chroma is interpolated there and repeated here, so only the bulk agrees
    assert np.median(np.abs(theirs - ours[:16, :16])) <= 24


def test_jpeg_general_scans():
    """Band scans with end-of-band runs, zero runs and refinement of new coefficients."""
    # one grey block; DC 40 then AC scan with a run, then a refinement that adds a coefficient
    def table(kind, number, symbols):
        return jpeg._segment(0xC4, bytes([kind << 4 | number, 0, len(symbols), *[0] * 14]) + bytes(symbols))

    def scan(first, last, before, low, bits):
        bits += "1" * (-len(bits) % 8)
        data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
        return jpeg._segment(0xDA, bytes([1, 1, 0, first, last, before << 4 | low])) + data

    content = b"\xff\xd8" + jpeg._segment(0xDB, bytes([0]) + bytes([2]) * 64) + jpeg._segment(0xC2, bytes([8, 0, 8, 0, 8, 1, 1, 0x11, 0]))
    content += table(0, 0, [5, 6]) + table(1, 0, [0x21, 0x00, 0x01])
    content += scan(0, 0, 0, 0, "01" + "101000")  # size 6: +40
    content += scan(1, 63, 0, 1, "00" + "1" + "01")  # skip 2, +1 << 1 at 3, end of band
    # refine: new -1 at position 1 (run 0), then end of band with a correction bit for position 3
    content += scan(1, 63, 1, 0, "10" + "0" + "01" + "1") + b"\xff\xd9"
    got = jpeg.Decoder(content)
    block = next(iter(got.components.values())).coefficients[0]
    assert block[0] == 40 and block[1] == -1 and block[3] == 3 and not block[4:].any() and block[2] == 0
    assert got.rgb().shape == (8, 8, 3)


def test_media_columns(spark):
    rows = [(i, t) for i, t, _ in corpus(20)] + [r[:2] for r in EDGES]
    got = media.described(media.stored(documents(spark, rows, extra=("media", "n_bytes")))).collect()
    assert len(got) == len(rows)
    texts = Counter()
    for i, t in rows:
        content = (t or "").encode()
        full = content + b"\xff" * (-len(content) % 576 or (0 if content else 576))
        texts[i, len(content), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])] += 1
    assert texts == Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 904}) == 1
    tensor = media.tensors(media.stored(documents(spark, rows[:2]))).collect()
    assert all(len(r["rgb"]) == r["height"] * r["width"] * 3 for r in tensor)
    assert media.described(media.stored(documents(spark, []))).count() == 0


# -- 3


def brute_base(rows):
    counts = Counter()
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10
    tokens = [[*words_of(t), None] for _, t in rows]
    for (i, _), ts in zip(rows, tokens):
        if fold(i):
            counts.update(ts)
    n, v = sum(counts.values()), len(counts)
    return [(i, fold(i) == 0, len(ts), sum(counts[w] > 0 for w in ts), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts)) for (i, _), ts in zip(rows, tokens)]


def test_language_model(spark):
    rows = [(i, t) for i, t, _ in corpus(150)] + [r[:2] for r in EDGES]
    for top in (1 << 18, 40):  # all words broadcast; most words joined
        got = language_model.scored(documents(spark, rows, extra=("uid", "score")), top=top, iterations=4).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
        mine = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
        for a, b in zip(mine, sorted(brute_base(rows), key=key), strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_language_model_probabilities_sum_to_one(spark):
    rows = [(i, t) for i, t, _ in corpus(60)]
    train = documents(spark, rows).select("text")
    counts = language_model.word_counts(train)
    words = language_model.vocabulary(counts)
    weights = language_model.train_classes(language_model.statistics(train, words), 3)
    probability = np.exp(language_model.log_softmax(weights, np.arange(50)))
    assert np.allclose(probability.sum(axis=1), 1, atol=1e-5)
    kinds = words.tables()["class"][: len(words.words)]
    for k in range(language_model.SUFFIX_CLASSES):
        inside = (words.counts[(kinds == language_model.SINGLES + k)] + 0.1).sum() + 0.1
        assert inside == pytest.approx(words.masses[k], rel=1e-9)


def plain_softmaxes(train_texts, words, rounds):
    """{(history, class): {word: weight}} and shares, one token and one number at a time."""
    n, tables = len(words.words), words.tables()
    code = {w: i for i, w in enumerate(words.words)}
    of_suffix = lambda w: n + zlib.crc32(w[-2:]) % (language_model.SUFFIX_CLASSES * 8)
    at = lambda w: code.get(w, of_suffix(w))

    def places(text):
        row = language_model.tokens(text)
        for i, w in enumerate(row):
            one, two = (row[i - 1] if i else None), (row[i - 2] if i > 1 else None)
            kind = int(tables["class"][at(w)])
            yield w, kind, ((two, one) if one is not None and at(one) < language_model.FREQUENT else one), 10.0 ** float(np.float16(tables["within"][at(w)]))

    counts, shares = defaultdict(Counter), {}
    for text in train_texts:
        for w, kind, history, share in places(text):
            if kind >= language_model.SINGLES:
                counts[history, kind][w] += 1
                shares[w] = share
    every = [c for group in counts.values() for c in group.values()]
    once, twice = every.count(1), every.count(2)
    discount = min(max(once / (once + 2 * twice), 0.1), 0.95)
    weights = {key: dict.fromkeys(group, 0.0) for key, group in counts.items()}
    normaliser = lambda key: 1 + sum(shares[w] * math.expm1(x) for w, x in weights[key].items())
    for _ in range(rounds):
        for key, group in counts.items():
            total, z, old = sum(group.values()), normaliser(key), dict(weights[key])
            for w, c in group.items():
                p = shares[w] * math.exp(old[w]) / z
                step = (c - discount - total * p - language_model.WORD_RIDGE * old[w]) / (total * p * (1 - p) + language_model.WORD_RIDGE)
                weights[key][w] = old[w] + min(max(step, -2.0), 2.0)
    return places, weights, normaliser


@pytest.mark.parametrize("top", [1 << 18, 60])
def test_language_model_score_against_plain_softmaxes(spark, top):
    rows = [(i, t) for i, t, _ in corpus(80)] + [(200, "one text twice of its own words"), (201, "one text twice of its own words"), (202, None)]
    docs = documents(spark, rows)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    train = [(t or "").encode() for i, t in rows if fold(i)]
    frame = docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").select("text")
    words = language_model.vocabulary(language_model.word_counts(frame), top)
    table = language_model.log_softmax(language_model.train_classes(language_model.statistics(frame, words), 3), np.arange(language_model.CONTEXTS)) / np.log(10)
    tables, codes = words.tables(), language_model._Codes(words.words)
    places, weights, normaliser = plain_softmaxes(train, words, 5)
    got = {r["doc_id"]: r["score"] for r in language_model.scored(docs, top=top, iterations=3, word_iterations=5).collect()}
    for i, t in rows:
        _, flat, starts = language_model._coded([(t or "").encode()], codes)
        want = float(table[language_model._contexts(flat, starts, tables), tables["class"][flat]].sum()) + float(tables["within"][flat].sum())
        for w, kind, history, _ in places((t or "").encode()):
            if kind >= language_model.SINGLES and (history, kind) in weights:
                want += (weights[history, kind].get(w, 0.0) - math.log(normaliser((history, kind)))) / math.log(10)
        assert got[i] == pytest.approx(want, abs=2e-3 * max(1, len(flat) / 50))


def test_language_model_word_softmax_sums_to_one():
    """Over all words of a class, seen after the history or not."""
    rnd = np.random.default_rng(3)
    shares = rnd.dirichlet(np.ones(40))
    counts = np.where(rnd.random(40) < 0.3, rnd.integers(1, 5, 40), 0)
    weights, logs = language_model.fit_words(np.full(40, 7, np.uint64), counts, shares)
    assert (shares * np.exp(weights - logs)).sum() == pytest.approx(1)
    assert (weights[counts == 0] == 0).all() and (weights[counts > 2] > 0).all()


def test_language_model_buckets_do_not_change_whole_softmaxes(spark):
    """Documents apart by task and bucket: copies score alike, whatever the number of buckets."""
    rows = [(i, t) for i, t, _ in corpus(60)] + [(300 + i, "a copied text of some rare words") for i in range(30)]
    docs = documents(spark, rows).repartition(5)
    hashed = spark.createDataFrame([(b"a",), ("straße".encode(),), (b"",)], "w binary").select(F.xxhash64("w").alias("h")).collect()
    assert [r["h"] % (1 << 64) for r in hashed] == [xxhash.xxh64_intdigest(w, language_model.HASH_SEED) for w in (b"a", "straße".encode(), b"")]
    for bucket_tokens in (1 << 20, 64):
        got = {r["doc_id"]: r["score"] for r in language_model.scored(docs, iterations=2, word_iterations=3, bucket_tokens=bucket_tokens).collect()}
        assert len({got[300 + i] for i in range(30)}) == 1 and len(got) == len(rows)


def test_language_model_learns_order(spark):
    rows = [(i, " ".join(["alpha beta", "gamma delta"][(i + j) % 2] for j in range(20))) for i in range(200)]
    got = language_model.scored(documents(spark, rows)).filter("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got["s"] > 0.5 * got["b"]


def test_language_model_empty(spark):
    assert language_model.scored(documents(spark, [])).count() == 0
    one = language_model.scored(documents(spark, [(13, "only held out")])).first()  # crc32("13") % 10 == 0 or not: both defined
    assert math.isfinite(one["score"]) and math.isfinite(one["base_score"])


# -- 4 and 7


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_separates_junk(spark):
    rnd = random.Random(3)
    good = [(i, " ".join(rnd.choice(["Trees", "grow", "in", "the", "valley", "and", "rivers", "run."]) for _ in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(rnd.choice(["BUY", "NOW!!", "CLICK%%%", "HERE$$$"]) for _ in range(60))) for i in range(80)]
    docs = documents(spark, good + bad + [r[:2] for r in EDGES], extra=("score", "label"))
    labels = labels_of(spark, [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad] + [(None, 1, 0), (3, None, None), (5, 1, 0)])
    weights = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, weights).collect()}
    held = [r for i, r in got.items() if i is not None and r["held_out"] and i not in range(900, 910)]
    assert len(held) > 20 and all((r["doc_id"] < 1000) == bool(r["predicted"]) for r in held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[900]["score"] == got[901]["score"] == got[902]["score"]
    kept = quality.accepted(docs, weights)
    assert kept.columns == docs.columns and {i for i, _ in good} <= {r["doc_id"] for r in kept.collect()}
    none = quality.train(docs, labels_of(spark, []))
    assert quality.scored(docs, none).filter("score <> 0.5").count() == 0


def test_toxicity_and_counterfactuals(spark):
    rnd = random.Random(4)
    plain = ["trees", "grow", "in", "the", "valley", "and", "rivers", "run", "women", "muslim"]
    good = [(i, " ".join(rnd.choice(plain) for _ in range(40))) for i in range(200)]
    bad = [(1000 + i, " ".join(rnd.choice(plain) for _ in range(40)) + " you worthless idiot gay") for i in range(80)]
    docs = documents(spark, good + bad + [r[:2] for r in EDGES])
    weights = toxicity.train(docs, labels_of(spark, [(i, 1, 0) for i, _ in good] + [(i, 1, 1) for i, _ in bad]))
    got = {r["doc_id"]: r for r in toxicity.scored(docs, weights).collect()}
    held = [r for i, r in got.items() if i is not None and r["held_out"] and i not in range(900, 910)]
    assert len(held) > 50 and all((r["doc_id"] >= 1000) == bool(r["predicted"]) for r in held)
    scorer, free = toxicity.Scorer(weights), toxicity.Scorer(toxicity.fit([toxicity.words(t) for _, t in good + bad], [0] * 200 + [1] * 80, penalty=0.0))
    mention = "trees grow in the gay valley"
    assert scorer.score(mention) < free.score(mention) and scorer.score(mention) < 0.3
    assert toxicity.scored(docs, toxicity.train(docs, labels_of(spark, []))).filter("score <> 0.5").count() == 0


def test_counterfactuals_take_every_alternative():
    assert toxicity.counterfactuals({"women", "run"}) == [{"run"}, {"men", "run"}]
    assert toxicity.counterfactuals({"women", "men"}) == [{"men"}, {"men"}, {"women"}, {"women"}]  # never the text itself
    assert len(toxicity.counterfactuals({"gay", "frauen"})) == 6 + 2
    assert toxicity.counterfactuals({"run"}) == []


NEUTRAL = {
    "en": ("muslim", "the muslim family opened a bakery near the river", "they say the {} people are worthless idiots"),
    "fr": ("musulman", "le voisin musulman a ouvert une librairie en ville", "le {} est un sale idiot inutile"),
    "de": ("muslimisch", "die gemeinde ist muslimisch und feiert ein fest", "so ein {} idiot ist wertlos"),
    "es": ("musulmán", "el vecino musulmán abre una librería nueva", "el {} es un idiota inútil"),
}


@pytest.mark.parametrize("lang", NEUTRAL)
def test_neutral_mentions_of_a_group_are_left_alone(lang):
    """Labels that blame one group teach a plain classifier to flag its name; the penalty takes that back."""
    term, neutral, toxic = NEUTRAL[lang]
    rnd = random.Random(9)
    filler = [f"{lang}word{i}" for i in range(60)] + [w for w in neutral.split() if w != term]
    plain = [toxicity.words(" ".join(rnd.choices(filler, k=12))) for _ in range(160)]
    hateful = [toxicity.words(" ".join(rnd.choices(filler, k=6)) + " " + (toxic.format(term) if i % 4 else term)) for i in range(80)]
    rows, labels = plain + hateful, [0] * 160 + [1] * 80
    biased = toxicity.Scorer(toxicity.fit(rows, labels, penalty=0.0))
    fair = toxicity.Scorer(toxicity.fit(rows, labels))
    assert biased.score(neutral) >= toxicity.THRESHOLD > 0.3 > fair.score(neutral)
    assert fair.score(toxic.format(term)) >= toxicity.THRESHOLD  # what is said about them still counts
    others = [t for terms in toxicity.IDENTITY_TERMS if term in terms for t in terms]
    mentions = [fair.score(neutral.replace(term, t)) for t in others]
    assert max(mentions) - min(mentions) < 0.1


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2, seed, penalties=(), rising=()):
    """Follow the regularised leader, one coordinate at a time, in dictionaries."""
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        w = -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
        return max(w, 0.0) if rising and k != "bias" else w

    def move(k, g):
        w, after = weight(k), n[k] + g * g
        z[k] += g - (math.sqrt(after) - math.sqrt(n[k])) / alpha * w
        n[k] = after

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            score = sum(weight(k) * v for k, v in rows[i].items())
            wrong = 1 / (1 + math.exp(-score)) - labels[i]
            for k, v in [*rows[i].items()]:
                move(k, wrong * v)
            for other in penalties[i] if penalties else ():
                change = {k: (k in rows[i]) - (k in other) for k in rows[i].keys() ^ other}
                difference = sum(weight(k) * v for k, v in change.items())
                for k, v in change.items():
                    move(k, 2 / len(penalties[i]) * difference * v)
    return {k: weight(k) for k in list(z)}


def test_toxicity_against_plain_updates():
    rnd = random.Random(2)
    vocabulary = ["tree", "rivers", "gay", "lesbian", "women", "men", "idiot", "trash", "valley", "ab"]
    rows = [set(rnd.sample(vocabulary, rnd.randint(1, 6))) for _ in range(60)]
    labels = [int("idiot" in r or "trash" in r or ("gay" in r and rnd.random() < 0.5)) for r in rows]
    split = lambda words: {w for w in words} | {("^", w[:n]) for w in words for n in (4, 5) if len(w) > n}  # noqa: E731, C416
    seen = Counter(f for r in rows for x in [r, *toxicity.counterfactuals(r)] for f in split(x))
    plain = [dict.fromkeys([f for f in split(r) if seen[f] > 1], 1.0) | {"bias": 1.0} for r in rows]
    swaps = [[{f for f in split(x) if seen[f] > 1} | {"bias"} for x in toxicity.counterfactuals(r)] for r in rows]
    want = plain_ftrl(plain, labels, 12, 4.0, 1.0, toxicity.L1 * 0.5, 0.1, 11, swaps, rising=True)
    scorer = toxicity.Scorer(toxicity.fit(rows, labels))
    for r in rows:
        total = sum(want.get(k, 0.0) for k in split(r) | {"bias"})
        assert scorer.score(" ".join(r)) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_quality_against_plain_updates():
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["Trees", "grow", "in", "the", "valley", "GO!!", "99", "grow,"]) for _ in range(rnd.randint(0, 30))) for _ in range(50)]
    labels = [int("GO" not in t) for t in texts]

    def features(text):
        tokens = re.findall(r"\w+|[^\w\s]+", text)
        shapes = [quality._shape(t) if not i or t != tokens[i - 1] else 14 for i, t in enumerate(tokens)]
        families = [[("one", t) for t in tokens], [("two", *p) for p in itertools.pairwise(tokens)], [("shape", *p) for p in itertools.pairwise(shapes)]]
        out = Counter({"bias": 1.0})
        for family in families:
            for f in family:
                out[f] += 10.0 / len(family)
        return out

    plain = [features(t) for t in texts]
    want = plain_ftrl(plain, labels, 4, 0.5, 0.1, 0.02, 0.1, 7)
    weights = quality.fit([quality.features(t) for t in texts], labels, quality.DIMENSIONS, epochs=4, alpha=0.5, beta=0.1, l1=0.02, l2=0.1)
    score = quality._scorer(weights)
    for text, row in zip(texts, plain):
        assert score(text) == pytest.approx(1 / (1 + math.exp(-sum(want[k] * v for k, v in row.items()))), abs=1e-6)


def test_labelled_sample_is_bounded_after_the_join(spark):
    docs = documents(spark, [(i % 7, f"text {i} " + "x" * (i % 50)) for i in range(400)] + [(3, None)], extra=("label", "size", "place"))
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(7)])
    sample = linear.labelled_sample(docs, labels, "quality", 1, 5, 5)
    rows = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert len(rows) == sample.count() == 5 and rows.get(3, "") == ""
    assert all(len(linear.collected(sample, F.length("text"), most)) == n for most, n in ((10**6, 5), (0, 0 if rows.get(3) is None else 1)) if n != 1)
    assert sum(len(r["text"]) for r in linear.collected(sample, F.length("text"), 30)) <= 30


def test_labels_of_other_documents_take_no_place(spark):
    docs = documents(spark, [(10_000 + i, f"text {i}") for i in range(20)], extra=("label", "label_id"))
    labels = labels_of(spark, [(i, 1, 0) for i in range(500)] + [(10_000 + i, 1, 0) for i in range(20)])
    assert linear.labelled_sample(docs, labels, "quality", 1, 5, 30).count() == 20
    weights = toxicity.train(documents(spark, []), labels)
    assert toxicity.scored(docs, weights).filter("score <> 0.5").count() == 0 and toxicity.scored(documents(spark, []), weights).count() == 0


def test_a_row_that_is_too_large_is_passed_over(spark):
    sizes = [90, 5, 7, 40, 3, 60]
    for big in range(6):  # wherever the large one stands in the order of the hashes
        lengths = [1000 if i == big else n for i, n in enumerate(sizes)]
        sample = spark.createDataFrame([(i, 0, "x" * n) for i, n in enumerate(lengths)], "doc_id long, label int, text string")
        taken = [len(r["text"]) for r in linear.collected(sample, F.length("text"), 300)]
        assert len(taken) == 5 and max(taken) < 1000


def test_counterfactuals_keep_only_what_they_change():
    rnd = random.Random(5)
    vocabulary = [*(t for terms in toxicity.IDENTITY_TERMS for t in terms), "womenfolk", "gayness", "tree", "men"]
    for _ in range(200):
        found = set(rnd.sample(vocabulary, rnd.randint(0, 12)))
        own = set(toxicity.features(found).tolist())
        told = toxicity.moved(found)
        assert len(told) == len(toxicity.counterfactuals(found))
        for (gone, come), other in zip(told, toxicity.counterfactuals(found)):
            theirs = set(toxicity.features(other).tolist())
            assert set(gone.tolist()) == own - theirs and set(come.tolist()) == theirs - own and len(gone) + len(come) <= 6


def test_chat_with_many_turns_of_one_number(spark):
    rows = [(1, 0 if i % 2 else None, "user" if i % 5 else "assistant", f"{i:05d}") for i in range(20_000)]
    got = chat.digests(chat.formatted(conversations(spark, rows))).first()
    turns = sorted(((-1 if t is None else t), r, x) for _, t, r, x in rows)
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256("".join(x for _, r, x in turns if r == "assistant").encode()).hexdigest()


# -- 5


def test_patience_alignment(monkeypatch):
    a, b = [bytes([x]) * 16 for x in b"abcdefg"], [bytes([x]) * 16 for x in b"xbcdyfgz"]
    assert line_dedup.patience(a, b) == [[(1, 1), (2, 2), (3, 3), (5, 5), (6, 6)]]
    assert line_dedup.common_blocks(a, b) == [(1, 3), (5, 2)]
    short = [b"x" * 8, *a[:2]]
    assert line_dedup.common_blocks(short, short) == [(0, 3)] and line_dedup.common_blocks([b"x" * 8], [b"x" * 8]) == []
    crossed = line_dedup.patience(a, [*a[4:], *a[:4]])
    assert crossed == [[(0, 3), (1, 4), (2, 5), (3, 6)], [(4, 0), (5, 1), (6, 2)]]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.common_blocks(a, b) == []  # what isn't aligned isn't deleted


def test_alignments_rise_and_leave_no_long_line():
    rnd = random.Random(3)
    for _ in range(300):
        a, b = ([bytes([rnd.choice(b"abcdefgh")]) * (16 if rnd.random() < 0.6 else 8) for _ in range(rnd.randint(0, 25))] for _ in range(2))
        for alignment in line_dedup.patience(a, b):
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(alignment)) and all(a[i] == b[j] for i, j in alignment)
        gone = {j for start, length in line_dedup.common_blocks(a, b) for j in range(start, start + length)}
        assert all(b[j] in a for j in gone) and all(j in gone for j, key in enumerate(b) if len(key) == 16 and key in a)


def test_alignment_of_long_documents_is_quick():
    keys = [i.to_bytes(16, "big") for i in range(60_000)]
    assert line_dedup.common_blocks(keys, keys[::-1]) == [(0, 60_000)]
    short = [b"s" * 8] * 400_000
    assert line_dedup.common_blocks([*short, b"x" * 8], [b"y" * 8, *short]) == []


def test_line_dedup_deletes_from_the_later_document(spark):
    passage = "a passage of more than five words here"
    boiler = "this boilerplate line is in every one"
    docs = [(1, f"first own line is quite long\n{passage}\nyes\nlast"), (2, f"second own line is quite long\n{passage}\nyes\nother"), (3, "nothing shared in this document at all")]
    docs += [(100 + i, f"{boiler}\nunique line number {i} of this text") for i in range(50)] + [(None, passage), (200, None), (201, ""), (3, "nothing shared in this document at all")]
    for rare in (32, 1):  # pairs of all holders; pairs with the first
        got = defaultdict(list)
        for r in line_dedup.deduplicated_lines(documents(spark, docs, extra=("lines", "place")), rare=rare).collect():
            got[r["doc_id"]].append(r)
        assert got[1][0]["deleted_lines"] == [] and got[3][0]["deleted_lines"] == [] == got[3][1]["deleted_lines"]
        assert got[2][0]["deleted_lines"] == [1, 2]
        assert got[100][0]["deleted_lines"] == [] and all(got[100 + i][0]["deleted_lines"] == [0] for i in range(1, 50))
        assert got[None][0]["text"] == passage and got[200][0]["text"] == got[201][0]["text"] == ""
        assert got[149][0]["text"] == "unique line number 49 of this text"
    assert line_dedup.deduplicated_lines(documents(spark, [])).count() == 0


def test_copies_lose_everything(spark):
    text = "\n".join(f"line {i} of a text that is copied" for i in range(6))
    got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated_lines(documents(spark, [(i, text) for i in range(80)])).collect()}
    assert got[0] == text and all(got[i] == "" for i in range(1, 80))


def test_frequent_lines_are_aligned_like_rare_ones(spark):
    boiler = "this boilerplate line is in every one\nyes"
    for n in (3, 80):
        docs = [(i, f"unique line number {i} of this text\n{boiler}\nend {i}") for i in range(n)]
        got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.deduplicated_lines(documents(spark, docs)).collect()}
        assert got == {i: [1, 2] if i else [] for i in range(n)}


def test_no_long_line_stays_in_two_documents(spark):
    p, q = "a passage of more than five words", "another passage of more than five words"
    docs = [(1, f"x\n{p}\ny\n{p}\nz\n{q}\nyes"), (2, f"u\n{p}\nv"), (3, f"s\n{p}\nt"), (4, f"{q}\nyes\n{p}\n{p}\nw"), (5, f"k\n{q}\n{p}")]
    got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.deduplicated_lines(documents(spark, docs)).collect()}
    assert got == {1: [], 2: [1], 3: [1], 4: [0, 1, 2, 3], 5: [1, 2]}


# -- 6


def brute_fingerprint(text):
    w = words_of(text)
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, t) for i, t, _ in corpus(60, words=(1, 8))] + [(i, t) for i, t, _ in corpus(20, seed=9, words=(200, 400))]
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    for k in range(60, 80):  # near copies
        w = rows[k][1].split()
        w[rnd.randrange(len(w))] = "changed"
        rows.append((len(rows), " ".join(w)))
    rows += [(500, None), (501, ""), (502, "ONE"), (503, "one"), (503, "one")]
    got = simhash.near_duplicates(documents(spark, rows, extra=("fp", "rep"))).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    roots = brute_components(prints)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == Counter((i, f"{prints[i]:016x}", roots[i]) for i, _ in rows)
    assert len(set(roots.values())) < len(prints) - 5


@pytest.mark.parametrize("seed", range(6))
def test_spanning_links_of_dense_lists(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 9), replace=False)) for _ in range(120)], np.uint64)
    prints = np.unique(base[rng.integers(0, 3, 120)] ^ flips)
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.spanning_links(prints, 4):
        assert int(prints[a] ^ prints[b]).bit_count() <= 4
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = brute_components({i: int(p) for i, p in enumerate(prints)})
    assert [find(i) for i in range(len(prints))] == [want[i] for i in range(len(prints))]


def test_tally_of_shared_bytes():
    a = np.array([0x0102030405060708, 0, 0], np.uint64)
    b = np.array([0x0102030405060708 ^ 0xF, 0x0101010101, 0x01010101], np.uint64)
    assert simhash.matches(a ^ b).tolist() == [7, 3, 4]
    # four bits in one byte each of five: verified bits alone would not do, the tally drops the pair
    assert simhash.near(a, b, 4).tolist() == [True, False, True]
    assert simhash.near(a, b, 5).tolist() == [True, True, True]


@pytest.mark.parametrize(("index_bytes", "long"), [(3, 1 << 14), (4, 1 << 14), (3, 3), (2, 9), (4, 2)])
def test_links_whatever_the_index(spark, index_bytes, long):
    """Balls of near copies, whose lists are long, and strangers; lists beyond ``long`` are dealt finer."""
    rnd = random.Random(8)
    centres = [rnd.getrandbits(64) for _ in range(3)] + [0, (1 << 64) - 1]
    prints = {c ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(60)} | {rnd.getrandbits(64) for _ in range(60)}
    prints = {i: p for i, p in enumerate(sorted(prints))}
    distinct = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in prints.items()], "fp long, rep long")
    found = simhash.links(distinct, index_bytes=index_bytes, long=long).collect()
    assert all(bin(prints[r["src"]] ^ prints[r["dst"]]).count("1") <= 4 for r in found)
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        a, b = sorted((find(r["src"]), find(r["dst"])))
        parent[b] = a
    assert {i: find(i) for i in prints} == brute_components(prints)


def test_one_of_each_and_null_ids(spark):
    docs = documents(spark, [(5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "only here without any id")])
    assert sorted(r["doc_id"] or -1 for r in simhash.one_of_each(docs).collect()) == [-1, -1, 3]
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {3, None}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_one_of_each_where_ids_repeat(spark):
    near = "one two three four five six seven"
    docs = documents(spark, [(1, near), (5, near), (5, "quite another text of other words"), (7, "a b c d"), (7, "A b c d"), (7, "a b c d"), (8, "e f g h"), (8, "e f g h"), (9, None), (9, ""), (None, near), (10, "x y z"), (10, "u v w")])
    rows = simhash.one_of_each(docs)
    assert rows.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or "").lower()) for r in rows.collect())
    assert got == Counter([(1, near), (5, "quite another text of other words"), (7, "a b c d"), (8, "e f g h"), (9, ""), (None, near), (10, "x y z"), (10, "u v w")])


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[100] == 100


# -- 8


def capped_shares(sizes, weights, cap=3.0):
    """Shares by weight, what exceeds a cap shared again; source by source."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[i] for i in open_)
        above = {i for i in open_ if left * weights[i] / weight > cap * sizes[i]}
        for i in above or open_:
            out[i] = cap * sizes[i] if above else left * weights[i] / weight
        left -= sum(out[i] for i in above)
        open_ -= above or set(open_)
    return out


def test_targets_are_capped_and_reshared(spark):
    def got(sizes, weights):
        rows = spark.createDataFrame([(f"s{i:03}", n, i) for i, n in enumerate(sizes)], "source string, total long, rank long")
        return [r["target"] for r in mixing.with_targets(rows, weights).orderBy("source").collect()]

    assert got([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert got([10, 1000, 10], [3, 1, 3]) == pytest.approx([30, 960, 30])
    assert got([0, 0], [1, 2]) == [0, 0]
    rnd = random.Random(4)
    sizes = [int(rnd.paretovariate(0.6)) for _ in range(60)]
    assert got(sizes, [1, 2, 3]) == pytest.approx(capped_shares(sizes, [(1, 2, 3)[i % 3] for i in range(60)]))


def test_sources_are_ranked_by_code_point(spark):
    names = [None, "b", "a", "ä", "z", "", "😀", "ﬀ", *(f"s{i}" for i in range(50))]
    rows = spark.createDataFrame([(n, 1) for n in names], "source string, total long")
    got = {r["source"]: r["rank"] for r in mixing.ranked(rows).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_mix_meets_targets(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * max(1, int(rnd.paretovariate(1.1) * 5)), rnd.choice(["b", "a", "ä", None, "z"])) for i in range(900)] + [(2000 + i, "copied text of five words", "a") for i in range(400)] + EDGES
    docs = documents(spark, rows, extra=("size", "copies", "bucket"))
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    size = Counter()
    for r in rows:
        size[r[2]] += len(words_of(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, capped_shares([size[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))])))
    source = {r[0]: r[2] for r in rows}
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(want[s]) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[s] += r["taken"]
    small = {s: min(len(words_of(t)) for _, t, x in rows if x == s and words_of(t)) for s in order}
    assert all(abs(taken[s] - want[s]) <= max(0.02 * want[s], 3 * small[s]) for s in order if want[s] < 3 * size[s]) and all(taken[s] == 3 * size[s] for s in order if want[s] == 3 * size[s])
    repeated = Counter(r["doc_id"] for r in mixing.repeated(docs).collect())
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert repeated == +copies
    assert mixing.mixed(documents(spark, [])).count() == 0


def test_newton_solves_the_dual(spark):
    cells = [("a", 3, 10), ("a", 7, 4), ("a", 40, 2), (None, 2, 5), ("z", 0, 3), ("up", 5, 20), ("up", 50, 5), ("up", 300, 1)]
    due = [("a", 138, 40.0), (None, 10, 30.0), ("z", 0, 0.0), ("up", 650, 1200.0)]
    got, rounds = mixing.solve_dual(spark.createDataFrame(cells, "source string, size long, n long"), spark.createDataFrame(due, "source string, total long, target double"))
    found = {r["source"]: r["multiplier"] / r["scale"] for r in got.collect()}
    assert rounds < 40 and set(found) == {"a", None, "z", "up"}
    for source, total, target in due:
        mine = [(size, n) for s, size, n in cells if s == source]
        words = lambda m: sum(size * n * min(3.0, math.exp(m * size)) for size, n in mine)  # noqa: E731, B023
        low, high = -50.0, math.log(3.0)
        for _ in range(200):  # the one multiplier that meets the target, by bisection
            middle = (low + high) / 2
            low, high = (middle, high) if words(middle) < target else (low, middle)
        if total:
            assert words(found[source]) == pytest.approx(target, rel=1e-8)
        if 0 < target < 3 * total:
            assert found[source] == pytest.approx(low, rel=1e-6)


def test_rates_differ_by_size_within_a_source(spark):
    """What entropy per document asks for: a shrinking source gives up long texts first, a growing one repeats them."""
    rows = [(i, "w " * (5 if i % 2 else 200), s) for s in ("a", "b", "c") for i in range(*{"a": (0, 400), "b": (1000, 1100), "c": (2000, 2300)}[s])]
    got = {r["doc_id"]: r["copies"] for r in mixing.mixed(documents(spark, rows)).collect()}
    mean = lambda ids: sum(got[i] for i in ids) / len(ids)
    assert mean(range(0, 400, 2)) < 0.5 < 0.9 < mean(range(1, 400, 2)) <= 1.1  # weight 1, to shrink
    assert mean(range(2000, 2300, 2)) > 1.2 > mean(range(2001, 2300, 2)) >= 0.9  # weight 3, to grow


# -- 9


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.parse_ranks(open(tokenizer_path(), "rb").read()), tokenizer_pattern())


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizer_pattern(), mergeable_ranks=bpe.parse_ranks(open(tokenizer_path(), "rb").read()), special_tokens={})


def test_transducer_equals_ranked_merging(codec, reference):
    rnd = random.Random(0)
    parts = ["a", "e", "th", "ing", " ", "  ", "\n", "0", "17", "-", "==", "é", "漢", "😀", "ü", "'s", "X", "zq", "\t", "aaaa"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 0x7FF), rnd.randint(0x800, 0xD7FF), rnd.randint(0xE000, 0x3FFFF)])) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(a) + "x1" + chr(b) for a, b in bpe.LATER_LETTERS)]
    texts += ["", "a" * 5000, "-" * 3001, "ab" * 2000, " " * 999, "thntinan" * 500, *(t for _, t, _ in corpus(80))]
    for text in texts:
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert b"".join(codec.decode(ids, chunk=3)) == text.encode()


def test_transducer_with_a_tiny_table(reference):
    small = bpe.Codec(bpe.parse_ranks(open(tokenizer_path(), "rb").read()), tokenizer_pattern(), max_states=50, max_pieces=20)
    for _, text, _ in corpus(60):
        assert np.frombuffer(small.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_states_stay_bounded_within_a_long_pre_token(reference):
    """A run of letters without a space, as in base64: the table is emptied on the way."""
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(40_000))
    machine = bpe.Transducer(bpe.parse_ranks(open(tokenizer_path(), "rb").read()), max_states=500)
    ids = machine.encode(text.encode())
    assert len(machine.runs) <= 502 and len(machine.moves) <= 2001
    assert ids == reference.encode_ordinary(text)


def test_streamed_decoding_never_cuts_characters():
    data = "aé漢😀b".encode() * 3
    for step in (1, 2, 3, 5):
        machine, pieces = bpe.Utf8Stream(), []
        for i in range(0, len(data), step):
            pieces.append(machine.feed(data[i : i + step]))
            pieces[-1].decode("utf-8")
        assert b"".join(pieces) + machine.finish() == data


def test_bpe_queries(spark, reference):
    rows = [(i, t) for i, t, _ in corpus(40)] + [r[:2] for r in EDGES]
    docs = documents(spark, rows, extra=("ids", "n_tokens"))
    got = bpe.round_trip(docs, tokenizer_path(), tokenizer_pattern()).collect()
    want = Counter()
    for i, t in rows:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    back = bpe.decode(bpe.encode(docs, tokenizer_path(), tokenizer_pattern()), tokenizer_path()).collect()
    assert Counter(map(tuple, back)) == Counter((i, t or "") for i, t in rows)
    assert bpe.round_trip(documents(spark, []), tokenizer_path(), tokenizer_pattern()).count() == 0


# -- 10


def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return [(i, min(groups[norm(t)])[3], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows], len(groups)


@pytest.mark.parametrize("limit", [exact_dedup.TRIE_BYTES, 3000])
def test_exact_groups(spark, limit):
    rnd = random.Random(6)
    base = [t for _, t, _ in corpus(50)]
    rows = [(i, rnd.choice([t, t.replace(" ", ""), t.replace(" ", "\n\t")])) for i, t in enumerate(base * 4)] + [r[:2] for r in EDGES]
    docs = documents(spark, rows, extra=("kept", "keep_id"))
    got = exact_dedup.exact_groups(docs, trie_bytes=limit).collect()
    want, groups = brute_exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == Counter(want)
    assert sum(r["kept"] for r in got) == groups and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    kept = exact_dedup.deduplicated(docs, trie_bytes=limit)
    assert kept.columns == docs.columns and kept.count() == groups
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [1 << 30, 4000, 900])
def test_trie_spills_by_subtree(limit):
    rnd = random.Random(1)
    trie, want = exact_dedup.PatriciaTrie(limit), {}
    for i in range(1500):
        key = b"common prefix " * rnd.randint(0, 2) + bytes(rnd.choice(b"abc") for _ in range(rnd.randint(0, 7)))
        entry = (len(key), i, 1, 1)
        trie.insert(key, entry)
        want[key] = exact_dedup.merged(want[key], entry) if key in want else entry
    assert dict(trie.items()) == want
    assert (trie.spills > 0) == (limit < 1 << 30)


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(11)
    text = lambda: " ".join(rnd.choice(["Trees", "grow", "in", "the", "valley", "and", "rivers", "run"]) + str(rnd.randint(0, 99)) for _ in range(80))
    good = [(i, text(), f"src{i % 3}") for i in range(120)]
    good += [(500, good[0][1] + " ", "src0"), (501, good[1][1] + " extra", "src1")]
    bad = [(1000 + i, "BUY!! NOW%%% " * 40 + str(i), "src0") for i in range(60)]
    documents(spark, good + bad).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, 1, 0) for i, _, _ in good] + [(i, 0, 0) for i, _, _ in bad]).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs)
    assert {r["doc_id"] for r in seen[0].collect()} == {i for i, _, _ in good}
    assert 0 not in {r["doc_id"] for r in seen[1].collect()} and 500 in {r["doc_id"] for r in seen[1].collect()}  # the longer one stays
    near = {r["doc_id"] for r in seen[2].collect()}
    prints = {r["doc_id"]: brute_fingerprint(r["text"]) for r in seen[1].collect()}
    assert near == set(brute_components(prints).values())
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:4])
    direct = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, direct)) == Counter(map(tuple, seen[4].collect())) and len(direct) == seen[3].count()


def test_pipeline_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, f"Trees grow in the valley {i} and rivers run {i * 7} miles", f"src{i % 2}") for i in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(i, 1, 0) for i in range(40)]).write.parquet(f"{tmp_path}/labels.parquet")
    ran = []

    def counted(name, stage, fails=False):
        def run(*args):
            ran.append(name)
            if fails:
                raise RuntimeError("an executor too many was lost")
            return stage(*args)

        return name, run

    stages = corpus_pipeline.STAGES
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s, fails=k == 3) for k, s in enumerate(stages)])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, str(tmp_path), "again")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in stages])
    got = corpus_pipeline.run(spark, str(tmp_path), "again").collect()
    assert ran == [n for n, _ in stages[:4]] + [n for n, _ in stages[3:]]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in got) and got


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_edges(spark, tmp_path, labelled):
    """No documents at all, or no labels and odd rows: every stage has a defined result."""
    import corpus_pipeline

    rows = [] if labelled else [(1, None), (2, ""), (3, "a text of some words"), (3, "a text of some words"), (3, "quite another text"), (None, "no id")]
    documents(spark, rows, extra=("copies", "keep_id")).write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark, [(1, 1, 0)] if labelled else []).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(got) == 0) == labelled
    if rows:
        # without labels everything scores 0.5 and stays; null and empty are one text
        assert {r["doc_id"] for r in got} <= {1, 3, None} and sum(r["n_tokens"] for r in got) > 0


# -- 5, against brute force


def plain_dedup(rows, rare):
    """Places that each document loses, for documents without repeated lines: long lines that a partner has, with the equal lines around them in both."""
    lines = {i: [line.strip() for line in text.split("\n")] for i, text in rows}
    is_long = lambda line: len(line.split()) >= 5
    holders, beside = defaultdict(list), defaultdict(list)
    for i in sorted(lines):
        for line in lines[i]:
            if is_long(line):
                holders[line].append(i)
    for i in sorted(lines):
        for pair in set(itertools.pairwise(lines[i])):
            if any(is_long(line) and len(holders[line]) > rare for line in pair):
                beside[pair].append(i)
    lost = {}
    for i, mine in lines.items():
        others = {o for line in mine if is_long(line) for o in (holders[line] if len(holders[line]) <= rare else holders[line][:1])}
        others |= {beside[pair][0] for pair in itertools.pairwise(mine) if pair in beside}
        gone = set()
        for other in others:
            theirs = lines[other]
            for y, line in enumerate(mine):
                if other >= i or not is_long(line) or line not in theirs:
                    continue
                x = theirs.index(line)
                up = next(k for k in itertools.count(1) if y - k < 0 or x - k < 0 or mine[y - k] != theirs[x - k])
                down = next(k for k in itertools.count(1) if y + k >= len(mine) or x + k >= len(theirs) or mine[y + k] != theirs[x + k])
                gone |= set(range(y - up + 1, y + down))
        lost[i] = sorted(gone)
    return lost


@pytest.mark.parametrize("seed, rare", [(1, 1000), (2, 3), (3, 1)])
def test_line_dedup_against_brute_force(spark, seed, rare):
    """With every earlier document as a partner, and with the partners of frequent lines."""
    rnd = random.Random(seed)
    pool = [f"line {k} with five words or more" for k in range(25)] + [f"short {k}" for k in range(12)]
    rows = []
    for i in range(60):
        text = rnd.sample(pool, rnd.randint(1, 9))
        if rows and rnd.random() < 0.6:  # a passage of an earlier document
            old = rnd.choice(rows)[1].split("\n")
            at = rnd.randrange(len(old))
            text[rnd.randrange(len(text) + 1) : 0] = old[at : at + rnd.randint(1, 6)]
        rows.append((i, "\n".join(dict.fromkeys(text))))
    got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.deduplicated_lines(documents(spark, rows), rare=rare).collect()}
    want = plain_dedup(rows, rare)
    assert got == want and sum(map(len, want.values())) > 100


def test_line_dedup_meets_later_partners_of_a_common_line(spark):
    line, short = "one line that very many documents have", "ok then"
    for others in (0, 40):  # a rare line and a frequent one
        docs = [(1, f"a\n{line}"), (2, f"b\n{line}\n{short}\nc"), (3, f"d\n{line}\n{short}\ne"), *((100 + i, f"{line}\nx{i}") for i in range(others))]
        got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.deduplicated_lines(documents(spark, docs)).collect()}
        assert (got[1], got[2], got[3]) == ([], [1], [1, 2])


def test_line_dedup_of_a_very_long_document(spark):
    long = "\n".join(f"line number {i} of a long document" for i in range(30_000))
    rows = [(1, long), (2, "line number 7 of a long document\nonly here"), (3, long + "\nnew line of more than five words")]
    got = {r["doc_id"]: r["deleted_lines"] for r in line_dedup.deduplicated_lines(documents(spark, rows)).collect()}
    assert got[1] == [] and got[2] == [0] and got[3] == list(range(30_000))
