"""Importance resampling, license scans and fill-in-middle against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fill_in_middle, importance, license_scan
from tests.llm.test_corpus import EDGES, corpus, documents

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def some(n=80, seed=9):
    """Documents with copies, repeated ids, licenses and markers among them."""
    rows = [*corpus(n, seed), *((2000 + i, "Copied text, ten words and more: a b c d e f g h i j k l m n", "src1") for i in range(9)), *EDGES]
    rows += [(3000, "Released under the MIT License. Under the MIT license!"), (3001, "holds <P> itself"), (3002, "ends in <"), (3003, "<S"), (3004, "ünder the MIT license"), (3005, "Apache License, Version 2.0; CC BY-NC 4.0 cc by nc")]
    return rows


# -- 11


def drawn_by_hand(rows, target, percent, min_words, seed, buckets, max_n):
    def features(text):
        words = words_of(text)
        return len(words), [zlib.crc32(b" ".join(words[i : i + n])) % buckets for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(features(r[1])[1])
    for text in target:
        t.update(features(text)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for r in rows:
        n, found = features(r[1])
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append((r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0))), n))
    able = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranks = Counter()
    for i, x in enumerate(able[: len(able) * percent // 100]):
        ranks[(x[:4], i + 1)] += 1
    rest = Counter((x[:4], None) for x in out)
    for (x, _), n in ranks.items():
        rest[(x, None)] -= n
    return ranks + rest


@pytest.mark.parametrize("percent, max_n, digit", [(10, 1, 16), (37, 2, 3), (100, 3, 16), (0, 1, 16)])
def test_importance_against_brute_force(spark, monkeypatch, percent, max_n, digit):
    monkeypatch.setattr(importance, "DIGIT", digit)
    monkeypatch.setattr(importance, "PIECE", 50)
    rows = some()
    target = ["data run w1 w2 w3", None, "", "the of and w7", "漢字 Über"]
    docs = documents(spark, rows, extra=("score", "rank", "_at", "n_words"))
    found = importance.resampled(docs, spark.createDataFrame([(x,) for x in target], "text string"), percent, 12, 5, 97, max_n)
    got = Counter(((r["doc_id"], r["n_features"], r["weight"], r["score"]), r["rank"]) for r in found.collect())
    assert got == drawn_by_hand(rows, target, percent, 12, 5, 97, max_n)


def test_importance_draws_part_of_equal_rows(spark):
    rows = [(7, "one two three four", "s")] * 30 + [(None, "one two three four", "s")] * 30
    found = importance.resampled(documents(spark, rows).repartition(4), spark.createDataFrame([], "text string"), 40, 3).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 25)) and len(found) == 60
    empty = documents(spark, [])
    assert importance.resampled(empty, spark.createDataFrame([], "text string")).count() == 0


def test_first_rows_at_the_ends_of_the_longs(spark):
    values = [-(2**63), -1, 0, 1, 2**62, 2**63 - 1, 5, 6, -7]
    table = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    for k in range(len(values) + 1):
        kept = table.filter(importance.first_rows(table, [F.col("v"), F.col("i")], k))
        assert sorted(r["v"] for r in kept.collect()) == sorted(values)[:k]


# -- 12


def scanned_by_hand(text):
    words = [w.decode() for w in words_of(text)]
    base, labels, best = [], set(), 0.0
    for t in license_scan.TEMPLATES:
        votes = {}
        for i in range(len(words) - 2):
            for p, run in enumerate(t.runs):
                if " ".join(words[i : i + 3]) == run:
                    votes.setdefault(i - p, []).append((p, i))
        groups = []
        for d in sorted(votes):
            if groups and d - groups[-1][-1] <= t.gap:
                groups[-1].append(d)
            else:
                groups.append([d])
        for group in groups:
            hits = [x for d in group for x in votes[d]]
            first, end = min(i for _, i in hits), max(i for _, i in hits) + 3
            share = len({p for p, _ in hits}) / len(t.runs)
            if end - first > 2 * len(t.words.split()):
                continue
            best = max(best, share)
            if share >= t.share:
                labels.add(t.label)
                if t.base:
                    base.append((first, t.label))
    return len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best


NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def test_licenses_against_brute_force(spark):
    rnd = random.Random(6)
    texts = [t.words for t in license_scan.TEMPLATES]
    rows = some() + [(4000 + i, " ".join(rnd.choice([rnd.choice(texts), rnd.choice(texts).upper(), "x", "the mit", "cc by"]) for _ in range(rnd.randint(1, 30)))) for i in range(60)]
    for i in range(40):  # notices with words changed, put in or left out
        words = rnd.choice(texts[17:]).split()
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randint(0, 2)] = ["new"] * rnd.randint(0, 2)
        rows.append((5000 + i, "before " + " ".join(words) + " after"))
    rows += [(6000, "under the mit license " * 3000), (6001, "under the mit license"), (6001, "under the mit license"), (None, "cc by nc"), (6002, "cc by-K"), (6003, "mozilla public K license v 2")]
    got = sorted(map(repr, (tuple(r) for r in license_scan.scanned(documents(spark, rows, extra=("label", "run", "part", "hash"))).drop("spans").collect())))
    assert got == sorted(repr((r[0], *scanned_by_hand(r[1]))) for r in rows)


def test_changed_notices_are_found_and_spanned(spark):
    changed = NOTICE.replace("hereby granted", "hereby freely granted").replace("any person", "all people")
    rows = {r["doc_id"]: r for r in license_scan.scanned(documents(spark, [(1, f"x y {changed} z"), (2, NOTICE[:60]), (3, "This work is licensed under the GNU General Public License, version 3.")])).collect()}
    assert (rows[1]["labels"], rows[1]["base_labels"]) == ("mit", "") and 0.6 <= rows[1]["score"] < 1
    assert (rows[1]["spans"][0]["first"], rows[1]["spans"][0]["end"], rows[1]["spans"][0]["label"]) == (2, 23, "mit")
    assert rows[2]["labels"] == "" and 0 < rows[2]["score"] < 0.6 and rows[3]["labels"] == "gpl,gpl-3"
    assert license_scan.scanned(documents(spark, [])).count() == 0


def test_licenses_are_native(spark):
    plan = license_scan.scanned(documents(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    with pytest.raises(ValueError):
        license_scan.scanned(documents(spark, []), (license_scan.Template("x", "too short"),))


# -- 13


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_elias_fano_selects_every_number(n):
    rnd = np.random.default_rng(n)
    for spread in (1, 3, 900):
        numbers = np.cumsum(rnd.integers(1, spread + 1, n))
        if n > 300:
            numbers[n // 2 :] += 100_000  # a long gap: many empty bytes between two ones
        ends = fill_in_middle.EliasFano(fill_in_middle.EliasFano.encoded(numbers))
        assert ends.n == n and [ends.select(i) for i in range(n)] == numbers.tolist() and ends.before(0) == 0


def test_unit_ends_are_those_of_the_pattern():
    for text in ("", "a", "ab c", "éàx{|}[\\]^`@Zz09", "😀a\nb\x00K", "word " * 500):
        ends = [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        assert fill_in_middle.unit_ends(text).tolist() == ends


@pytest.mark.parametrize("hot_rows", [64, 2])
def test_fill_in_middle_against_brute_force(spark, hot_rows):
    rows = some()
    docs = documents(spark, rows, extra=("digest", "part", "place", "own"))
    moved = fill_in_middle.transformed(docs, hot_rows=hot_rows)
    got = Counter(tuple(r) for r in fill_in_middle.digests(moved).collect())
    want = Counter()
    for r in rows:
        text = r[1] or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        digest = hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            form, out, lengths = "plain", text, (None, None)
        elif h4 % 100 < 20:
            form, out, lengths = "spm", f"<S>{s}<P>{p}<M>{m}", (len(p), len(m))
        else:
            form, out, lengths = "psm", f"<P>{p}<S>{s}<M>{m}", (len(p), len(m))
        want[(r[0], len(units), form, *lengths, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert got == want


def test_fill_in_middle_verifies_contents_and_empty_tables(spark):
    clash = spark.createDataFrame([(bytearray(b"d"), "one"), (bytearray(b"d"), "two")], "digest binary, text string")
    with pytest.raises(Exception, match="texts of one digest differ"):
        fill_in_middle.different_texts(clash).collect()
    assert fill_in_middle.transformed(documents(spark, [])).count() == 0
