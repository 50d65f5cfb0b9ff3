"""Operators against plain Python that follows their definition word by word."""

import math
import random
import time
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import chat_format, fingerprints, language_id, packing, quality_classifier, quality_rules

ALL = (1 << 64) - 1
GOLD = 0x9E3779B97F4A7C15


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & ALL
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def plain_parse(text):
    """(top name, {level: (least hashes, number of phrases)}) of locally consistent parsing."""
    low = lambda x: (x & -x).bit_length() - 1
    toss = lambda a, b: low(a ^ b) << 1 | a >> low(a ^ b) & 1
    names, level, levels = [ord(c) for c in text], 0, {}
    if not names:
        return 0, {}
    while True:
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [x if n == 1 else mix((x * GOLD + n) & ALL) for x, n in runs]
        if level > 3 and len(names) == 1:
            return names[0] ^ level, levels
        labels = [toss(x, names[i - 1] if i else x ^ 1) for i, x in enumerate(names)]
        for _ in range(fingerprints.ROUNDS):
            labels = [toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
        assert max(labels) < 6
        cuts = [0] + [i for i in range(2, len(names) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
        phrases = [names[a:b] for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True)]
        place = [mix((k * GOLD + 1) & ALL) | 1 for k in range(64)]
        names = [mix(sum(mix(x) * place[k] for k, x in enumerate(p)) & ALL) for p in phrases]
        level += 1
        for kept, keep, _ in fingerprints.LEVELS:
            if kept == level:
                seen = Counter()
                hashes = []
                for x in names:
                    hashes.append(mix((x + mix(seen[x] + GOLD & ALL)) & ALL) >> 32)
                    seen[x] += 1
                levels[level] = (sorted(hashes)[:keep], len(names))


def test_fingerprints_against_plain_parsing():
    draw = random.Random(3)
    texts = ["", "a", "aaaa", "ab" * 300, "😀é中 " * 40, *["".join(draw.choice("abcdef gh") for _ in range(draw.randint(1, 2000))) for _ in range(20)]]
    for text, (top, levels) in zip(texts, fingerprints.parse(texts), strict=True):
        own_top, own = plain_parse(text)
        assert int(top) & ALL == own_top & ALL
        assert {k: (sorted(h.tolist()), n) for k, (h, n) in levels.items()} == {k: (h, n) for k, (h, n) in own.items()}


def test_likeness_is_the_share_of_common_phrases():
    """Where a fingerprint holds all phrases of a level, likeness is the Dice share of the multisets."""
    draw = random.Random(8)
    checked = 0
    for _ in range(80):
        base = [draw.choice("abcdefgh") for _ in range(draw.randint(15, 60))]
        other = list(base)
        for _ in range(draw.randint(0, 6)):
            other[draw.randrange(len(other))] = draw.choice("xyz")
        a, b = fingerprints.parse(["".join(base), "".join(other)])
        level = max((k for k, keep, least in fingerprints.LEVELS if min(a[1][k][1], b[1][k][1]) >= least), default=1)
        keep = next(n for k, n, _ in fingerprints.LEVELS if k == level)
        x, y = Counter(a[1][level][0].tolist()), Counter(b[1][level][0].tolist())
        if max(a[1][level][1], b[1][level][1]) <= keep and (x | y).total() <= keep:
            assert math.isclose(fingerprints.likeness(a, b), 2 * (x & y).total() / (x.total() + y.total()))
            checked += 1
    assert checked >= 10


def test_fingerprints_of_repeated_ids(spark):
    """Rows that share a doc_id, or have none, are cut into ranges as well; each row meets the next one in the stated order."""
    texts = [f"text {k} of the table" for k in range(300)]
    rows = [(None if k < 100 else 7 if k < 220 else k, t) for k, t in enumerate(texts)] + [(7, texts[150])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]], r[1]))
    found = fingerprints.fingerprints(docs, 16).collect()
    prints = lambda t: fingerprints.parse([t])[0]
    expected = Counter((i, fingerprints.to_string(prints(t)), fingerprints.likeness(prints(t), prints(order[(k + 1) % len(order)][1]))) for k, (i, t) in enumerate(order))
    assert Counter((r.doc_id, r.fingerprint, r.near_next) for r in found) == expected


def plain_bits(train, text):
    """The code length of a text under order-3 PPM, method C, from the definition."""
    counts = [Counter() for _ in range(4)]
    for t in train:
        raw = b"\0" * 3 + t.lower().encode()
        for i in range(3, len(raw)):
            for n in range(4):
                counts[n][raw[i - n : i + 1]] += 1
    total = 0.0
    raw = b"\0" * 3 + text.lower().encode()
    for i in range(3, len(raw)):
        cost = 0.0
        for n in (3, 2, 1, 0):
            context = raw[i - n : i]
            seen = {k: v for k, v in counts[n].items() if k[:-1] == context}
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if raw[i - n : i + 1] in seen:
                cost += -math.log2(seen[raw[i - n : i + 1]] / whole)
                break
            cost += -math.log2(len(seen) / whole)
        else:
            cost += 8.0
        total += cost
    return total


def test_code_lengths_against_plain_ppm(spark):
    train = ["the cat sat on the mat", "a hat that", "Über den Fluß"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(train)] + [(0, train[0], "x")], "doc_id long, text string, lang string")
    tree = language_id.train(docs)["x"]
    for text in ("the hat", "zzz", "Fluß der Katze", "t"):
        codes, _ = language_id.grams([text])
        assert math.isclose(float(tree.bits(codes).sum()), plain_bits(train, text), rel_tol=1e-5)


def test_many_languages_and_a_bounded_sample(spark):
    rows = [(k, f"word{k % 300} text{k}", f"l{k % 300:03}") for k in range(3000)] + [(5, "word5 text5", "l005")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.train(docs)) == 300
    known = docs.select("lang", "doc_id", "text")
    sizes = {r.lang: r.n for r in language_id.sample(known, 4, 10_000).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert set(sizes.values()) == {4} and len(sizes) == 300
    assert set(r.n for r in language_id.sample(known, 600, 600).groupBy("lang").agg(F.count("*").alias("n")).collect()) == {2}


@pytest.mark.parametrize("length", [513, 1025, 1500, 2049, 3000, 4095])
def test_packing_carries_one_window_at_most(length):
    began, carried = time.process_time(), []
    for block in range(30):
        pool = packing.Pool()
        for item in carried + [((block, k), 0, length) for k in range(300)]:
            pool.add(item)
        full, carried = packing.pack_block(pool, packing.TIERS)
        assert all(sum(n for _, _, n in w) == tier for tier, w in full)
        assert sum(n for _, _, n in carried) < packing.TIERS[0]
    assert time.process_time() - began < 10


def plain_kept(text, limits):
    words = [w.decode() for w in (text or "").encode().split()]
    total = max(1, sum(map(len, words)))
    seen, line_chars = set(), 0
    for line in (text or "").encode().split(b"\n"):
        if line in seen:
            line_chars += sum(len(w.decode()) for w in line.split())
        elif line.split():
            seen.add(line)

    def share(n):
        at = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        inside = {k + j for k in range(len(words) - n + 1) if at[tuple(words[k : k + n])] > 1 for j in range(n)}
        return sum(len(words[k]) for k in inside) / total

    triples = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {k + j for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for j in range(3)}
    if len(words) < limits.min_words or 100 * len(inside) > limits.max_repeat_percent * len(words):
        return False
    return line_chars / total <= limits.lines and all(share(n) <= most + 1e-12 for n, most in limits.ngrams)


def test_kept_against_plain_coverage(spark):
    draw, limits = random.Random(6), quality_rules.Limits()
    texts = ["", " ", None]
    for _ in range(60):
        words = [f"w{draw.randrange(2000)}" for _ in range(draw.randint(20, 400))]
        phrase = words[: draw.randint(1, 30)]
        for _ in range(draw.randint(0, 12)):
            at = draw.randrange(len(words))
            words[at:at] = phrase
        texts.append("".join(w + draw.choice("    \n") for w in words))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    found = {r.k: r.r.kept for r in docs.select("k", quality_rules.repetition_rules(F.col("text")).alias("r")).collect()}
    assert [found[k] for k in range(len(texts))] == [plain_kept(t, limits) for t in texts] and len(set(found.values())) == 2
    assert docs.limit(0).select(quality_rules.repetition_rules(F.col("text"))).isEmpty()


def test_ridge_against_one_solve(spark):
    """Partition sums give the ridge weights of all rows at once; ties and doubled labels count as they come, null ones not."""
    draw = np.random.default_rng(5)
    rows = [(k, draw.random(quality_classifier.N_STATS).tolist()) for k in range(200)]
    labels = [(k, int(s[0] > 0.5) if k % 9 else None) for k, s in rows] + [(3, 1)]
    model = quality_classifier.train(spark.createDataFrame(rows, "doc_id long, stats array<double>").repartition(4), spark.createDataFrame(labels, "doc_id long, quality int"))
    import zlib

    fold = {k: zlib.crc32(str(k).encode()) % 5 for k, _ in rows}
    stats = dict(rows)
    used = [(stats[k], y) for k, y in labels if y is not None and 1 <= fold[k] <= 3]
    x, y = np.array([s for s, _ in used]), np.array([v for _, v in used], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = model.fourier(x)
    penalty = quality_classifier.RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    scores = model.score(x)
    assert ((0 <= scores) & (scores <= 1)).all() and scores[y == 1].mean() > scores[y == 0].mean() + 0.3


def test_chat_of_odd_conversations(spark, tmp_path):
    """Null texts, roles, turns and conversations, ties, repeated rows, control strings, long texts, clashing columns; no rows."""
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nno"), (2, None, None, "x"), (None, 3, "assistant", ""), (3, 70, "assistant", "late"), (3, 1, "assis tant", "[INST]" * 5000), (4, 0, "assistant\n", "odd role")]
    schema = "conv_id long, turn long, role string, text string, seq int, message string, kind string, formatted string"
    for k, some in enumerate((rows, [])):
        folder = str(tmp_path / str(k))
        spark.createDataFrame([(*r, 1, "m", "edit", "f") for r in some], schema).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
        df = chat_format.op4_event_sourced_chat(spark, folder)
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
        expected = con.sql(f"SELECT {', '.join(df.columns)} FROM ({chat_format.OP4_SQL})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(expected, key=str)
