"""Exact, suffix, line and n-gram deduplication against plain versions."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from linkloom.llm import exact_dedup, line_dedup, ngram_join, suffix_dedup
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = re.compile("[\x20\x09-\x0d]")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def random_texts(seed, n=60):
    """Short texts over a small vocabulary, with copies, near copies, repeated passages, empty, blank and null ones."""
    rng = random.Random(seed)
    vocabulary = ["ab", "the", "of", "née", "stone", "river", "q", "lantern", "über", "x1"]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage = " ".join(words(40))
    out = [None, "", " \n\t", "one two", "one  two", "One two"]
    while len(out) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(out) > 8:
            out.append(rng.choice(out))
        elif kind == 1 and len(out) > 8 and (base := (rng.choice(out) or "x").split(" ")):
            base[rng.randrange(len(base))] = "changed"
            out.append(" ".join(base))
        elif kind == 2:
            out.append(" ".join(words(10)) + " " + passage[rng.randrange(30) :] + "\n" + " ".join(words(5)))
        else:
            out.append("\n".join(" ".join(words(rng.randrange(1, 15))) for _ in range(rng.randrange(1, 6))))
    return out


def test_exact_groups_against_plain(spark):
    texts = [*random_texts(1), "a b\r\n", "ab", "a\x0bb", "é" * 400 + "x", "é" * 400 + "y", "é" * 400 + " x"]
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i))
    for digest_all in (True, False):
        rows = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, texts), digest_all=digest_all).collect()}
        assert len(rows) == len(texts)
        for norm, members in groups.items():
            keep = min(members)[1]
            for _, i in members:
                assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (keep, len(members), i == keep)
                if digest_all or len(members) > 1:
                    assert rows[i]["content_hash"] == hashlib.sha256(norm.encode()).hexdigest()
    kept = {r["doc_id"] for r in exact_dedup.exact_dedup(frame(spark, texts)).collect()}
    assert kept == {min(m)[1] for m in groups.values()}


def test_exact_groups_with_a_hot_group(spark, monkeypatch):
    """Half of all rows are one text; hot and other keys give the same as the plain way, and no key is both."""
    texts = [["hot copy", "h ot copy ", None, "", f"alone {n}", f"pair {n // 8}", "head " + "x" * 300 + str(n % 3)][n % 7 if n % 2 else 0] for n in range(400)]
    by_norm = {}
    for n, t in enumerate(texts):
        by_norm.setdefault("".join((t or "").split()), []).append(n)
    want = {}
    for members in by_norm.values():
        keep = min(members, key=lambda n: (-len(texts[n] or ""), n))
        want |= {n: (keep, len(members)) for n in members}
    for part in (1, 4, 20, 1000):
        monkeypatch.setattr(exact_dedup, "HOT_PART", part)
        for digest_all in (False, True):
            rows = exact_dedup.exact_groups(frame(spark, texts), digest_all=digest_all).collect()
            assert len(rows) == len(texts) and {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows} == want


def test_exact_edges(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    rows = exact_dedup.exact_groups(frame(spark, ["x", "x", "y"], [None, 3, 3]).withColumn("head", F.lit(1))).collect()
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in rows} == {(None, None, 2), (3, None, 2), (3, 3, 1)}
    twice = exact_dedup.exact_groups(frame(spark, ["x", "x"], [5, 5])).collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in twice] == [(5, 2, True)] * 2


def plain_repeats(texts, ids):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, d in sorted(zip(ids, data), key=lambda x: x[0]):
        for p in range(len(d) - 49):
            first.setdefault(d[p : p + 50], i)
    out = []
    for i, d in zip(ids, data):
        gone = np.zeros(len(d), dtype=bool)
        for p in range(len(d) - 49):
            if first[d[p : p + 50]] < i:
                gone[p : p + 50] = True
        edges = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(d), int(gone.sum()), int((edges == 1).sum()), bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup_against_plain(spark, seed):
    texts = [*random_texts(seed, 90), "z" * 400, "z" * 51, "z" * 50, "\0" * 60, "\0" * 70, "haha" * 40]
    ids = random.Random(seed).sample(range(1000), len(texts))
    rows = suffix_dedup.remove_repeats(frame(spark, texts, ids)).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows) == sorted(plain_repeats(texts, ids))


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0
    text = "".join(random.Random(3).choices("abcdefgh", k=200))
    rows = suffix_dedup.remove_repeats(frame(spark, [text, text, text, None], [None, 7, 7, 1]).withColumn("shard", F.lit(0))).collect()
    assert sorted((r["doc_id"] or 99, r["n_removed"]) for r in rows) == [(1, 0), (7, 0), (7, 0), (99, 200)]


def test_long_document_is_cut_with_overlap(monkeypatch):
    text = random.Random(4).randbytes(700)
    whole = suffix_dedup.Stretches([text])
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    cut = suffix_dedup.Stretches([text])
    windows = lambda s: sorted((a + k, n) for a, c, n in zip(s.at, s.starts, s.name, strict=True) for k in range(c))
    assert windows(whole) == windows(cut) and len(windows(cut)) == 651


def test_merged_transforms_give_the_sorted_suffixes():
    rng = random.Random(5)
    shards = [["".join(rng.choices("ab", k=rng.randrange(1, 30))).encode() for _ in range(rng.randrange(1, 6))] for _ in range(4)]
    strings = [s for shard in shards for s in shard]
    string, offset, block, lengths = suffix_dedup.merge_transforms([np.frombuffer(suffix_dedup.transform(s), "<u2") for s in shards], [len(s) for s in shards], depth=6)
    assert lengths.tolist() == [len(s) for s in strings]
    prefixes = [strings[s][o : o + 6] for s, o in zip(string, offset)]
    assert prefixes == sorted(prefixes) and all(len(p) == 6 for p in prefixes)
    every = [s[o : o + 6] for s in strings for o in range(len(s) - 5)]
    assert sorted(prefixes) == sorted(p for p in every if every.count(p) > 1)
    assert len(set(zip(prefixes, block.tolist()))) == len(set(prefixes)) == len(set(block.tolist()))


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, k):
    for _ in range(k):
        at = rng.randrange(len(line))
        line = rng.choice([line[:at] + line[at + 1 :], line[:at] + rng.choice("xyzé") + line[at:], line[:at] + rng.choice("xyzé") + line[at + 1 :]])
    return line


def test_bit_parallel_distance(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choices("abé", k=rng.randrange(5, 30)))
        pairs.append((a, edited(rng, a, rng.randrange(5)) or "x"))
    pairs = [(a, b) for a, b in pairs if len(b) > 4]
    df = spark.createDataFrame(pairs, "a string, b string")
    for k in (1, 2, 3):
        got = [(r["a"], r["b"], r["near"]) for r in df.withColumn("near", line_dedup.within_distance(F.col("a"), F.col("b"), k)).collect()]
        assert [x for x in got if x[2] != (levenshtein(x[0], x[1]) <= k)] == []


def test_line_dedup_against_plain(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choices("abcdé ", k=rng.randrange(18, 40))) for _ in range(25)]
    lines += ["template of many lines that differ in one word " + "".join(rng.choices("abcdefghijkl", k=6)) for _ in range(25)]
    texts = [None, "", "short\nshort", "\n\n", "short\n \n \nshorts"]
    for _ in range(80):
        own = [edited(rng, rng.choice(lines), rng.randrange(4)) for _ in range(rng.randrange(1, 7))]
        own += [rng.choice(own)] if rng.random() < 0.3 else []
        own += rng.choices(["", " ", "}", "end", "ends"], k=rng.randrange(4))
        rng.shuffle(own)
        texts.append("\n".join(own))
    long = lambda x: len(x) >= line_dedup.MIN_CHARS
    expected = []
    for i, t in enumerate(texts):
        earlier = {x for u in texts[:i] if u is not None for x in u.split("\n") if x.strip()}
        kept, seen = [], set()
        for x in (t or "").split("\n"):
            if x.strip() and (x in seen or x in earlier or long(x) and any(long(e) and levenshtein(x, e) <= 2 for e in earlier)):
                continue
            seen.add(x)
            kept.append(x)
        n = len(t.split("\n")) if t is not None else 0
        expected.append((i, None if t is None else "\n".join(kept), n, n - len(kept) if t is not None else 0))
    got = line_dedup.dedup_lines(frame(spark, texts), report=True)
    assert sorted((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == expected
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("threshold", [1, 2, 3, 4])
def test_line_dedup_at_every_threshold(spark, monkeypatch, threshold):
    """Numbered lines, lines with few digits or none, and letters that only the first counts tell apart; keys of three lines are a crowd."""
    monkeypatch.setattr(line_dedup, "CROWD", 2)
    rng = random.Random(threshold)
    texts = [f"invoice {rng.randrange(10**6):06d} was sent" for _ in range(25)]
    texts += [f"{rng.choice(['row', 'no'])} of a table {rng.choice(['', '7', '12', '345'])}" for _ in range(10)]
    texts += ["".join(rng.choices("abt ", k=rng.randrange(9, 14))) for _ in range(10)]
    texts += ["a line of letters ttttt x", "a line of letters tttttax"]
    texts += [edited(rng, rng.choice(texts), rng.randrange(threshold + 2)) for _ in range(25)]
    rng.shuffle(texts)
    near = lambda x, y: x == y or len(x) >= 8 and len(y) >= 8 and levenshtein(x, y) <= threshold
    expected = {i for i, x in enumerate(texts) if x.strip() and any(near(x, y) for y in texts[:i])}
    got = line_dedup.line_verdicts(frame(spark, texts), threshold=threshold, min_chars=8)
    assert {r["doc_id"] for r in got.collect()} == expected


def test_numbered_lines_take_no_square(spark):
    """Lines that differ in digits alone: eight times as many take far less than eight times eight times as long."""
    rng = random.Random(8)
    took = []
    for n in (500, 4000):
        texts = [f"invoice number {x:08d} was sent to the customer in good order" for x in rng.sample(range(10**8), n)]
        began = time.time()
        line_dedup.near_copies(frame(spark, texts)).count()
        took.append(time.time() - began)
    assert took[1] < 6 * took[0]


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0
    line = "a line of more than twenty characters"
    rows = line_dedup.dedup_lines(frame(spark, [line, line + "!", line, line], [None, 2, 2, 3])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in rows) == [(0, line), (2, line), (2, line + "!"), (3, "")]
    clashing = frame(spark, [line, line]).select("*", *[F.lit(7).alias(c) for c in ("n_lines", "n_dropped", "id", "pos", "h", "line", "version")])
    rows = line_dedup.dedup_lines(clashing, report=True).collect()
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["id"], r["line"]) for r in rows) == [(0, 1, 0, 7, 7), (1, 1, 1, 7, 7)]


def test_line_dedup_of_a_long_text(spark):
    """200,000 lines, a third of them repeated in the text, one huge line."""
    lines = [f"line number {i % 130_000} of a very long text" for i in range(200_000)] + ["x" * 300_000]
    began = time.time()
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(frame(spark, ["\n".join(lines), lines[7] + "\n" + lines[9][:-1]]), report=True, min_chars=1_000_000).collect()}
    assert (rows[0]["n_lines"], rows[0]["n_dropped"], rows[1]["text"]) == (200_001, 70_000, lines[9][:-1])
    assert rows[0]["text"] == "\n".join(dict.fromkeys(lines)) and time.time() - began < 30


def plain_components(texts):
    sets = []
    for t in texts:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed, n):
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(400)}" for _ in range(k)]
    common = words(30)
    out = [None, "", "  ", "a b", "A  B", "a b c d e", "K b"]
    base = words(80)
    while len(out) < n:
        kind = rng.randrange(5)
        if kind == 0:
            out.append(" ".join(words(rng.randrange(1, 60)) + common))
        elif kind == 1 and len(out) > 12:
            own = (out[rng.randrange(7, len(out))] or "a").split(" ")
            own[rng.randrange(len(own))] = "changed"
            out.append("\n".join(own))
        else:
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(50)}"
            out.append(" ".join(own))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_against_plain(spark, seed):
    texts = near_texts(seed, 250)
    got = ngram_join.near_duplicates(frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == plain_components(texts)
    kept = ngram_join.keep_one_of_each(frame(spark, texts))
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in plain_components(texts)}


def test_ngram_join_edges(spark):
    assert ngram_join.near_duplicates(frame(spark, [])).count() == 0
    rows = ngram_join.near_duplicates(frame(spark, ["a b c", "a b c", "a b c", "q"], [None, 4, 4, 2]).withColumn("n", F.lit(9))).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(0, 1, None), (2, 1, 2), (4, 1, 4), (4, 1, 4)]


def thue_morse(bits, letters):
    word = letters[0]
    for _ in range(bits):
        word += word.translate(str.maketrans(letters, letters[::-1]))
    return word


def test_words_that_polynomial_hashes_confuse(spark):
    """A word and its complement collide in any polynomial modulo a power of two."""
    a, b = thue_morse(10, "ab"), thue_morse(10, "ba")
    got = ngram_join.near_duplicates(frame(spark, [a, b])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(0, 0), (1, 1)]
    texts = [f"{x} {y}" for x, y in ((a, "x" * 60), (b, "y" * 60), (a[:500], "z" * 60))]
    got = suffix_dedup.remove_repeats(frame(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(i, n) for i, _, n, _, _ in plain_repeats(texts, range(3))]


def test_shingles_of_long_words_and_texts():
    words = ["w" * 100_000, *[f"v{i % 70_000}" for i in range(200_000)]]
    assert len(ngram_join.shingles(" ".join(words))) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    x, y = (ngram_join.shingles(" ".join(words[a:b])) for a, b in ((0, 1000), (500, 1500)))
    assert ngram_join.in_common(x, y) == 496


def test_components_of_a_long_chain(spark):
    order = list(range(60))
    random.Random(8).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])] + [(100, 101)], "u long, v long")
    got = {r["id"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 60)} | {101: 100}


def test_transforms_are_shuffled_compressed():
    rng = random.Random(7)
    words = ["".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(40)]
    strings = [" ".join(rng.choices(words, k=12)).encode()[:80] for _ in range(2000)]
    transformed = suffix_dedup.transform(strings)
    data = suffix_dedup.packed(transformed)
    assert len(data) < len(transformed) / 4  # 16-bit symbols
    assert (suffix_dedup.unpacked(data) == np.frombuffer(transformed, "<u2")).all()
    for strings in ([b""], [b"", b""], [b"a"], [b"ab", b"ab", b"b"], ["né à né".encode(), b"x"]):
        suffixes = [(s[k:] , i, k) for i, s in enumerate(strings) for k in range(len(s) + 1)]
        plain = [strings[i][k - 1] + 1 if k else 0 for _, i, k in sorted(suffixes)]
        assert np.frombuffer(suffix_dedup.transform(strings), "<u2").tolist() == plain
        assert suffix_dedup.unpacked(suffix_dedup.packed(suffix_dedup.transform(strings))).tolist() == plain
