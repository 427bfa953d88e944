"""Operators 2, 3, 4 and 7 against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from vellum.llm import bytes_dedup, simhash, tokens, words_dedup

SCHEMA = "doc_id long, text string, lang string, rid string, found string, fp string, k string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "k") for i, t in rows], SCHEMA)


def copied(seed, n=60):
    """Texts with shared passages, copies, near copies, repeats inside, nulls, empty ones and repeated rows."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ñ", k=r.randint(1, 7))).replace(" ", "") or "q"
    words = lambda n: " ".join(word() for _ in range(n))
    shared = [words(r.randint(52, 90)) for _ in range(3)]
    out = [(1, None), (2, ""), (3, " \t\n"), (None, shared[0] + " end"), (4, "Zebra"), (5, "zebra")]
    for i in range(6, n):
        kind, t = r.randrange(6), words(r.randint(1, 160))
        if kind == 0:
            t += " " + r.choice(shared) + " " + words(5)
        elif kind == 1:
            t = (r.choice(out)[1] or "") + r.choice(["", " x", " tail"])
        elif kind == 2:
            p = words(60)
            t = f"{p}\n{t}\n{p} {p}"
        elif kind == 3:
            w = (r.choice(out)[1] or "a").split(" ")
            w[r.randrange(len(w))] = word()
            t = "  ".join(w)
        out.append((i, t))
    return [*out, out[10], out[20], (out[30][0], words(70))]


def test_bytes(spark):
    rows = copied(1)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bytes_dedup.remove_repeats(frame(spark, rows)).collect())
    raw, seen = [(t or "").encode() for _, t in rows], {}
    for n, x in enumerate(raw):
        for p in range(len(x) - 199):
            seen.setdefault(x[p : p + 200], []).append((n, p))
    gone = [bytearray(len(x)) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for n, p in places:
                gone[n][p : p + 200] = b"\1" * 200
    want = []
    for (i, _), x, g in zip(rows, raw, gone, strict=True):
        left = bytes(c for c, y in zip(x, g, strict=True) if not y)
        want.append((i if i is not None else -1, len(x), sum(g), len(re.findall(b"\1+", g)), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("window", [50, 7, 1])
def test_words(spark, window):
    rows = copied(2)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_sha256) for r in words_dedup.remove_repeats(frame(spark, rows), window=window).collect())
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    key = [i if i is not None else 2**63 for i, _ in rows]
    least = {}
    for k, w in zip(key, words, strict=True):
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            least[x] = min(least.get(x, k), k)
    want = []
    for (i, _), k, w in zip(rows, key, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < k:
                gone[p : p + window] = [True] * window
        left = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i if i is not None else -1, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want)
    assert sum(w[2] for w in want) > 100


def brute_fingerprint(text):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not w:
        return 0
    grams = [b" ".join(w[p : p + 4]) for p in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    rows = copied(3, 300)
    fps = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                label[root(a)] = root(b)
    key = [i if i is not None else 2**63 for i, _ in rows]
    low = {}
    for n in range(len(rows)):
        low[root(n)] = min(low.get(root(n), 2**63), key[n])
    want = sorted((str(i), f"{fps[n]:016x}", low[root(n)]) for n, (i, _) in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    assert got == want
    assert len({w[2] for w in want}) < len(want) - 20
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(low.values())  # a row of each group, though two groups share id 30


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_near_fingerprints_share_a_key(x, flips):
    import numpy as np

    y = x ^ sum(1 << f for f in flips)
    rows, keys = simhash.golay_keys(np.array([x, y], np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_chain_of_links(spark):
    """A chain whose ends differ in many bits is one component."""
    chain = [(1 << (4 * k)) - 1 for k in range(16)]
    links = simhash.links(spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in chain], "fp long"))
    from vellum.llm.components import components

    got = components(spark.createDataFrame([Row(node=x, label=x) for x in chain]), links).collect()
    assert {r.label for r in got} == {0} and len(got) == 16


def test_tokens(spark):
    import tiktoken

    ranks = tokens.load(tokens.VOCABULARY)
    whole = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    rows = []
    for i, t in copied(4, 80):
        edits = [None] if i == 7 else None if i == 8 else [(r.randint(-5, 700), r.randint(-5, 700), r.choice(["", "a b", "  \n ", "'ll", "1234é", None])) for _ in range(r.randint(0, 6))]
        rows.append((i, t, edits))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokens.EDITS}").withColumn("n_tokens", F.lit("clash"))
    got = sorted((str(x.doc_id), x.n_tokens, x.n_tokens_edited) for x in tokens.count_tokens(df, edits_col="edits").collect())
    want = []
    for i, t, edits in rows:
        now = t or ""
        for e in edits or ():
            if e:
                a = max(0, min(e[0], len(now)))
                b = max(a, min(e[1], len(now)))
                now = now[:a] + (e[2] or "") + now[b:]
        want.append((str(i), len(whole.encode_ordinary(t or "")), len(whole.encode_ordinary(now))))
    assert got == sorted(want)


def test_edits_touch_little():
    counter = tokens.Counter(tokens.load(tokens.VOCABULARY))
    tree = tokens.TokenTree("some words of a long text, " * 4000, counter)
    tree.edit(50_000, 50_010, "other")
    assert tree.reencoded < 60 and tree.total == tokens.TokenTree(tree.text, counter).total


@pytest.mark.parametrize("f", [bytes_dedup.remove_repeats, words_dedup.remove_repeats, simhash.near_duplicates, simhash.keep_first, tokens.count_tokens])
def test_empty_table(spark, f):
    assert f(frame(spark, [])).count() == 0


def test_very_long_text(spark):
    text = "the same line of words, over and over again\n" * 60_000
    df = frame(spark, [(1, text), (2, "a short one"), (3, text)])
    a = {r.doc_id: (r.n_bytes, r.n_removed) for r in bytes_dedup.remove_repeats(df).drop("kept").collect()}
    assert a[1] == a[3] == (len(text), len(text)) and a[2] == (11, 0)
    b = {r.doc_id: (r.n_words, r.n_removed) for r in words_dedup.remove_repeats(df).drop("kept").collect()}
    assert b[1] == (540_000, 0) and b[3] == (540_000, 540_000)
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1, 2}


def shared_by_many(seed, n=400):
    """A passage that nearly all texts hold, with neighbours of its own in each, and 120 equal rows."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(1, 7))) for _ in range(n))
    common_words = words(70)
    rows = [(i, f"{words(r.randint(5, 60))} {common_words} {words(r.randint(5, 60))}") for i in range(n)]
    ends = [words(3) for _ in range(6)]
    rows += [(n + i, f"{r.choice(ends)} {common_words} {r.choice(ends)} {words(30)}") for i in range(60)]
    return rows + [(n + 100, words(80) + " " + common_words)] * 120 + [(n + 200, words(90))]


def brute_words(rows, window):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    least = {}
    for (k, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - window + 1):
            x = tuple(w[p : p + window])
            least[x] = min(least.get(x, k), k)
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        want.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(want)


def brute_bytes(rows, length=200):
    raw, seen = [(t or "").encode() for _, t in rows], {}
    for n, x in enumerate(raw):
        for p in range(len(x) - length + 1):
            seen.setdefault(x[p : p + length], []).append((n, p))
    gone = [bytearray(len(x)) for x in raw]
    for places in seen.values():
        if len(places) > 1:
            for n, p in places:
                gone[n][p : p + length] = b"\1" * length
    return sorted((i, len(x), sum(g), hashlib.sha256(bytes(c for c, y in zip(x, g, strict=True) if not y)).hexdigest()) for (i, _), x, g in zip(rows, raw, gone, strict=True))


@pytest.mark.parametrize("anchor, batch, held", [(256, 8, 32 << 20), (2, 10**9, 32 << 20), (10**9, 1, 32 << 20), (10**9, 10**9, 4000), (0, 0, 1000)])
def test_hot_anchors_give_the_same(spark, monkeypatch, anchor, batch, held):
    from vellum.llm import repeats

    for name, value in (("HOT_ANCHOR", anchor), ("HOT_BATCH", batch), ("HELD", held)):
        monkeypatch.setattr(repeats, name, value)
    rows = shared_by_many(5)
    df = frame(spark, rows).repartition(7)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in words_dedup.remove_repeats(df).drop("kept").collect())
    assert got == brute_words(rows, 50)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in bytes_dedup.remove_repeats(df).drop("kept").collect())
    assert got == brute_bytes(rows)


def test_hot_anchors_take_that_way(spark, monkeypatch):
    from vellum.llm import repeats

    kinds = {r.kind for r in repeats.fates(repeats.run_rows(repeats.identified(frame(spark, shared_by_many(5)), "doc_id", "text"), words_dedup.cut_words(50), True), True).select("kind").distinct().collect()}
    assert repeats.HOT in kinds and repeats.SPAN in kinds


@pytest.mark.parametrize("window", [50, 1])
def test_long_texts_are_cut_without_loss(monkeypatch, window):
    """Parts of a long text have each window once, anchors inside their runs, and hashes that don't depend on the cut."""
    import numpy as np

    from vellum.llm import common

    r = random.Random(9)
    text = " ".join("".join(r.choices("abc", k=r.randint(1, 5))) for _ in range(30_000)).encode() + b" " + b"x" * 9000 + b" end"
    data, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    seen = {}
    for piece in (1 << 20, 5000):
        monkeypatch.setattr(common, "PIECE", piece)
        monkeypatch.setattr(common.pieces, "__defaults__", (piece,))
        row, v, _, s, n, a = (np.concatenate(x) for x in zip(*words_dedup.cut_words(window)(data, off), strict=True))
        gram = words_dedup.levels(window)[0]
        assert (a >= s + n - 1).all() and (a + gram <= s + window).all()
        starts = np.repeat(s, n) + words_dedup.within(n)
        assert np.array_equal(np.sort(starts), np.arange(30_002 - window + 1))
        seen[piece] = np.stack([np.repeat(v, n), np.repeat(a, n).astype(np.uint64)])[:, np.argsort(starts)]
    assert np.array_equal(seen[1 << 20], seen[5000])


def test_places_beyond_a_part_are_refused():
    import numpy as np

    from vellum.llm import runs

    with pytest.raises(ValueError):
        runs.runs(np.zeros((1 << runs.POSITION) + 2, np.uint64), np.array([0, (1 << runs.POSITION) + 1]), 50, 13)


def test_more_words_than_a_place_has_bits(spark):
    """A text of 4.5 million words, whose last ones stand in two other texts as well."""
    rows = spark.range(1).selectExpr("1L as doc_id", "array_join(transform(sequence(1, 4500000), x -> cast(x as string)), ' ') as text")
    tail = [str(k) for k in range(4_499_901, 4_500_001)]
    others = spark.createDataFrame([(0, "first " + " ".join(tail) + " last"), (2, " ".join(tail[:60]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in words_dedup.remove_repeats(rows.union(others)).drop("kept", "spans").collect()}
    assert got[0] == (102, 0) and got[1] == (4_500_000, 100) and got[2] == (60, 60)


def test_column_wise_files_give_the_same(tmp_path):
    import numpy as np

    from vellum.llm.columnwise import repeated_starts

    r = random.Random(1)
    texts = ["".join(r.choices("ab", k=r.randint(0, 60))).encode() for _ in range(60)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    own, files = repeated_starts(data, off, 7), repeated_starts(data, off, 7, str(tmp_path))
    seen = {}
    for x in texts:
        for p in range(len(x) - 6):
            seen[x[p : p + 7]] = seen.get(x[p : p + 7], 0) + 1
    want = [p + 7 <= len(x) and seen[x[p : p + 7]] > 1 for x in texts for p in range(len(x))]
    assert own.tolist() == files.tolist() == want and not any(tmp_path.iterdir())
