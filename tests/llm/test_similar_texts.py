"""Near copies by fingerprints and shingle sets against brute force over all pairs."""

import itertools
import random

import numpy as np

from sitesift.llm import similar_texts as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, _row int, words_id string"
VOCABULARY = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("an", "or", "ie", "u") for c in ("", "t", "sel", "rim")]


def prose(rng, n):
    return rng.choices(VOCABULARY, k=n)


def replaced(rng, words, count):
    words = list(words)
    for at in rng.sample(range(len(words)), count):
        words[at] = f"x{rng.randrange(1000)}"
    return words


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return {b" ".join(words[i: i + width]) for i in range(len(words) - width + 1)} if words else set()


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return x == y if not x or not y else len(x & y) >= 0.8 * len(x | y)


def classes(texts):
    root = dict.fromkeys(range(len(texts)))
    for i in root:
        root[i] = i
    for i, j in itertools.combinations(range(len(texts)), 2):
        if similar(texts[i], texts[j]):
            a, b = root[i], root[j]
            root = {k: a if r == b else r for k, r in root.items()}
    return root


def test_groups_by_brute_force(spark):
    rng = random.Random(31)
    base = [prose(rng, rng.choice([40, 120, 400])) for _ in range(30)]
    texts = [" ".join(b) for b in base]
    for n, b in enumerate(base):  # similarities from below 0.5 to near 1
        texts += [" ".join(replaced(rng, b, max(1, len(b) * k // 400))) for k in (2, 4, 6, 9, 30)]
        texts += [" ".join(b).upper().replace(" ", " \n")] if n % 3 == 0 else []
    texts += ["", " \t", None, "one two", "ONE two", "one two three", " ".join(prose(rng, 30000))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    table = spark.createDataFrame([(i, texts[i], None, "s", 0, "n", 1, "w") for i in order], SCHEMA)
    got = S.keep_one_of_similar(table)
    assert got.columns == table.columns
    kept = {r.doc_id for r in got.collect()}
    root = classes(texts)
    groups = {}
    for i, r in root.items():
        groups.setdefault(r, []).append(i)
    assert all(min(g) in kept for g in groups.values())  # rows below the similarity never go
    extra = len(kept) - len(groups)
    assert extra <= 0.1 * (len(texts) - len(groups))  # at least nine tenths of the copies go


def test_large_groups_and_equal_rows(spark):
    rng = random.Random(32)
    base = prose(rng, 150)
    texts = [" ".join(base)] * 50 + [" ".join(replaced(rng, base, 1)) for _ in range(400)]
    rows = [(i, t, None, "s", 0, "n", 1, "w") for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, "s", 0, "n", 1, "w"), rows[0], rows[0], (None, None, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.doc_id for r in S.keep_one_of_similar(table).collect()), key=str) == [0, None]
    assert S.keep_one_of_similar(table.limit(0)).count() == 0


def test_lists_are_whole_over_batches():
    rng = np.random.default_rng(33)
    keys = np.sort(rng.integers(0, 40, 600))
    nodes = np.arange(600)
    prints = rng.integers(0, 1 << 63, 6, dtype=np.uint64)[rng.integers(0, 6, 600)]

    def run(size):
        import pyarrow as pa

        batches = [
            pa.RecordBatch.from_arrays([pa.array(keys[i: i + size]), pa.array(nodes[i: i + size]), pa.array(prints[i: i + size].view(np.int64))], ["key", "node", "print"])
            for i in range(0, 600, size)
        ]
        return sorted((a, b) for out in S._scan_lists(batches) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True))

    whole = run(600)
    assert whole and all(run(size) == whole for size in (1, 7, 64, 599))


def test_exact_check_decides(spark):
    """Of ten shingles that differ in one end, 8 of 10 is near and 7 of 10 is not."""
    words = [f"w{i}" for i in range(14)]
    rows = [(0, " ".join(words[:13])), (1, " ".join(words[1:14])), (2, " ".join(words[:12])), (3, " ".join(words[3:14]))]
    texts = spark.createDataFrame(rows, "node long, text string")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (0, 3)], "a long, b long")
    got = {(r.a, r.b) for r in S.verified(links, texts, 5, 0.8).collect()}
    assert got == {(a, b) for a, b in [(0, 1), (0, 2), (1, 2), (0, 3)] if similar(rows[a][1], rows[b][1])}
    assert (0, 1) in got and (0, 3) not in got


def test_refused_links_hide_no_pair(spark):
    """Texts of one base with up to five replaced words: near in every list, below and above the similarity."""
    rng = random.Random(34)
    base = prose(rng, 150)
    changed = [replaced(rng, base, 5) for _ in range(150)]
    texts = [" ".join(w) for w in changed] + [" ".join(replaced(rng, w, 2)) for w in changed]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    table = spark.createDataFrame([(i, t, None, "s", 0, "n", 1, "w") for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in S.keep_one_of_similar(table).collect()}
    firsts = {min(i for i, r in root.items() if r == g) for root in [classes(texts)] for g in set(root.values())}
    assert kept == firsts


def test_late_links_of_texts_below_the_similarity(spark):
    """Texts with three words of their own each meet in all shingles, yet no pair of them is searched for a link."""
    rng = random.Random(35)
    base = prose(rng, 150)
    texts = [" ".join(replaced(rng, base, 3)) for _ in range(120)]
    texts += [" ".join(replaced(rng, texts[i].split(), 1)) for i in range(5)]
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    grouped = spark.createDataFrame([(i, f"{i:016X}") for i in range(len(texts))], "node long, root string")
    tried = spark.createDataFrame([(i, i + 1) for i in range(len(texts) - 1)], "a long, b long")
    late = {(r.a, r.b) for r in S.late_links(table, grouped, tried, tried.limit(0), 5, 0.8).collect()}
    near = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if similar(texts[i], texts[j])}
    assert near - {(i, i + 1) for i in range(len(texts))} <= late
    assert len(late) <= 2 * len(texts)


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(36)
    hashes = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(hashes, n)) for n in (0, 1, 40, 300, 2500)]
    sketches = [S.set_sketch(s) for s in sets]
    for (x, a), (y, b) in itertools.product(zip(sets, sketches, strict=True), repeat=2):
        assert np.bitwise_count((a ^ b).view(np.uint64)).sum() <= len(np.setxor1d(x, y))
