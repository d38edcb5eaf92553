"""Chunked byte pairs, the prefix trie and spelling variants against brute force, with edge cases."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import public_tokenizers
from sitesift.llm import bpe_chunks, prefix_trie, spelling
from sitesift.llm.bpe_chunks import Encoder, cuts, decode_documents, encode_documents, vocabulary
from sitesift.llm.spelling import border_steps, document_words, roots, spelling_variants, trie_nodes

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, row string, seq int, chunk string, ids string, word string, n string"
EXTRA = ("xx", "row", 1, "chunk", "ids", "word", "n")
PARTS = [
    " ", "  ", "\n", "\n\n", "\t", "\r\n", "'re", "'r", "'", "'s", "it's", "we'll", " a", "the", " weather", "ß", "é",
    "日本語", "🙂", "123", " 42", "...", "<|endoftext|>", "<|endof", "text|>", "   x", " ", "　", "0", "_", " -", "\u0558", "\x1c", "\x85", "\u1680",
]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOCS)


def expected_ids(text):
    return vocabulary(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def joined(text, places):
    """Ids through the chunks between ``places``."""
    return Encoder(vocabulary(PATH)).document(text, [*(p for p in places if p < len(text)), len(text)]).tolist()


def test_joins_agree_with_the_library():
    rng = random.Random(3)
    for _ in range(2500):
        text = "".join(rng.choices(PARTS, k=rng.randint(1, 60)))
        places = sorted(rng.sample(range(1, len(text) + 1), min(len(text), rng.randint(1, 12))))
        assert joined(text, places) == expected_ids(text), (text, places)
    for unit in ("a", " ", "ab ", "\n", "é", "'", "1"):
        text = unit * 700
        assert joined(text, list(range(7, len(text), 13))) == expected_ids(text)


def test_encoder_classifies_characters_as_the_library():
    words = vocabulary(PATH)
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 7 == 0 or c > 0xF900)]
    for low in range(0, len(points), 500):
        text = "".join(f"a{chr(c)}1{chr(c)}-{chr(c)} {chr(c)}!\n" for c in points[low: low + 500])
        assert words.ids(text).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_chunks_are_encoded_once():
    encoder = Encoder(vocabulary(PATH))
    text = "".join(random.Random(6).choices("abcde fgh\n", k=20_000))
    for _ in range(5):
        encoder.document(text, cuts(text))
    assert encoder.encoded == len(set(cuts(text)))


def test_cuts_depend_on_content():
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefg hij", k=40_000))
    own = cuts(text)
    assert own[-1] == len(text) and all(b - a <= bpe_chunks.MOST_CHUNK for a, b in zip([0, *own], own))
    shifted = {p - 1000 for p in cuts("x" * 1000 + text)}
    assert len(shifted & set(own)) > 0.9 * len(own)
    assert cuts("") == [] and cuts("ab") == [2] and cuts("a" * 9000) == [4096, 8192, 9000]


def test_decoding_costs_little_beside_the_library():
    words, rng = vocabulary(PATH), random.Random(9)
    ids = [words.ids("".join(rng.choices("abcde fgh\n", k=40_000))) for _ in range(20)]
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
    whole = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), column], ["doc_id", "ids"])
    start = time.process_time()
    plain = [words.tokenizer.decode(i.tolist(), skip_special_tokens=False) for i in ids]
    library = time.process_time() - start
    start = time.process_time()
    parts = list(bpe_chunks.decoder(PATH)([whole.slice(0, 7), whole.slice(7)]))  # offsets that begin inside the values
    assert time.process_time() - start < 2 * library + 0.05
    assert [t for part in parts for t in part.column("decoded").to_pylist()] == plain


def test_documents_encode_as_whole_texts(spark):
    rng = random.Random(1)
    passage = "".join(rng.choices(PARTS[:-5], k=700))
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 900))) + (passage if i % 3 else "")) for i in range(60)]
    rows += [(None, None), (None, ""), (7, rows[7][1]), (7, rows[7][1]), (90, "a" * 300_000), (91, passage * 200), (92, "<|endoftext|>")]
    encoded = encode_documents(documents(spark, rows).repartition(5), PATH)
    got = [(r["doc_id"], list(r["ids"]), r["decoded"]) for r in decode_documents(encoded, PATH).collect()]
    want = [(i, expected_ids(t), t or "") for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert encode_documents(documents(spark, []), PATH).collect() == []


# --- prefix trie -----------------------------------------------------------------------


def brute_trie(rows):
    """rows of (conv_id, turn, role, text) with distinct turns."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[tuple(built[c][:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    return {
        (members[0], len(p)): (
            nodes[p[:-1]][0] if p else None, len(members), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in members if len(built[c]) == len(p)).encode()).hexdigest(),
        ) for p, members in nodes.items()
    }


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, path string, d int")
    got = prefix_trie.prefix_trie(frame).collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got}
    assert len(out) == len(got)
    return out


def test_trie_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in [*range(0, 60), *range(200, 215), *range(305, 330), -7, -101, -199]:  # 300 is absent
        for turn in range(rng.randint(1, 12)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["ok", "né", ""])))
    shared = [(t, "user", f"say {t}") for t in range(21)]  # copies longer than two blocks
    for c in (400, 417, 433, 499):
        rows += [(c, *t) for t in shared] + ([(c, 21, "user", "end")] if c % 2 else [])
    rows += [(500, t, "user", str(t)) for t in range(150)]  # alone and long
    rows += [(501, None, None, "first"), (501, 0, "user", None), (None, 0, "user", "lost"), (502, 5, "u", "\u0000:1")]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_edges(spark):
    assert trie_of(spark, []) == {} == trie_of(spark, [(None, 1, "user", "x")])
    one = [(300 + i, 0, "user", "x") for i in range(40)]
    one = [r for r in one if r[0] != 300]
    assert trie_of(spark, one) == brute_trie(one)  # some borrow from a conversation that is absent: turnless
    twice = [(5, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "assistant", "x")]
    assert sorted(d for _, d in trie_of(spark, twice)) == list(range(len(trie_of(spark, twice))))


# --- spelling ----------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = max(a, b, key=len), min(a, b, key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute_variants(counts):
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out, form = {}, {}
    for w, n in kept.items():
        others = sorted((v for v in kept if v != w and near(v, w)), key=lambda v: (-kept[v], v))
        form[w] = others[0] if others and kept[others[0]] >= 2 * n else None
        out[w] = (n, len(others))
    def root(w):
        return w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), n, k, kept[form[w]] if form[w] else None) for w, (n, k) in out.items()}


def variants_of(frame):
    rows = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abé", k=rng.randint(4, 8))): rng.choice([2, 3, 5, 6, 12, 30, 60]) for _ in range(500)}
    words |= {"a" * k: 3 * 2 ** (k % 7) for k in range(4, 30)}  # runs of one letter, chains of forms
    words |= {"x" * 3000: 4, "x" * 3001: 9, "x" * 1500 + "y" + "x" * 1500: 3}
    frame = spark.createDataFrame([(w, n, "i", 1) for w, n in words.items()] + [(None, 9, "i", 1)], "word string, n long, id string, part int")
    assert variants_of(spelling_variants(frame)) == brute_variants(words)
    assert spelling_variants(frame.limit(0)).collect() == []


def test_node_numbers_name_prefixes(spark):
    """Over many ranges, whose borders share prefixes, equal numbers are equal prefixes and no others."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(5, 12))) for _ in range(400)} | {"a" * k for k in range(5, 60)})
    frame = spark.createDataFrame([(i, w, 3) for i, w in enumerate(words)], "id long, word string, n long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = trie_nodes(frame).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    names = {}
    for r in got:
        w = words[r["id"]]
        for i in range(len(w) + 1):
            for key, number in ((("f", w[:i]), r["prefixes"][i]), (("r", w[len(w) - i:]), r["suffixes"][i])):
                assert names.setdefault(key, number) == number
        assert list(r["fresh"]) == [i == 0 or w[i] != w[i - 1] for i in range(len(w))]
    assert len(got) == len(words) and len(set(names.values())) == len(names)


def test_border_owners():
    assert border_steps([(1, 0, 2), (2, 1, 5), (3, 3, 9), (4, 2, 0)]) == {
        1: [], 2: [(1, 2)], 3: [(1, 2), (3, 3)], 4: [(1, 2), (2, 3)]}
    assert spelling.shared("ab", "abc") == 2 and spelling.shared("", "x") == 0 and spelling.shared("abd", "abc") == 2


def test_words_of_documents(spark):
    rows = [(1, "Émile été ÉTÉ x1y ABCdef"), (None, "hello World hello"), (2, None), (3, ""), (None, None), (1, "Émile")]
    rows += [(i, f"naïve {i} receive recieve\nreceive ÿÀ×÷") for i in range(4, 300)]
    want = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    counted = document_words(documents(spark, rows))
    assert {r["word"]: r["n"] for r in counted.collect()} == dict(want)
    assert variants_of(spelling_variants(counted)) == brute_variants(want)


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(62)] + [(100 + i, 3) for i in range(300)], "id long, form long")
    assert {r["root"] for r in roots(chain).collect()} == {62}
    assert list(itertools.islice(roots(chain.limit(0)).collect(), 1)) == []
