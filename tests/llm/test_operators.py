"""Corpus operators against brute force, round trips and edge cases, on small tables."""

import gzip
import hashlib
import io
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from sitesift.llm import chat, decontaminate, pii
from sitesift.llm.decontaminate import find_leaks, without_leaks
from sitesift.llm.host_rules import host_rules
from sitesift.llm.kd_shards import kd_shards
from sitesift.llm.language import fit_language_models, identify_languages, keep_identified, score_texts
from sitesift.llm.pfair import earliest_deadline_first, exact_weights, pfair_mix, write_plan
from sitesift.llm.quality import quality_scores
from sitesift.llm.simhash import fingerprint, index_triples, keep_one_of_each, links_in_run, simhash_components
from sitesift.llm.warc import archive_pages, inflated
from sitesift.session import write_and_read

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, _n int, fp string"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source), with further columns whose names clash with working ones."""
    return spark.createDataFrame([(*r, 0, "node", 1, "fp") for r in rows], SCHEMA)


def words(rng, n, syllables="ba be bi bo bu da de di do du ka ke ki".split()):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a source of a third of the rows."""
    rng = random.Random(5)
    rows = [(i, words(rng, 60), "xx", "hot" if i % 3 else f"s{i % 7}") for i in range(60)]
    rows += [(None, None, None, None), (None, "", "xx", None), (70, None, "xx", "s1"), (71, " \n\t", None, ""),
             (72, words(rng, 30000), "xx", "s2"), (73, "12 34 !!", "xx", "s3"), (0, rows[0][1], "xx", rows[0][3]),
             (0, rows[0][1], "xx", rows[0][3])]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def hamming_classes(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= 4:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


def naive_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    width = min(4, len(ws))
    hashes = [xxhash.xxh64_intdigest(b" ".join(ws[i: i + width]), 42) for i in range(len(ws) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_triples_hit_every_four_positions():
    triples = [set(t) for t in index_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in itertools.combinations(range(8), 4))


def test_links_connect_what_brute_force_connects():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(3)]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) for b in base for _ in range(60)})
    left, right = links_in_run(np.array(prints, np.uint64))
    want = hamming_classes(prints)
    got = {p: p for p in prints}
    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        assert (a ^ b).bit_count() <= 4
        old, new = got[a], got[b]
        got = {k: new if v == old else v for k, v in got.items()}
    assert len(set(got.values())) == len(set(want.values()))


def test_simhash_components(spark, odd, none):
    rng = random.Random(2)
    texts = [words(rng, 80) for _ in range(12)]
    rows = [(i, t, "xx", "s") for i, t in enumerate(texts)]
    rows += [(100 + i, t + (" tail" if i % 2 else ""), "xx", "s") for i, t in enumerate(texts)]
    table = documents(spark, rows).unionByName(odd)
    got = simhash_components(table).collect()
    kept = [(r.doc_id, naive_fingerprint(r.text)) for r in table.collect()]
    classes = hamming_classes({p for _, p in kept})
    low = {}
    for doc_id, p in kept:
        if doc_id is not None:
            low[classes[p]] = min(low.get(classes[p], doc_id), doc_id)
    want = sorted(((d, f"{p:016x}", low.get(classes[p])) for d, p in kept), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    one = keep_one_of_each(table)
    assert one.columns == table.columns
    assert one.count() == len(set(classes.values()))
    assert simhash_components(none).count() == 0 and keep_one_of_each(none).count() == 0
    assert fingerprint(b"") == 0


def test_archive_round_trip(spark):
    big = "é" * 300
    rows = [(3, "http://a/\r\nX: y", big), (1, None, big), (2, "u", big), (4, "u", None), (5, "u", ""), (6, "u", "ab"),
            (7, "u", "ab"), (None, "u", "x\r\n\r\ny"), (1, "u", big), (8, "u", "z" * 3_000_000)]
    got = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        page = next((h or "").encode() for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(page) and r.payload_digest == hashlib.sha256(page).hexdigest()
        assert r.refers_to == (1 if r.page_id in (2, 3) else None)
        assert r.record_type == ("revisit" if r.page_id in (2, 3) else "response")
        assert bytes(r.payload) == (b"" if r.refers_to else page)
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_leaks_by_brute_force(spark, odd, none):
    rng = random.Random(3)
    items = [words(rng, n) for n in (40, 13, 9, 8, 5)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, ""), (11, items[0])],
                                  "item_id long, text string")
    changed = items[0].split()
    for at in (5, 16, 27):
        changed[at] = "other"
    leaky = [(200 + i, f"{words(rng, 30)} {t.upper()}, {words(rng, 30)}", "xx", "s") for i, t in enumerate(items)]
    leaky += [(210, " ".join(changed), "xx", "s"), (211, " ".join(items[0].split()[:13]), "xx", "s"),
              (212, " ".join(items[0].split()[:6]), "xx", "s")]
    table = documents(spark, leaky).unionByName(odd)
    leaks = {(r.doc_id, tuple(r.ids)) for r in find_leaks(table, bench).collect()}
    assert leaks == {(200, (0, 11)), (201, (1,)), (202, (2,)), (203, (3,)), (204, (4,)), (210, (0, 11)), (211, (0, 11))}
    rest = without_leaks(table, bench)
    assert rest.columns == table.columns and rest.count() == table.count() - 7
    assert find_leaks(none, bench).count() == 0
    assert without_leaks(table, bench.limit(0)).count() == table.count()


def test_cut_archives_fail():
    """Whole files of one or more members inflate; cut anywhere inside a member, even between records, they fail."""
    plain = b"".join(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" for _ in range(50))
    parts = [gzip.compress(plain), gzip.compress(plain[:100])]
    for size in (7, 64, 1 << 16):
        assert b"".join(inflated(io.BytesIO(b"".join(parts)), size)) == plain + plain[:100]
    assert b"".join(inflated(io.BytesIO(b""))) == b""
    flushed = zlib.compressobj(wbits=31)
    between_records = flushed.compress(plain) + flushed.flush(zlib.Z_FULL_FLUSH)
    for cut in [between_records, *(parts[0][:n] for n in range(1, len(parts[0]), 5)), parts[0] + parts[1][:-1]]:
        with pytest.raises(ValueError, match="inside a gzip member"):
            list(inflated(io.BytesIO(cut)))


def test_short_items_stand_whole(spark):
    rng = random.Random(8)
    letters = "a b c d".split()
    items = {i: [rng.choice(letters) for _ in range(1 + i % 7)] for i in range(30)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, " .,")], "item_id long, text string")
    texts = {d: [rng.choice(letters) for _ in range(rng.randrange(12))] for d in range(60)}
    table = documents(spark, [(d, " ".join(t), "xx", "s") for d, t in texts.items()] + [(99, None, "xx", "s")])
    want = {
        (d, i, min(starts), len(starts)) for d, t in texts.items() for i, w in items.items()
        if (starts := [at for at in range(len(t) - len(w) + 1) if t[at: at + len(w)] == w])
    }
    got = {(r.doc_id, i, r.first_word, r.seeds) for r in find_leaks(table, bench).collect() for i in r.ids}
    assert got == want and len(want) > 100


def in_place(item, text):
    """Most words in place of a stretch of 13 words (or the whole item) laid anywhere on the text."""
    length = min(13, len(item))
    return max(
        sum(0 <= d + k < len(text) and item[s + k] == text[d + k] for k in range(length))
        for s in range(len(item) - length + 1) for d in range(1 - length, len(text))
    )


def test_every_pair_of_replaced_words_is_found(spark):
    items = {i: [f"i{i}w{k}" for k in range(n)] for i, n in enumerate((8, 9, 10, 11, 12, 13, 40))}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    texts, alone = {}, ["x1 x2 x3".split(), []]
    for i, item in items.items():
        for start in (0, 14, 27) if len(item) == 40 else (0,):
            part = item[start: start + 13]
            for pair in itertools.combinations_with_replacement(range(len(part)), 2):
                changed = [f"other{k}" if k in pair else w for k, w in enumerate(part)]
                texts[len(texts)] = (i, alone[len(texts) % 2] + changed + alone[len(texts) % 2])
    texts[len(texts)] = (5, items[5][2:])  # cut at either end of a document
    texts[len(texts)] = (5, items[5][:11])
    texts[len(texts)] = (5, items[5][:10])
    want = {(d, i) for d, (i, text) in texts.items()
            if in_place(items[i], text) >= -(-min(13, len(items[i])) * 4 // 5)}
    assert len(want) > 500
    table = documents(spark, [(d, " ".join(text), "xx", "s") for d, (_, text) in texts.items()])
    got = find_leaks(table, bench).collect()
    assert {(r.doc_id, i) for r in got for i in r.ids} == want
    assert all(r.matched == in_place(items[r.ids[0]], texts[r.doc_id][1]) for r in got)


def test_broadcasts_do_not_grow_with_the_benchmark(spark, monkeypatch):
    """Blocks of the benchmark run one after the other; joined by broadcast or by shuffle, leaks are the same."""
    rng = random.Random(21)
    items = [words(rng, n) for n in (40, 20, 13, 9, 5, 2) * 4]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = [f"{words(rng, 20)} {' '.join(t.split()[:17])} {words(rng, 5)}" for t in items]
    table = documents(spark, [(i, t, "xx", "s") for i, t in enumerate(texts)])
    want = sorted(find_leaks(table, bench).collect())
    assert {i for r in want for i in r.ids} == set(range(len(items)))
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 50)
    monkeypatch.setattr(decontaminate, "SIEVE_SEEDS", 150, raising=False)
    leaks = find_leaks(table, bench)
    assert sorted(leaks.collect()) == want
    assert leaks._jdf.queryExecution().executedPlan().toString().count("Broadcast") == 0


def test_stage_holds_one_block_of_the_benchmark_at_once(spark, monkeypatch, tmp_path):
    rng = random.Random(22)
    items = [words(rng, 30) for _ in range(12)]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = documents(spark, [(i, t if i < 12 else words(rng, 30), "xx", "s") for i, t in enumerate(items * 2)])
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 60)
    monkeypatch.setattr(decontaminate, "SIEVE_SEEDS", 60, raising=False)
    write, broadcasts = decontaminate.write_and_read, []

    def record(frame, purpose):
        broadcasts.append(frame._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast"))
        return write(frame, purpose)

    monkeypatch.setattr(decontaminate, "write_and_read", record)
    rest = corpus_pipeline.keep_unleaked(spark, table, str(tmp_path))
    assert sorted(r.doc_id for r in rest.collect()) == list(range(12, 24))
    assert 1 <= max(broadcasts) <= 4


def test_kd_shards(spark, odd, none):
    rng = random.Random(4)
    table = documents(spark, [(i, words(rng, rng.randint(5, 60)), rng.choice("ab"), "hot" if i % 3 else f"s{i}")
                              for i in range(500)])
    rows = kd_shards(table, 7).collect()
    assert len(rows) == 500
    total = [0] * 7
    for r in rows:
        assert r.size == len(r.text.encode()) + 16 and r.text_crc32 == zlib.crc32(r.text.encode())
        total[r.shard] += r.size
    assert max(total) - min(total) <= 3 * max(r.size for r in rows)
    for shard in range(7):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    again = kd_shards(odd, target_bytes=5_000)
    assert again.count() == odd.count() and set(odd.columns) < set(again.columns)
    assert kd_shards(none, 7).count() == 0


def test_mixing_takes_effect_in_shards(spark, tmp_path):
    rng = random.Random(14)
    table = documents(spark, [(i, words(rng, 20), "xx", "a" if i % 5 else f"s{i % 7}") for i in range(1500)])
    table.repartition(8).write.parquet(f"{tmp_path}/in")
    table = spark.read.parquet(f"{tmp_path}/in")
    seq = {r.doc_id: r.seq for r in pfair_mix(table).collect()}
    mixed = write_and_read(corpus_pipeline.mix_sources(spark, table, ""), "mixed")
    rows = corpus_pipeline.cut_shards(spark, mixed, "").collect()
    without = corpus_pipeline.cut_shards(spark, table, "").collect()
    assert len(rows) == 1500 and set(rows[0].asDict()) == {*table.columns, "size", "text_crc32", "shard", "slot"}
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, {})[r.slot] = seq[r.doc_id]
    for slots in shards.values():
        assert sorted(slots) == list(range(len(slots)))
        in_order = [slots[i] for i in range(len(slots))]
        assert in_order == sorted(in_order)
    assert {(r.doc_id, r.shard) for r in rows} == {(r.doc_id, r.shard) for r in without}
    assert {(r.doc_id, r.slot) for r in rows} != {(r.doc_id, r.slot) for r in without}


def test_pfair_deviation(spark, odd, none):
    rows = [(i, str(i), "xx", s) for s, n in (("a", 300), ("b", 200), (None, 100)) for i in range(n)]
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), (None, 2.0)], "source string, weight double")
    out = pfair_mix(documents(spark, rows), weights, block_rows=4, cycle=10).collect()
    assert len(out) == len(rows) and len({r.seq for r in out}) == len(rows)
    blocks = sorted({(r.slot, r.source, r.release, r.deadline) for r in out}, key=lambda b: b[0])
    assert all(release <= slot < deadline for slot, _, release, deadline in blocks)
    served = {"a": 0, "b": 0, None: 0}
    share = {"a": 0.5, "b": 0.3, None: 0.2}
    for slot, source, _, _ in blocks:
        if slot > 120:
            break
        served[source] += 1
        assert all(abs(served[s] - share[s] * (slot + 1)) < 1 for s in served)
    assert pfair_mix(odd).count() == odd.count() and pfair_mix(none).count() == 0


def test_pfair_keeps_to_unrounded_weights(spark):
    weights = [2 ** 0.5, 3 ** 0.5, 0.0001, 7.0, 0.3]
    shares = [w / sum(weights) for w in weights]
    served = [0] * 5
    for i, block, release, deadline, slot in earliest_deadline_first(exact_weights(weights), [10 ** 6] * 5):
        assert block == served[i] and release <= slot < deadline
        served[i] += 1
        assert all(abs(n - a * (slot + 1)) < 1 + 1e-9 for n, a in zip(served, shares, strict=True))
        if slot == 40_000:
            break
    assert exact_weights([None, 3.0, 0.0, 0.5]) == [1, 6, 1, 1]
    rows = [(i, str(i), "xx", f"s{i % 300}") for i in range(3000)]  # more sources than the 256 of before
    out = pfair_mix(documents(spark, rows), block_rows=2).collect()
    assert len(out) == 3000 == len({r.seq for r in out})
    assert all(r.release <= r.slot < r.deadline for r in out)
    sources = spark.createDataFrame([("a", 2.0, 30), ("b", 1.0, 20)], "key string, weight double, blocks long")
    assert sorted(write_plan(sources, 7).collect()) == sorted(write_plan(sources).collect())


def test_language_and_rejection(spark, odd, none):
    rng = random.Random(6)
    tongues = {"aa": "ba be bi lo lu ma".split(), "bb": "sch ung ein ich tz ver".split(), "cc": "ció mente ado ue os".split()}
    rows = [(i, words(rng, 40, tongues[t]), t, "s") for i, t in enumerate(sorted(tongues) * 60)]
    noise = "".join(rng.choices("qxzwvjkfghpyt", k=400))
    table = documents(spark, rows + [(900, noise, None, "s"), (901, "1 2 3", "aa", "s"), (902, None, None, None)])
    got = {r.doc_id: r for r in identify_languages(table).collect()}
    assert all(got[i].lang_pred == t and not got[i].rejected for i, _, t, _ in rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert got[900].rejected and got[901].lang_pred == got[902].lang_pred == "und" and got[901].score == 0
    kept = keep_identified(table)
    assert kept.columns == table.columns and kept.count() == len(rows)
    assert identify_languages(odd).count() == odd.count() and identify_languages(none).count() == 0


def test_large_script_does_not_loosen_rejection(spark):
    rng = random.Random(15)
    rows = [(i, words(rng, 60), "xx", "s") for i in range(80)]
    script = [chr(c) for c in range(0x4E00, 0x4E00 + 4000)]
    rows += [(100 + i, "".join(rng.choices(script[:40], k=150)) + "".join(rng.choices(script, k=60)), "zz", "s")
             for i in range(80)]
    noise = [(900 + i, "".join(rng.choices("qxzwvjfghpyt", k=400)), None, "s") for i in range(3)]
    noise += [(910 + i, "".join(rng.choices("badekiou ", k=400)), None, "s") for i in range(3)]
    got = {r.doc_id: r for r in identify_languages(documents(spark, rows + noise)).collect()}
    assert all(got[i].rejected for i, *_ in noise)
    assert not any(got[i].rejected or got[i].lang_pred != "xx" for i in range(80))


def naive_kneser_ney(texts, lang, text):
    """Entropy per letter from all sequences of all texts, by the textbook."""
    counts = {}
    for name, other in texts:
        for i in range(len(other)):
            gram = ("   " + other)[i: i + 4]
            counts[name, gram] = counts.get((name, gram), 0) + 1
    size = len({g[-1] for _, g in counts} | {" "}) + 1
    levels = [{g: n for (name, g), n in counts.items() if name == lang}]
    for _ in range(3):
        lower = {}
        for g in levels[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        levels.insert(0, lower)

    def probability(gram):
        if not gram:
            return 1 / size
        level = levels[len(gram) - 1]
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.75
        after = [n for g, n in level.items() if g[:-1] == gram[:-1]]
        if not after:
            return probability(gram[1:])
        return (max(level.get(gram, 0) - discount, 0) + discount * len(after) * probability(gram[1:])) / sum(after)

    return -sum(np.log(probability(("   " + text)[i: i + 4])) for i in range(len(text))) / len(text)


def test_language_model_keeps_every_sequence(spark):
    rng = random.Random(13)
    langs = [f"l{i:03}" for i in range(300)]  # the cap was 100 sequences a language here
    letters = "abcdefghijklmnopqrstuvwxyzéßあ漢"
    texts = [(lang, "".join(rng.choices(letters, k=150))) for lang in langs]
    table = spark.createDataFrame(texts, "lang string, text string")
    probes = [texts[0][1][40:90], "".join(rng.choices(letters, k=50))]
    whole = fit_language_models(table)
    blocks = fit_language_models(table, model_cells=3_000_000)
    assert len(whole.blocks) < len(blocks.blocks)
    got, counts = score_texts(whole, probes)
    assert list(counts) == [50, 50] and np.allclose(score_texts(blocks, probes)[0], got, atol=1e-5)
    for lang in ("l000", "l001"):
        want = [naive_kneser_ney(texts, lang, p) for p in probes]
        assert np.allclose(got[:, langs.index(lang)], want, atol=1e-4)


def test_base_spans_are_the_patterns():
    text = "a.b@c.de, 300.1.1.1 10.0.0.1.5 y 4539 1488 0343 6467 x +1 (663) 555-6869 @x a@b"
    got = [(k, text[a:b]) for k, a, b in pii.base_spans(text)]
    assert got == [("email", "a.b@c.de"), ("ip", "10.0.0.1"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (663) 555-6869")]
    rng = random.Random(8)
    for _ in range(300):
        hay = "".join(rng.choices("ab1.@- +", k=60))
        want = [m.span() for m in pii.PATTERNS["email"].finditer(hay)]
        assert [m.span() for m in pii._emails(hay)] == want


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    steps, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    runs = [rng.normal(size=(n, 3)) for n in (1, 4, 6, 2)]
    for emissions, path in zip(runs, pii.viterbi(runs, steps, first), strict=True):
        def score(p, e=emissions):
            return first[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=len(emissions)), key=score)
        assert tuple(path) == best


def test_personal_data(spark, odd, none):
    rng = random.Random(9)

    def phone():
        return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"

    rows = [(i, f"{words(rng, 8)} {phone()} {words(rng, 8)} u{i}@mail.example.com {i} {words(rng, 3)}", "xx", "s") for i in range(120)]
    rows.append((500, f"{words(rng, 8)} (663) 555-6869 {words(rng, 8)}", "xx", "s"))
    got = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert all([s.kind for s in got[i] if s.base] == ["email", "phone"] for i in range(120))
    assert [(s.kind, rows[-1][1][s.start: s.end], s.base) for s in got[500]] == [("phone", "(663) 555-6869", False)]
    assert pii.find_personal_data(odd).count() == odd.count() and pii.find_personal_data(none).count() == 0


def test_labelled_runs_are_distinct(spark):
    rows = [(i, f"call +1 (663) 555-{1000 + i} now or room {i} there", "xx", "s") for i in range(30)]
    rows += [(1000 + i, "same +1 (663) 555-9999 text or item 77 again", "xx", "s") for i in range(2000)]
    runs = pii.labelled_runs(documents(spark, rows).select("doc_id", "text"), 100)
    assert len(runs) == len({(tuple(w), tuple(m)) for w, m in runs}) > 31


def test_host_rules(spark, odd, none):
    rng = random.Random(10)
    good = [(i, words(rng, 70), "xx", "good") for i in range(40)]
    bad = [(100 + i, "one two three four " * 30 if i else words(rng, 70), "xx", "bad") for i in range(40)]
    got = {r.doc_id: r for r in host_rules(documents(spark, good + bad)).collect()}
    assert all(got[i].kept for i in range(40)) and not any(got[100 + i].kept for i in range(40))
    assert not got[100].base_failed and got[101].n_repeat_words == got[101].n_words == 120
    assert host_rules(odd).count() == odd.count() and host_rules(none).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "###", "\\###", "####", "</turn>", "a\\</turn>\n### user: b", "</turn",
                                  "\\### Assistant: </turn> ok", "x" * 300_000])
def test_chat_round_trip(text):
    turns = [("user", text), ("assi: stant\n", text), ("", text), ("assistant", text)]
    formatted, loss, _ = chat.format_turns(turns)
    assert [t[:2] for t in chat.parse(formatted)] == turns
    assert [chat.unescape(formatted[s["start"]: s["end"]]) for s in loss] == [text]


def test_chat_random_texts_and_nulls(spark):
    rng = random.Random(11)
    for _ in range(500):
        text = "".join(rng.choices(["\\", "###", "</turn>", "#", "<", "\n", "a", ": "], k=8))
        assert [t[:2] for t in chat.parse(chat.format_turns([("user", text)])[0])] == [("user", text)]
    rows = [(1, 1, "assistant", None, "x"), (1, 0, None, "q", "x"), (None, None, "user", "z", "x"), (2, 0, "user", "z", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.format_conversations(table).collect()}
    assert set(got) == {1, 2, None} and [t[:2] for t in chat.parse(got[1].formatted)] == [("", "q"), ("assistant", "")]
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_quality(spark, odd, none):
    rng = random.Random(12)
    rows = [(i, words(rng, 50) if i % 3 else words(rng, 50).upper().replace(" ", "!! "), "xx", "s") for i in range(300)]
    marks = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(1, None, 0), (None, 1, 0), (9999, 0, 0)],
                                  "doc_id long, quality int, toxic int")
    got = quality_scores(documents(spark, rows), marks).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 300 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert quality_scores(odd, marks).count() == odd.count() and quality_scores(none, marks).count() == 0
    assert quality_scores(odd, marks.limit(0)).select("score").distinct().count() >= 1


def test_long_digit_runs(spark):
    """Parts of any number of zeros, and a table of numbers among short runs."""
    zeros = "0" * 5000 + "1.1.1." + "0" * 9000 + "255 and 1.1.1." + "0" * 4400 + "256"
    assert [s[0] for s in pii.base_spans(zeros)] == ["ip"]
    rows = [(1, zeros, "xx", "s"), (2, " ".join(["12345"] * 200_000), "xx", "s")]
    rows += [(10 + i, f"call +1 555 010 {1000 + i} or mail a{i}@b.org 4111 1111 1111 1111", "xx", "s") for i in range(600)]
    found = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, rows)).collect()}
    assert len(found) == 602
    assert [s["kind"] for s in found[1]] == ["ip"]
    assert {"email", "card", "phone"} <= {s["kind"] for s in found[10]}


def test_viterbi_in_small_batches(monkeypatch):
    rng = np.random.default_rng(3)
    runs = [rng.normal(size=(n, 3)) for n in (1, 40, 2, 7, 300, 5, 5, 1)]
    steps, first = rng.normal(size=(3, 3)), rng.normal(size=3)
    whole = [p.tolist() for p in pii.viterbi(runs, steps, first)]
    monkeypatch.setattr(pii, "DECODED_WORDS", 12)
    assert [p.tolist() for p in pii.viterbi(runs, steps, first)] == whole


def test_equal_rows_are_shared_out(spark):
    """Rows equal in everything fill all shards: bytes within one row of the mean, half a percent more."""
    rows = [(7, "the same text", "xx", "s")] * 4000
    placed = kd_shards(documents(spark, rows), 8).collect()
    counts = [sum(r["shard"] == k for r in placed) for k in range(8)]
    assert sum(counts) == 4000 and max(counts) - min(counts) <= 10
    for k in range(8):
        assert sorted(r["slot"] for r in placed if r["shard"] == k) == list(range(counts[k]))


def piece_texts():
    rng = random.Random(12)
    texts = [words(rng, 400), "x" * 3000, "", None, "日本語" * 500, " \n ".join("ab1 c" for _ in range(300)), "a\t" * 900]
    texts += ["".join(rng.choices("abcé ñ1.,\n  ", k=rng.randint(1, 2500))) for _ in range(30)]
    return [*texts, "abc" + " ." * 700 + "def ghi", " " * 2000 + "tail"]


def test_long_texts_are_counted_as_whole(monkeypatch):
    """Cut into parts of any size, a text has the words, n-grams and letters that it has in one."""
    from collections import Counter

    from sitesift.llm import batches, language, quality

    def counted(texts):
        grams, marks = Counter(), Counter()
        for part in batches.pieces(texts, before=language.context):
            values, positions, owner = language.padded(*part)
            for at, text in zip(positions.tolist(), owner.tolist(), strict=True):
                grams[text, *values[at - language.ORDER + 1: at + 1].tolist()] += 1
        for part in batches.pieces(texts, after=max(quality.GRAMS) - 1, at_space=True):
            for kind, (buckets, owner) in enumerate(quality.features(*part)):
                marks.update(zip([kind] * len(owner), owner.tolist(), buckets.tolist(), strict=True))
        return grams, marks

    texts = piece_texts()
    whole = counted(texts)
    assert sum(whole[0].values()) > 10_000 and sum(whole[1].values()) > 50_000
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(batches, "PIECE", size)
        assert counted(texts) == whole, size


def test_words_and_grams_by_brute_force():
    from collections import Counter

    from sitesift.llm import batches, quality

    def alone(text, kind):
        """The bucket of an n-gram or a word that is a whole text."""
        part = next(batches.pieces([text], size=1 << 20))
        return int(list(quality.features(*part))[kind][0][0])

    for text in filter(None, piece_texts()[:12]):
        found = [Counter(b.tolist()) for b, _ in quality.features(*next(batches.pieces([text], size=1 << 20)))]
        kinds = [Counter(text[i: i + n] for i in range(len(text) - n + 1)) for n in quality.GRAMS]
        kinds.append(Counter(re.findall(r"[^ \t-\r]+", text)))
        for kind, (got, want) in enumerate(zip([*found, Counter()], kinds, strict=False)):
            buckets = Counter()
            for unit, count in want.items():
                buckets[alone(unit, kind)] += count
            assert got == buckets
