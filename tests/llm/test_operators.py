import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from conftest import corpus, frame, prose
from helixframe.llm import chat, decontamination, jaccard, langid, lattice, lz_dedup, packing, suffix_dedup, tokenfile, webp
from helixframe.llm.tokens import WordTokenizer, public_path

BYTE, WORD, PIECE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def collected(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# ---- tokens


def library(name):
    """A fresh tokenizer, untouched by the code under test."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(name))


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_word_cache_equals_the_library(name, rows):
    t, fresh = WordTokenizer(public_path(name), remember=50), library(name)
    hard = ["", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\n", "a\tb", "x\r\ny", "İstanbul ΣΑΣ Σ", "é ́x", "a b c", "a\x1cb c", "<|endoftext|> a", "don't  'S we'LL", "ﬁne Ǆ 漢字 12 3!!"]
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "a", "The", " ", " ", "\n", "İ", "é", "x-1", "<", "|>"]
    hard += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for text in hard + [t for _, t in rows if t]:
        assert np.frombuffer(t.encode(text), t.type).tolist() == fresh.encode(text, add_special_tokens=False).ids, text[:40]


SPECIAL = [(9001, "one <|endoftext|> two"), (9002, "<|startoftext|>x<|endoftext|>"), (9003, "<|endoftext|>")]


def truth(rows, name):
    t = library(name)
    return [(i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for i, x in rows]


def test_texts_that_hold_special_tokens(spark):
    made = frame(spark, SPECIAL)
    want = sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in truth(SPECIAL, BYTE))
    assert collected(tokenfile.op5_token_file(made, public_path(BYTE)), "doc_id", "n_tokens", "ids_crc32") == want
    want = sorted((i, len(x), zlib.crc32(x.tobytes())) for i, x in truth(SPECIAL, WORD))
    assert collected(packing.op2_packing(made, public_path(WORD)), "doc_id", "doc_tokens", "ids_crc32") == want


def test_token_file_round_trip(spark, docs, rows, none, tmp_path):
    want, at = [], 0
    for i, ids in sorted(truth(rows, BYTE), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = tokenfile.op5_token_file(docs, public_path(BYTE))
    assert collected(got, "doc_id", "n_tokens", "ids_crc32") == sorted(want, key=str)
    spans = sorted((r["start"], r["n_tokens"]) for r in got.collect())
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans[:-1], spans[1:], strict=True)) and sum(spans[-1]) == at
    ordered = [r["doc_id"] for r in got.orderBy("start").collect()]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))
    assert tokenfile.op5_token_file(none, public_path(BYTE)).collect() == []


def test_token_file_random_access(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(prose(rng, rng.choice([0, 1, 7, 60, 900])))) for k in range(60)]
    folder = f"file://{tmp_path}/t"
    shards = tokenfile.write_tokens(frame(spark, rows), public_path(BYTE), folder, length=64, rows=3, shards=2)
    want, base = np.concatenate([x for _, x in truth(rows, BYTE)]), 0
    assert len(shards) == 2 and sum(n for _, n, _ in shards) == len(rows)
    for name, _, ids in shards:
        f = tokenfile.TokenFile(folder, name)
        assert f.reader.num_record_batches > 20 and len(f) == -(-ids // 64)  # documents longer than a batch among them
        for k in rng.sample(range(len(f)), len(f)):
            part = want[base + 64 * k : min(base + 64 * (k + 1), base + ids)]
            assert f.sequence(k)[: len(part)].tolist() == part.tolist() and not f.sequence(k).flags.owndata
            assert f.mask(k).tolist() == [j < len(part) for j in range(64)]
        with pytest.raises(IndexError):
            f.sequence(len(f))
        base += ids
    assert base == len(want)


def test_a_failed_shard_leaves_nothing(tmp_path):
    store, root = tokenfile.open_folder(f"file://{tmp_path}/x")
    shard = tokenfile._Shard(store, root, "shard-0", np.dtype("<u2"), 8, 2)
    shard.add(1, np.arange(100, dtype="<u2"))
    shard.drop()
    assert list((tmp_path / "x").iterdir()) == []


def test_packing_covers_every_token_once(docs, rows, none):
    known = Counter((i, zlib.crc32(x.tobytes())) for i, x in truth(rows, WORD))
    by_doc, filled = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, public_path(WORD), capacity=256, block_tokens=4000, with_ids=True).collect():
        assert len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"]
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    unique = {(i, len(x)): x for i, x in truth(rows, WORD)}
    for key, parts in by_doc.items():
        copies = sum(n for (i, _), n in known.items() if i == key[0])
        if copies == 1:
            parts.sort()
            assert [t for _, ids in parts for t in ids] == unique[key].tolist()
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
    assert sum(n for p in filled.values() for _, n in p) == sum(len(x) for _, x in truth(rows, WORD))
    assert packing.op2_packing(none, public_path(WORD)).collect() == []


def test_blocks_are_full_and_balanced():
    rng = random.Random(0)
    lengths = [rng.choice([0, 1, 5, 60, 100, 350, 1000]) for _ in range(300)]
    placed, costs = packing.pack_block(lengths, 256)
    assert len(costs) - -(-sum(lengths) // 256) <= 1
    rest = [c for c, full in zip(costs, np.bincount([x[3] for x in placed if x[2] == 256], minlength=len(costs)), strict=True) if not full]
    assert np.std(rest) / np.mean(rest) < 0.25
    assert packing.pack_block([], 8) == ([], [])


# ---- language


def test_code_lengths_equal_a_direct_coder():
    samples = {"a": [b"abracadabra", b"abba cad"], "b": [b"xyzzy abra", b"\xc3\xa9t\xc3\xa9"]}
    model = langid.PPM.fit(samples, max_order=3)

    def direct(lang, data):
        follow = defaultdict(Counter)
        for text in samples[lang]:
            for p in range(len(text)):
                for order in range(min(p, 3) + 1):
                    follow[text[p - order : p]][text[p]] += 1
        bits = 0.0
        for p in range(len(data)):
            for order in range(min(p, 3), -1, -1):
                seen = follow.get(data[p - order : p]) if order or True else None
                if not seen:
                    continue
                n, q = sum(seen.values()), len(seen)
                if data[p] in seen:
                    bits -= math.log2(seen[data[p]] / (n + q))
                    break
                bits -= math.log2(q / (n + q))
            else:
                bits += 8
        return bits

    texts = [b"abracad", b"zzz", b"", b"\x00\xff abc", "été".encode(), b"a"]
    offsets = np.cumsum([0, *map(len, texts)])
    got = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert np.allclose(got, [[direct(name, t) for name in "ab"] for t in texts])


def test_language_id(spark, docs, rows, none):
    got = langid.op1_language_id(docs)
    assert got.count() == len(rows)
    by = {r["doc_id"]: r for r in got.collect()}
    letterless = {i for i, t in rows if not any(c.isalpha() for c in t or "")}
    assert all((by[i]["lang_pred"] == "und") == (i in letterless) for i in by if i is not None and sum(j == i for j, _ in rows) == 1)
    assert all(0 <= r["score"] <= 1 for r in by.values())
    assert all(r["held_out"] == brute.held_out(i, 4) for i, r in by.items())
    assert langid.op1_language_id(none).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r[0] for r in langid.op1_language_id(unlabelled).select("lang_pred").collect()} == {"und"}


def test_held_out_accuracy(spark):
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.op1_language_id(data).join(data.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.97 * got.count()


def test_rare_bytes_and_short_texts_are_accepted(spark):
    import corpus_pipeline

    learned = [(k, t, lang) for k, (t, lang) in enumerate([("der hund und die katze sind im haus", "de"), ("the dog and the cat are in the house", "en")] * 20)]
    odd = ["DIE KATZE IST IM HAUS", "Q7-4711 0815 99 x", "OK", "GPU", "N/A", "mail@host.example:8080", "ÄÖÜ"]
    rows = [*learned, *((100 + k, t, "de") for k, t in enumerate(odd)), (200, "12 34 !", "de"), (201, None, "de")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.PPM.fit({lang: [t.encode() for _, t, other in learned if other == lang] for lang in ("de", "en")})
    got = {r["doc_id"]: r for r in langid.identify(made, model).collect()}
    assert all(got[100 + k]["bits_per_byte"] > 8 and got[100 + k]["accepted"] for k in range(len(odd)))
    assert not got[200]["accepted"] and not got[201]["accepted"]
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, made, "").collect()}
    assert kept == {r[0] for r in rows} - {200, 201}


def test_training_rows_have_letters_and_long_texts_leave_room(spark):
    texts = [None, "", "12 34"] * 30 + ["wort %s" % ("x" * k) for k in range(6)]
    rows = [(k, t, "de") for k, t in enumerate(texts)] + [(1000 + k, "é" * 5000 + str(k), "fr") for k in range(20)] + [(2000, None, "es")]
    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.sample_training(made, 6, 1 << 20)
    assert sorted(got) == ["de", "fr"] and sorted(got["de"]) == sorted(t.encode() for t in texts[90:]) and len(got["fr"]) == 6
    cut = langid.sample_training(made, 300, 4096)["fr"]
    assert len(cut) == 16 and sum(map(len, cut)) == 4096
    assert sum(map(len, langid.sample_training(made, 300, 100)["fr"])) == 100


# ---- repeats


@pytest.mark.parametrize("seed", [0, 1])
def test_byte_repeats(spark, seed):
    rows = corpus(seed)
    assert collected(suffix_dedup.op3_suffix_dedup(frame(spark, rows))) == sorted(brute.op3(rows), key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_passage_repeats(spark, seed):
    rows = corpus(seed)
    assert collected(lz_dedup.op10_passage_dedup(frame(spark, rows))) == sorted(brute.op10(rows), key=str)


def test_small_flushes_and_many_buckets_change_nothing(spark, rows):
    from helixframe.llm.windows import Rule, covered, repeated_windows

    for rule, matcher in ((Rule(50, 16, False), suffix_dedup.suffix_matcher), (Rule(50, 16, True), lz_dedup.lz_matcher)):
        got = repeated_windows(frame(spark, rows).repartition(7), rule, matcher, flush=10).collect()
        seqs = [(r["doc_id"], brute.words(r["text"]) if rule.by_word else (r["text"] or "").encode()) for r in got]
        for r, (_, s), marks in zip(got, seqs, brute.covered(seqs, 50), strict=True):
            mine = [False] * len(s)
            for a, b in covered(r["spans"], len(s)).tolist():
                mine[a:b] = [True] * (b - a)
            assert mine == marks


def test_kept_text_and_empty_tables(spark, docs, none):
    out = lz_dedup.remove_passages(docs, with_text=True, carry=True)
    for r in out.collect():
        assert hashlib.sha256(" ".join(brute.words(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"] and r["others"]["label"] == "l"
    assert lz_dedup.op10_passage_dedup(none).collect() == [] and suffix_dedup.op3_suffix_dedup(none).collect() == []
    kept = suffix_dedup.remove_repeats(docs, with_text=True).where("n_removed = 0").collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in kept)


def test_suffix_buckets_are_sorted():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1400] = data[200:600]
    data[2000:2300] = 97
    places = np.arange(2900)
    raw = data.tobytes()
    buckets = list(suffix_dedup.sorted_buckets(data, places, 50, bucket=200))
    assert len(buckets) > 5 and sorted(np.concatenate(buckets).tolist()) == places.tolist()
    order = [raw[p : p + 50] for b in buckets for p in b.tolist()]
    assert order == sorted(order)
    assert suffix_dedup.CoverRanks(data, 50).rank.dtype == np.int32


def test_blocks_keep_keys_whole():
    rng = np.random.default_rng(1)
    key, length = rng.integers(0, 40, 300).astype(np.uint64), rng.integers(60, 90, 300)
    key[:50] = 77  # more than a block by itself
    key[50] = 99
    got = list(suffix_dedup.blocks(key, length, 1000))
    assert len(got) > 10 and sorted(np.concatenate(got).tolist()) == [i for i in range(300) if (key == key[i]).sum() > 1]
    where = [{int(k) for k in key[b]} for b in got]
    assert all(not x & y for i, x in enumerate(where) for y in where[:i])
    assert all(length[b].sum() <= 1000 or len(w) == 1 for b, w in zip(got, where, strict=True))
    assert list(suffix_dedup.blocks(np.arange(3, dtype=np.uint64), length[:3], 10)) == []


def test_texts_longer_than_a_segment(spark):
    """Both repeat operators on texts of more than a million bytes, one of more than a million words."""
    from helixframe.llm.windows import SEGMENT

    rng = random.Random(8)
    vocabulary = [*{"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 4))) for _ in range(3000)}]
    passage = " ".join(rng.choice(vocabulary) for _ in range(300))
    long = " ".join(rng.choice(vocabulary) for _ in range(300_000))
    cut = SEGMENT - 400  # the passage crosses the end of the first segment
    rows = [(1, passage), (2, long[:cut] + " " + passage + " " + long[cut:]), (3, long[5000:9000]), (4, passage[::-1])]
    assert len(rows[1][1]) > SEGMENT
    seen, want = set(), []
    for i, t in rows:
        raw, marks = t.encode(), np.zeros(len(t) + 1, np.int64)
        here = {raw[p : p + 50] for p in range(len(raw) - 49)}
        for p in range(len(raw) - 49):
            if raw[p : p + 50] in seen:
                marks[p] += 1
                marks[p + 50] -= 1
        seen |= here
        cover = np.cumsum(marks[:-1]) > 0
        want.append((i, len(raw), int(cover.sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[~cover].tobytes()).hexdigest()))
    assert collected(suffix_dedup.op3_suffix_dedup(frame(spark, rows)), "doc_id", "n_bytes", "n_removed", "kept_sha256") == want
    assert [w[2] for w in want[:1]] == [0] and want[1][2] >= len(passage) and want[2][2] == 4000
    many = " ".join(vocabulary[k % len(vocabulary)] if k % 7 else str(k) for k in range(SEGMENT + 5000))
    w = many.split()
    rows = [(1, passage), (2, many[:50_000]), (3, many.replace(w[SEGMENT - 91] + " ", passage + " ", 1))]
    got = {r["doc_id"]: r for r in lz_dedup.op10_passage_dedup(frame(spark, rows)).collect()}
    assert got[3]["n_words"] == len(rows[2][1].split()) and got[2]["n_removed"] == 0
    first = len(many[:50_000].split()) - 1  # all words of the second document, but for one that is cut
    assert got[3]["n_removed"] in (300 + first, 300 + first + 1)


def test_factors_join_sources():
    words = np.arange(200, dtype=np.uint64)
    first = np.array([0, 80, 160, 260])
    values = np.concatenate([words[:80], words[30:110], words[5:105]])
    ref = lz_dedup.Reference(values, first, np.array([1, 2, 3]), 50)
    assert [(a, n) for a, n, _ in ref.factors(2, 3)] == [(0, 75), (26, 74)]
    assert [(a, n) for a, n, _ in ref.factors(1, 2)] == [(0, 50)] and list(ref.factors(0, 1)) == []
    ref.source[int(ref.base[2])] = 200  # as if another window had the same hash: the words decide
    ref.window[:] = 5
    assert [(a, n) for a, n, _ in ref.factors(2, 3)] == [(0, 75), (26, 74)]


# ---- near duplicates


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_jaccard_classes(spark, seed):
    rows = corpus(seed)
    assert collected(jaccard.op7_jaccard_join(frame(spark, rows))) == sorted(brute.op7(rows), key=str)


def test_jaccard_families_and_hot_keys(spark):
    """Chains of edits whose ends do not link, with every shingle frequent and blocks cut into chunks."""
    rng = random.Random(5)
    rows = []
    for family in range(3):
        text = prose(rng, 60, "abcdefghijklmnop")
        for k in range(25):
            if k % 2:
                text[rng.randrange(len(text))] = f"w{family}x{k}"
            else:
                text = text[:-1] + [f"v{family}x{k}"] if k % 3 else text
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    want = sorted(brute.op7(rows), key=str)
    assert collected(jaccard.near_duplicates(frame(spark, rows), rare=2, block=8)) == want
    assert collected(jaccard.near_duplicates(frame(spark, rows), rare=1 << 30, rounds=1)) == want


def test_no_near_duplicates_in_nothing(none):
    assert jaccard.op7_jaccard_join(none).collect() == []


def test_index_keys_meet():
    """Any two linked sets share a key, whatever is frequent."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[rng.random(len(a)) < rng.choice([1, 0.95, 0.85])]
        b = np.unique(np.concatenate([b, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 10))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            often = {int(t): int(rng.choice([2, 5, 100])) for t in np.union1d(a, b)}
            ka, kb = (jaccard.index_keys(x, np.array([often[int(t)] for t in x]), 75, 16) for x in (a, b))
            assert len(np.intersect1d(ka, kb))


# ---- decontamination


def test_leaks_are_found_and_clean_documents_left(spark, none):
    rng = random.Random(3)
    items = [(k, " ".join(prose(rng, n))) for k, n in enumerate([40, 25, 5, 3, 1, 60])] + [(7, ""), (8, None), (None, "a b c")]
    rows = []
    for k in range(40):
        body = prose(rng, rng.choice([0, 10, 200]), "stuvwxyz")
        item = brute.words(items[k % 6][1])
        if k % 2:
            if k % 4 == 3 and len(item) > 30:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [w.upper() for w in item]
        rows.append((k, " ".join(body)))
    rows += [(None, items[0][1]), (99, None), (98, "")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.op4_decontamination(frame(spark, rows), bench)
    assert sorted(collected(got, "doc_id", "item_id", "similarity")) == brute.op4(rows, items)
    blocks = decontamination.find_leaks(frame(spark, rows), bench, block_bytes=150)
    assert collected(blocks, "doc_id", "item_id") == collected(got, "doc_id", "item_id")
    assert decontamination.op4_decontamination(none, bench).collect() == []
    assert decontamination.op4_decontamination(frame(spark, rows), bench.limit(0)).collect() == []


def test_the_index_returns_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(0)
    items = decontamination.Items(23, 0.75)
    for k in range(50):
        items.add(k, rng.integers(0, 1 << 63, 20 if k % 2 else 30).astype(np.uint64), 5)
    items.index()
    prints = rng.integers(0, 256, (2000, 8)).astype(np.uint8)
    for size in (20, 30):
        mine, block, _ = items.by_gram[5][2][size]
        near = np.repeat(block, 30, axis=0)
        for row in near:
            for bit in rng.choice(64, rng.integers(0, 26), replace=False):
                row[bit // 8] ^= 1 << (bit % 8)
        everything = np.concatenate([prints, near])
        want = {(w, int(i)): int(d) for j, i in enumerate(mine) for w, d in enumerate(items.popcount[everything ^ block[j]].sum(axis=1)) if d <= 23}
        assert {(w, i): d for w, i, d in zip(*(x.tolist() for x in items.candidates(everything, 5, size)), strict=True)} == want and len(want) > 500


def test_no_candidate_without_the_index(spark, monkeypatch):
    """What the block tables do not bring together is not found."""
    items = decontamination.index_items([(1, "one two three four five six seven eight nine ten")])
    shingles = np.array(sorted(items.counts[0]), np.uint64)
    hits = np.arange(len(shingles))
    assert [x[0] for x in items.leaks(shingles, 5, hits)] == [1]
    for gram in items.by_gram.values():
        for size, (ids, block, near) in gram[2].items():
            gram[2][size] = (ids, block, np.zeros_like(near))
    assert list(items.leaks(shingles, 5, hits)) == []


def test_fingerprints_of_long_runs(monkeypatch):
    rng = np.random.default_rng(4)
    shingles = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    monkeypatch.setattr(decontamination, "CHUNK", 16)
    for size in (1, 15, 16, 40, 300):
        got = decontamination.fingerprints(shingles, size)
        votes = np.array([decontamination.bit_votes(shingles[k : k + size]).sum(axis=0) for k in range(len(shingles) - size + 1)])
        assert got.tolist() == np.packbits(votes > 0, axis=1, bitorder="little").tolist()
        lo = len(got) // 3
        assert decontamination.fingerprints(shingles, size, lo, len(got) - lo).tolist() == got[lo : len(got) - lo].tolist()


# ---- chat


def test_roles_are_recovered(spark):
    data = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = chat.op6_chat_format(data)
    assert got.agg(F.avg("role_accuracy")).first()[0] > 0.9


CHAT = "conv_id bigint, turn bigint, role string, text string, key string, segment string, turns string"


def chats():
    rows = [(1, 0, "user", "Hi\nthere?"), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (2, None, None, None), (3, 0, "tool", "<|end|> x <\\|user|>"), (None, 0, "user", "lost"), (5, 1, "user", "")]
    rows += [(4, t, "user" if t % 2 == 0 else "assistant", f"line {t}") for t in range(600)]
    rows += [(6, None, "user", f"no turn {t % 900}") for t in range(1500)] + [(7, 3, "assistant", "same")] * 700 + [(8, t // 300, ["user", "assistant"][t % 2], f"x {t}") for t in range(1000)]
    random.Random(0).shuffle(rows)
    return rows


def test_chat_edge_cases(spark):
    made = spark.createDataFrame([(*r, "k", "s", "t") for r in chats()], CHAT).repartition(5)
    out = chat.op6_chat_format(made).collect()
    sizes = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["conv_id"], r["segment"])):
        sizes[r["conv_id"]].append(r["n_turns"])
    assert sizes == {1: [3], 2: [1], 3: [1], 4: [256, 256, 88], 5: [1], 6: [256] * 5 + [220], 7: [256, 256, 188], 8: [256, 256, 256, 232]}
    assert all(r["rendered"].count("<|end|>") == r["found_turns"] for r in out)
    assert chat.op6_chat_format(spark.createDataFrame([], CHAT)).collect() == []


def test_chat_equals_a_plain_version(spark):
    rows = chats() + [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id > 8").limit(400).collect()]
    made = spark.createDataFrame([(*r, "k", "s", "t") for r in rows], CHAT).repartition(7)
    parts = chat.segments(made)
    model = chat.train(parts)
    keys = {(r["conv_id"], r["segment"]): r["key"] for r in parts.collect()}
    by_conv = defaultdict(list)
    for c, *turn in rows:
        if c is not None:
            by_conv[c].append(turn)
    want = []
    for c, turns in by_conv.items():
        turns.sort(key=lambda x: [(v is not None, v or 0 if k == 0 else v or "") for k, v in enumerate((x[0], x[2], x[1]))])
        for seg in range(-(-len(turns) // 256)):
            part = [(role, text) for _, role, text in turns[256 * seg : 256 * (seg + 1)]]
            lines, truth = chat.write_transcript(keys[c, seg], part)
            states = brute.best_path(chat.observe(lines).tolist(), model)
            found = []
            for line, state in zip(lines, states, strict=True):
                if state % 2 == 0 or not found:
                    m = chat.MARKER.match(line)
                    found.append([chat.ROLES[state // 2], line[m.end() :] if m else line])
                else:
                    found[-1][1] += "\n" + line
            found = [(role, text.strip()) for role, text in found]
            text = chat.render(found)
            assert chat.parse_rendered(text) == found
            right = sum(a // 2 == b // 2 for a, b in zip(states, truth, strict=True)) / len(truth)
            want.append((c, seg, len(part), len(found), round(right, 6), "".join(r[0] for r, _ in found), text, hashlib.sha256(text.encode()).hexdigest()))
    got = chat.parse(parts, model)
    assert collected(got) == sorted(want, key=str) and set(keys) == {w[:2] for w in want}


def test_rendering_can_be_undone():
    rng = random.Random(3)
    for _ in range(500):
        turns = [(rng.choice(chat.ROLES), "".join(rng.choice(["<", "|", ">", "\\", "end", "user", "\n", "a", "<|end|>"]) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 4))]
        text = chat.render(turns)
        assert chat.parse_rendered(text) == turns and text.count("<|") == 2 * len(turns)


def test_viterbi_finds_the_best_path():
    from itertools import product

    samples = [chat.write_transcript(k, [("user", "Why?\nSay."), ("assistant", "Because it is so.\nReally."), ("user", "Oh?")]) for k in range(12)]
    model = chat.RoleModel.fit(samples)
    lines = ["User: Why?", "Because.", "### Bob: Fine"]
    seen = chat.observe(lines)

    def score(path):
        total = model.start[path[0]]
        for i, s in enumerate(path):
            total += sum(t[s, seen[i, k]] for k, t in enumerate(model.emit)) + (model.step[path[i - 1], s] if i else 0)
        return total

    assert score(model.viterbi(lines)) == pytest.approx(max(score(p) for p in product(range(6), repeat=3)))


# ---- language model


def test_counts_and_base_scores(spark, docs, rows, none):
    want = sorted(brute.op8_base(rows), key=str)
    got = collected(lattice.op8_lattice_score(docs, public_path(PIECE)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    few = lattice.lattice_scores(docs.withColumn("train", F.col("doc_id").isNotNull()), public_path(PIECE), "train", hot=3)
    all_hot = lattice.lattice_scores(docs.withColumn("train", F.col("doc_id").isNotNull()), public_path(PIECE), "train")
    assert np.allclose([r[-1] for r in collected(few)], [r[-1] for r in collected(all_hot)])
    assert lattice.op8_lattice_score(none, public_path(PIECE)).collect() == []


def test_scores_equal_a_plain_sum(spark, docs, rows):
    """The whole of ``score``: pieces, words, new words and ends, in sums over all segmentations."""
    def ordered(found):
        return sorted(((i is not None, i or 0, x) for i, x in found))

    want = ordered(brute.op8_score(rows, public_path(PIECE)))
    got = ordered((r["doc_id"], r["score"]) for r in lattice.op8_lattice_score(docs, public_path(PIECE)).collect())
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-9)
    few = [(i, t) for i, t in rows if i is not None and brute.held_out(i, 7)]  # nothing to learn from
    got = ordered((r["doc_id"], r["score"]) for r in lattice.op8_lattice_score(frame(spark, few), public_path(PIECE)).collect())
    assert len(few) > 1 and np.allclose([x[2] for x in got], [x[2] for x in ordered(brute.op8_score(few, public_path(PIECE)))], rtol=1e-9)


def test_marginals_sum_all_segmentations():
    v = lattice.vocabulary_at(public_path(PIECE))
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(len(v.strings))))
    p = {s: math.exp(log_p[i]) for s, i in v.slot_of.items()}
    words = [b"hello", b"the", "été".encode(), b"zzzqx", b"a", b"\xf0\x9f\x98\x80", b"internationalization" * 3]
    got = lattice.marginals(v, log_p, words)
    assert np.allclose(got, [math.log(brute.segmentations(v.space + w, p)) for w in words])


# ---- media


def test_media_column(docs, rows, none):
    got = collected(webp.op9_lossless_webp(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want, key=str)
    same = defaultdict(set)
    for r in webp.media_column(docs.select("doc_id", "text", F.col("text").alias("t")), with_media=True).collect():
        same[r["t"] or ""].add((r["media_sha256"], r["media_bytes"], r["feature"]))
        at, pixels = 0, b""
        while at < len(r["media"]):
            size = 8 + int.from_bytes(r["media"][at + 4 : at + 8], "little")
            pixels += webp.decode(bytes(r["media"][at : at + size])).astype("<u4").tobytes()
            at += size
        assert hashlib.sha256(pixels).hexdigest() == r["payload_sha256"] and hashlib.sha256(r["media"]).hexdigest() == r["media_sha256"]
    assert all(len(x) == 1 for x in same.values())
    assert webp.op9_lossless_webp(none).collect() == []


@pytest.mark.parametrize("transforms", [(), (2,), (0,), (1,), (2, 0, 1), (0, 1, 2)])
def test_images_round_trip(transforms):
    rng = np.random.default_rng(len(transforms))
    px = rng.integers(0, 1 << 32, (13, 21), dtype=np.uint32)
    px[3:7], px[8] = px[2], px[8, 0]
    px[10:] = rng.integers(0, 1 << 32, 5, dtype=np.uint32)[rng.integers(0, 5, (3, 21))]
    for cache in (0, 1, 11):
        for copies in (False, True):
            for groups in (0, 2):
                assert (webp.decode(webp.encode(px, transforms, cache, copies, groups)) == px).all()


@pytest.mark.parametrize("colors", [1, 2, 3, 4, 7, 16, 17, 256])
def test_palettes_round_trip(colors):
    rng = np.random.default_rng(colors)
    px = rng.integers(0, 1 << 32, colors, dtype=np.uint32)[rng.integers(0, colors, (9, 37))]
    for transforms in ((3,), (3, 0)):
        assert (webp.decode(webp.encode(px, transforms, 0, True)) == px).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors_round_trip(mode):
    px = np.random.default_rng(mode).integers(0, 1 << 32, (9, 10), dtype=np.uint32)
    assert (webp.decode(webp.encode(px, (0,), mode=mode)) == px).all()


def test_broken_files_are_refused():
    file = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    for bad in (b"", b"RIFF0000WEBP", file[:-30] + bytes(0), b"JUNK" + file[4:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def test_the_column_chooses_its_streams(spark):
    """Copies, cache and transforms are chosen where they pay, and what was chosen is what is read back."""
    rng = random.Random(6)
    line = " ".join(prose(rng, 30))
    texts = {"prose": " ".join(prose(rng, 30, "abcdefghijklmnopqrstuvwxyz")), "lines": ((line + " " * (-len(line) % 4)) * 60)[:12000], "few": "abcdefgh" * 400, "flat": "z" * 4000, "long": line * 300}
    pay = {k: np.frombuffer((t + "\0" * (-len(t) % 64)).encode()[: 16 << 10], np.uint8) for k, t in texts.items()}
    files = {k: webp.Codec().write(p, np.array([0, len(p)]))[0].tobytes() for k, p in pay.items()}
    kinds = {}
    for k, f in files.items():
        bits = webp.Bits(f[20:], 40)
        kinds[k] = "transform" if bits.read(1) else "cache" if bits.read(1) else "plain"
        assert webp.decode(f).astype("<u4").tobytes() == pay[k].tobytes()
        assert webp.Reader().read(np.frombuffer(f, np.uint8), np.array([0, len(f)]))[0].astype("<u4").tobytes() == pay[k].tobytes()
    assert kinds == {"prose": "plain", "lines": "cache", "few": "transform", "flat": "transform", "long": "cache"}
    assert len(files["lines"]) < len(pay["lines"]) / 6 and len(files["flat"]) < 200
    made = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in webp.op9_lossless_webp(made).collect()}
    assert all(got[k]["payload_sha256"] == hashlib.sha256((t + "\0" * (-len(t) % 64)).encode()).hexdigest() for k, t in enumerate(texts.values()))


def test_random_images_in_lockstep():
    rng = np.random.default_rng(9)
    parts = []
    for k in range(120):
        n = 16 * int(rng.integers(1, 257))
        px = rng.integers(0, 1 << 32, int(rng.choice([1, 3, 40, 3000])), dtype=np.uint32)
        px = px[rng.integers(0, len(px), n)]
        for _ in range(int(rng.integers(0, 5))):
            a, b, m = (int(x) for x in rng.integers(0, n, 3))
            m = min(m, n - max(a, b))
            px[a : a + m] = px[b : b + m].copy()
        parts.append(px)
    data = np.concatenate(parts).astype("<u4").view(np.uint8)
    media, at = webp.Codec().write(data, np.cumsum([0, *(4 * len(p) for p in parts)]))
    for i, (got, want) in enumerate(zip(webp.Reader().read(media, at), parts, strict=True)):
        assert (got == want).all() and (webp.decode(media[at[i] : at[i + 1]].tobytes()).ravel() == want).all()


def test_mixed_streams_in_one_column():
    """Files of other encoders take the general path beside those that advance together."""
    rng = np.random.default_rng(1)
    px = [rng.integers(0, 1 << 32, (k, 16), dtype=np.uint32) for k in (1, 3, 200, 2)]
    codec = webp.Codec()
    files = [codec.write(p.view(np.uint8).ravel(), np.array([0, p.nbytes]))[0].tobytes() for p in px] + [webp.encode(p, (2,), 3, True) for p in px]
    offsets = np.cumsum([0, *map(len, files)])
    got = webp.Reader().read(np.frombuffer(b"".join(files), np.uint8), offsets)
    assert all((g == p.ravel()).all() for g, p in zip(got, px + px, strict=True))
