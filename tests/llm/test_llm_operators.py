"""Each operator against its plain form: random texts, nulls, ties, repeats, empty tables, clashing columns."""

import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from brute import byte_repeats, crc, fold, leaks, near_groups, ppm_bits, whole_leaks, word_repeats
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfwise.llm import (
    chosen_path,
    decontamination,
    exact_dedup,
    id_files,
    language,
    packing,
    pretokens,
    recompression,
    substring_repeats,
    token_counts,
    warc,
)
from shelfwise.llm.components import components
from shelfwise.llm.pretokens import Encoder
from shelfwise.llm.simple8b import decode, encode

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ("key", "mark", "rank", "row", "content", "span", "length", "node", "found", "kept", "salt", "unit")


def frame(spark, rows, columns="doc_id long, text string", clash=True):
    df = spark.createDataFrame(rows, columns)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is not None, v) for v in r])


def mixed(alphabet, n, longest, seed=1):
    """Texts that share parts, with edits, repeated rows, a null id, null and empty text."""
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(n)]
    out = []
    for i in range(3 * n):
        t = r.choice(base)
        if r.random() < 0.3:
            t = t[: r.randint(0, len(t))] + r.choice(base)[r.randint(0, 20) :]
        elif r.random() < 0.4 and t:
            j = r.randrange(len(t))
            t = t[:j] + r.choice(alphabet) + t[j + 1 :]
        out.append((i, t))
    return [*out, out[0], (out[1][0], out[2][1]), (None, out[3][1]), (900, None), (901, ""), (902, " \n\t")]


@pytest.fixture(params=["10000", "5"])
def batches(spark, request):
    """Arrow batches of usual size, and so small that every group spans several."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, "10000")


@pytest.mark.parametrize("alphabet, width", [("ab ", 20), ("a", 9), ("ab é中 \n", 50), ("abcdefg ", 200)])
def test_substring_repeats(spark, batches, alphabet, width):
    docs = mixed(alphabet, 10, 2 * width)
    got = substring_repeats.remove_repeats(frame(spark, docs), width).collect()
    assert sort(got) == sort(byte_repeats(docs, width))


@pytest.mark.parametrize("alphabet, width", [("ab", 13), ("a", 8), ("abcdefgh", 13), ("aé中", 30)])
def test_recompression(spark, batches, alphabet, width):
    docs = [(d, t and " ".join(t)) for d, t in mixed(alphabet, 10, 4 * width)]
    got = recompression.remove_seen(frame(spark, docs), width).collect()
    assert sort(got) == sort(word_repeats(docs, width))


def test_repeats_of_a_long_text(spark):
    body = "".join(random.Random(2).choices("abcd ", k=2_500_000))
    docs = [(1, body), (2, "x" + body[1_000_000:1_000_400] + "y"), (3, "z" * 500)]
    got = {r.doc_id: r for r in substring_repeats.remove_repeats(frame(spark, docs), 200).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[3].n_removed) == (400, 400, 500)
    seen = {r.doc_id: r for r in recompression.remove_seen(frame(spark, docs), 13).collect()}
    assert seen[1].n_removed == 0 and seen[2].n_removed > 50


def test_simple8b():
    r = np.random.default_rng(3)
    for bits in (1, 7, 20, 60):
        for n in (0, 1, 239, 1023, 1024, 1025, 4000):
            ids = r.integers(0, 1 << r.integers(1, 50), n).astype(np.uint64)
            ids[r.random(n) < 0.4] = 0
            words, firsts, places, escaped = encode(ids, bits)
            assert (decode(words, firsts, n, places, escaped) == ids).all()
    assert len(encode(np.zeros(1024, np.uint64))[0]) == 5


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_units_encode_like_the_library(path):
    r = random.Random(4)
    parts = [*"aAbß'sStTd  \n\t\r\x0b\x1c\x85\xa0é12²½.,!?<|>ªºİΣ中😀’", "é", "ά", " ", "'s", " the",
             "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(5000)]
    encoder = Encoder(path)
    want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert encoder.ids(texts) == [np.array(e.ids, "<u4").tobytes() for e in want]


def test_units_in_memory_are_bounded():
    """The store starts anew beyond its bound, and packing asks for less than the other encoders."""
    texts = [f"unit{n} number{n}" for n in range(400)]
    encoder = Encoder(WORD, kept=100)
    got = [encoder.ids([t])[0] for t in texts]
    assert len(encoder.store) < 120 and got == Encoder(WORD).ids(texts)
    assert packing.KEPT_UNITS < pretokens.STORE_UNITS


def test_language_scores_in_small_slices(spark, monkeypatch):
    """A worker scores little text at once; the answers do not depend on it."""
    assert language.SCORED_BYTES <= 1 << 18
    rows = [(n, f"{'der die das' if n % 2 else 'the and of'} {n}", "de" if n % 2 else "en") for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sort(language.predict_languages(df).collect())
    monkeypatch.setattr(language, "SCORED_BYTES", 30)
    assert sort(language.predict_languages(df).collect()) == want


def tokens(path, docs):
    found = Tokenizer.from_file(path).encode_batch([t or "" for _, t in docs], add_special_tokens=False)
    return [(d, e.ids) for (d, _), e in zip(docs, found)]


TEXTS = [(3, "The cat's 12 Dogs!"), (1, None), (2, ""), (7, "the the <|endoftext|> the"), (None, "naïve 中文 é"),
         (3, "The cat's 12 Dogs!"), (5, "word " * 9000), (6, " \n")]


def test_token_counts(spark, monkeypatch):
    want = sort((d, len((t or "").encode()), len(i), len(i) > 2048) for (d, t), (_, i) in zip(TEXTS, tokens(WORD, TEXTS)))
    assert sort(token_counts.token_counts(frame(spark, TEXTS), WORD).collect()) == want
    monkeypatch.setattr(token_counts, "CHUNK_UNITS", 3)
    monkeypatch.setattr(token_counts, "LIST_ENTRIES", 1)
    assert sort(token_counts.token_counts(frame(spark, TEXTS), WORD).collect()) == want


def test_packing(spark):
    rows = packing.pack(frame(spark, TEXTS), WORD).collect()
    want = []
    for d, ids in tokens(WORD, TEXTS):
        ids = [*ids, 1]
        want += [(d, n, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for n, a in enumerate(range(0, len(ids), 4096))]
    assert sort(r[:5] for r in map(tuple, rows)) == sort(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) == -(-sum(r.length for r in rows) // 4096)


def best_count(sizes, capacity):
    """Least number of sequences, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[i]}:
            at = rooms.index(room)
            place(i + 1, rooms[:at] + [room - sizes[i]] + rooms[at + 1 :])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best


def test_reduction_keeps_an_optimum():
    r = random.Random(6)
    for _ in range(300):
        capacity = r.choice([7, 12, 20])
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        counts = {s: sizes.count(s) for s in sizes}
        fixed, rest = packing.reduce_instance(counts, capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        used = [s for times, content in fixed for s, n in content for _ in range(n * times)]
        assert sorted(used + left) == sorted(sizes)
        assert all(sum(s * n for s, n in content) <= capacity for _, content in fixed)
        assert sum(t for t, _ in fixed) + best_count(left, capacity) == best_count(sizes, capacity)
        packed = packing.pack_lengths(counts, capacity)
        assert sorted(s for t, c in packed for s, n in c for _ in range(n * t)) == sorted(sizes)
        assert all(sum(s * n for s, n in c) <= capacity for _, c in packed)


def test_id_files(spark):
    docs = [(d, t) for d, t in TEXTS]
    got = id_files.encode_and_read(frame(spark, docs), BYTE, end_id=0, block_ids=8, escape_bits=9).collect()
    want, start = [], 0
    for d, ids in sorted(tokens(BYTE, docs), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((d, start, len(ids) + 1, crc([*ids, 0])))
        start += len(ids) + 1
    assert sort(got) == sort(want)


PAGES = [(4, "u4", "same"), (9, "u9", "same"), (2, None, "same"), (5, "a b\nc", None), (6, "u6", ""), (None, "n", "same"),
         (7, "u7", "größer " * 40_000), (8, "u8", "größer " * 40_000), (9, "u9", "same")]


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_warc(spark, tmp_path, chunk):
    df = frame(spark, PAGES[:6] if chunk == 7 else PAGES, "page_id long, url string, html string")
    rows = PAGES[:6] if chunk == 7 else PAGES
    path = str(tmp_path / "archive")
    warc.write_archives(df, path, chunk_bytes=chunk)
    got = sort(warc.read_archives(spark, path).drop("url").collect())
    last = {}
    for p, _, h in rows:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        response = p is None or p == last[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((p, len(raw), digest, "response" if response else "revisit", None if response else last[h or ""]))
    assert got == sort(want)
    # The chunks of a record, put together, are one gzip member with one WARC record.
    parts = spark.read.parquet(path).orderBy("row", "chunk_no").collect()
    records = {}
    for r in parts:
        records[r["row"]] = records.get(r["row"], b"") + bytes(r["data"])
    for member in records.values():
        head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(head.rpartition(b"Content-Length: ")[2])


def test_warc_below_the_least_size_all_are_responses(spark, tmp_path):
    warc.write_archives(frame(spark, PAGES, "page_id long, url string, html string"), str(tmp_path / "a"), min_bytes=100)
    got = warc.read_archives(spark, str(tmp_path / "a")).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in got] == [(7, 8)]


def test_warc_finds_a_changed_payload(spark, tmp_path):
    df = warc.chunk_table(frame(spark, PAGES[:2], "page_id long, url string, html string"), 3)
    got = df.orderBy("page_id", "chunk_no").collect()
    assert [(r.chunk_no, bytes(r.data), r.bytes_so_far) for r in got[:2]] == [(0, b"sam", 3), (1, b"e", 4)]
    assert bytes(got[1].digest_so_far) == hashlib.sha1(b"same").digest()


@pytest.mark.parametrize("keep", ["first", "last"])
def test_exact_dedup(spark, keep):
    docs = [(5, "Same"), (3, "same"), (9, "SAME"), (9, "SAME"), (1, None), (2, ""), (None, "same"), (4, "Été"), (6, "été"),
            (None, "alone"), (8, "x" * 300_000), (7, "X" * 300_000)]
    got = exact_dedup.exact_duplicates(frame(spark, docs), keep).collect()
    best = max if keep == "last" else min
    groups = {}
    for d, t in docs:
        groups.setdefault(fold(t), []).append(d)
    assert len(got) == len(docs)
    want = sort(
        (d, best([x for x in groups[fold(t)] if x is not None], default=None), len(groups[fold(t)]),
         hashlib.sha256(fold(t).encode()).hexdigest())
        for d, t in docs
    )
    assert sort((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def near_docs(seed=7):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(1, 90))] for _ in range(20)]
    docs = []
    for i in range(150):
        own = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            own[r.randrange(len(own))] = r.choice(vocabulary)
        docs.append((i, " ".join(own if r.random() < 0.7 else [*own, "Boiler", *base[0][:20]])))
    return [*docs, docs[0], (900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, " \n")]


def test_near_duplicates(spark, monkeypatch):
    docs = near_docs()
    want = sort(near_groups(docs))
    for small, depth in ((256, 4), (4, 1)):
        monkeypatch.setattr(chosen_path, "SMALL_NODE", small)
        monkeypatch.setattr(chosen_path, "DEPTH", depth)
        got = chosen_path.near_duplicates(frame(spark, docs)).collect()
        assert sort(tuple(r)[:3] for r in got) == want
        # One row of each group stays; rows without words are groups of their own.
        assert sort((r.doc_id,) for r in got if r.kept) == sort({(c,) for _, n, c in want if n} | {(900,), (901,), (904,)})


def test_trees_reach_the_recall():
    assert chosen_path.trees_for(0.999999, 0.75) == 7 and chosen_path.trees_for(0.9, 0.75) == 2
    with pytest.raises(ValueError):
        chosen_path.trees_for(0.9, 0.3)


def test_texts_that_are_not_asked_for_are_not_sent(spark):
    docs = spark.range(20_000).selectExpr("id - 5000 AS key", "xxhash64(id) AS mark", "string(id) AS text")
    asked = docs.where("key % 100 = 0").selectExpr("key AS rep", "key", "mark")
    got = {r.key for r in chosen_path._maybe_asked(docs, asked).collect()}
    assert {r.key for r in asked.collect()} <= got and len(got) < 300
    assert chosen_path._maybe_asked(docs, asked.limit(0)).count() == 0
    assert chosen_path._maybe_asked(docs, asked).columns == docs.columns


def test_components(spark):
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {x.vertex: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {v: v for e in edges for v in e}
    for _ in range(50):
        for u, v in edges:
            least[u] = least[v] = min(least[u], least[v])
    assert got == {v: c for v, c in least.items() if v != c}


def test_trees_that_share_coordinates_reach_the_recall():
    """Over the coordinates that all trees share, with the walk of a pair written out."""
    from math import comb

    n, share, trees = chosen_path.COORDINATES, 0.75, chosen_path.trees_sharing(0.999999, 0.75)
    assert chosen_path.BRANCH * trees <= n  # no two trees start alike

    def lost(kept, depth=500):
        return (1 - kept + kept * lost(kept, depth - 1)) ** chosen_path.BRANCH if depth else 0.0

    assert sum(comb(n, k) * share**k * (1 - share) ** (n - k) * lost(k / n) ** trees for k in range(n + 1)) <= 1e-6


def test_decontamination(spark, monkeypatch):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 5, 30, 50])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, items[3][1])]
    docs = []
    for i in range(80):
        own = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        part = (r.choice(items)[1] or "").split() if r.random() < 0.7 else []
        for _ in range(r.choice([0, 0, 1, 2]) if part else 0):
            part[r.randrange(len(part))] = r.choice(vocabulary)
        docs.append((i, " ".join([*own, *part, *own[:5]]).upper()))
    docs += [docs[0], (90, None), (None, docs[1][1])]
    benchmark = frame(spark, items, "item_id long, text string")
    for most in (2_048, 3):
        monkeypatch.setattr(decontamination, "PART_ITEMS", most)
        got = decontamination.contamination(frame(spark, docs), benchmark).collect()
        want = []
        for d, t in docs:
            found = leaks(t, items)
            want.append((d, bool(found), sorted(found), round(max(found.values(), default=0.0), 9)))
        assert sort((r.doc_id, r.contaminated, r.item_ids, round(r.best_similarity, 9)) for r in got) == sort(want)
    none = decontamination.contamination(frame(spark, docs), benchmark.limit(0)).where("contaminated")
    assert none.isEmpty()


def test_decontamination_of_texts_that_are_not_of_an_items_size(spark):
    """Whole copies with words left out or put in, at both ends and inside."""
    r = random.Random(19)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(n))) for i, n in enumerate([50, 36, 37, 20, 6, 3, 1] * 3)]
    items += [(30, "tick tock " * 20), (31, items[0][1]), (32, None), (33, "")]
    texts = [" ".join(items[0][1].split()[:48]), items[1][1].replace(" ", " more ", 1), "a", "tick tock " * 17, ""]
    for _, t in items[:21] * 6:
        part = (t or "").split()
        for _ in range(r.randint(1, 4)):
            at = r.choice([0, len(part), r.randint(0, len(part))])
            part[at : at + 1] = [] if r.random() < 0.6 else [f"w{r.randrange(400)}", *part[at : at + 1]]
        texts.append(" ".join(part))
    docs = list(enumerate(texts))
    got = decontamination.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    want, short = [], 0
    for d, t in docs:
        windows, whole = leaks(t, items), whole_leaks(t, items)
        found = {i: max(windows.get(i, 0), whole.get(i, 0)) for i in windows | whole}
        short += whole.keys() > windows.keys()
        want.append((d, bool(found), sorted(found), round(max(found.values(), default=0.0), 9)))
    assert sort((r.doc_id, r.contaminated, r.item_ids, round(r.best_similarity, 9)) for r in got) == sort(want)
    assert want[0] == (0, True, [0, 31], round(44 / 46, 9)) and short > 5


def test_decontamination_of_repeated_shingles(spark):
    """One word for long, two words in turns: the same shingle many times, and fingerprints far apart."""
    r, items, docs = random.Random(29), [], []
    for i in range(120):
        a, b, *rest = (f"v{r.randrange(10**6)}" for _ in range(9))
        one, other = r.randint(14, 20), r.randint(14, 20)
        items.append((i, " ".join([a] * one + rest + [b] * other)))
        docs += [(i, " ".join(["x", *[a] * (one + k), *rest, *[b] * (other - k), "y"])) for k in (-3, -2, 0, 2, 3)]
    got = decontamination.contamination(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()
    want = [(d, sorted(f), round(max(f.values(), default=0.0), 9)) for d, f in ((d, leaks(t, items[d : d + 1])) for d, t in docs)]
    assert sort((r.doc_id, r.item_ids, round(r.best_similarity, 9)) for r in got) == sort(want)
    assert sum(len(w[1]) for w in want) > 400


def test_language_model_code_lengths(spark):
    sample = {"a": ["The cat sat on the mat", "that hat"], "b": ["le chat est là", "été"]}
    docs = [(i, t, l) for i, (l, t) in enumerate((l, t) for l, ts in sample.items() for t in ts)]
    df = frame(spark, docs, "doc_id long, text string, lang string")
    model = language.fit(df, order=3)
    for text in ("the chat", "été à la mer", "zzz", "T"):
        raw = fold(text).encode()
        got = model.bits(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert np.allclose(got, [ppm_bits(sample[x], text, 3) for x in model.languages], atol=1e-3)


def test_languages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_languages_edges(spark):
    docs = [(1, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"), (5, None, "en"), (6, "", "fr"), (7, "12 !", None),
            (None, "the", None), (1, "the cat and the dog", "en"), (8, "中", None), (9, "le chien " * 100_000, None)]
    df = frame(spark, docs, "doc_id long, text string, lang string")
    got = language.predict_languages(df, held_out=F.lit(False))
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(docs) and by[1].lang_pred == by[None].lang_pred == "en" and by[9].lang_pred == "fr"
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (5, 6, 7)) and by[8].lang_pred in ("en", "fr")
    nothing = language.predict_languages(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct()
    assert [r[0] for r in nothing.collect()] == ["und"]


def test_empty_tables(spark):
    docs = frame(spark, [], "doc_id long, text string, lang string")
    pages = frame(spark, [], "page_id long, url string, html string")
    for df in (
        substring_repeats.remove_repeats(docs), recompression.remove_seen(docs), token_counts.token_counts(docs, WORD),
        packing.pack(docs, WORD), id_files.encode_and_read(docs, BYTE), warc.archive_and_read(pages),
        exact_dedup.exact_duplicates(docs), chosen_path.near_duplicates(docs), language.predict_languages(docs),
        decontamination.contamination(docs, frame(spark, [(1, "a")], "item_id long, text string")),
    ):
        assert df.count() == 0
