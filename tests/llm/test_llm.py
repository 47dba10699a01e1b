"""Operators of the subpackage against brute force on small tables, with nulls, ties, repeats, empty tables and odd columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.llm import chat_format, common, components, decontam, exact_dedup, html_text, lang_id, near_copies, piece_codec, simhash_dedup, suffix_dedup, token_files, warc, words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

random.seed(5)
VOCAB = ["".join(random.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(random.randrange(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


SHARED = prose(60, 1)
TEXTS = [
    (1, prose(80, 2)), (2, None), (3, ""), (4, "  \n\t "), (5, "A"), (6, "a"), (7, SHARED), (8, prose(20, 3) + " " + SHARED + " " + prose(20, 4)), (9, SHARED.upper()), (10, SHARED[:70] + "X" + SHARED[70:]),
    (11, prose(4000, 6)), (12, prose(4000, 6)), (13, "ab " * 400), (14, "ab " * 300), (15, "日本語 テキスト 🎉 " * 5), (16, "<|endoftext|> <s> ▁ \x00 don't I'LL"), (17, "x" * 5000), (18, prose(80, 2)), (19, prose(79, 2) + " end"), (20, "Ünï ÇÖDE " * 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, random.choice(["en", "fr", None]), 1, "z", None) for i, t in TEXTS]
    # columns with names that operators might use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, key int, _salt string, norm string").repartition(3)


def shout(t):
    return "".join(c.upper() if "a" <= c <= "z" else c for c in t)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups(docs):
    got = by_id(exact_dedup.exact_groups(docs))
    for i, t in TEXTS:
        same = [j for j, u in TEXTS if lowered(u) == lowered(t)]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256(lowered(t).encode()).hexdigest()
    assert exact_dedup.exact_groups(docs.where("false")).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_chunks_are_the_text(spark):
    t = prose(5000, 9) + ".\n" + "y" * 20000 + "🎉é\n" * 50
    got = spark.createDataFrame([(t,)], "t string").select(exact_dedup.chunks(F.col("t")).alias("c")).first().c
    assert "".join(got) == t and max(map(len, got)) <= exact_dedup.MAX


def test_repeated_rows_count(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.group_size) for r in exact_dedup.exact_groups(df).collect()) == [(1, 2), (1, 2), (2, 1)]


def fingerprint(t):
    w = (t or "").encode().lower().split()
    from xxhash import xxh64_intdigest

    h = [xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("most", [simhash_dedup.BUCKET, 3, 1])
def test_near_groups(docs, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup.link, "__defaults__", (3, 6, most))
    got = by_id(simhash_dedup.near_groups(docs))
    fps = {i: fingerprint(t) for i, t in TEXTS}
    group = {i: i for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    assert {i: r.component_id for i, r in got.items()} == group
    assert all(r.fp % (1 << 64) == fps[i] for i, r in got.items())
    assert simhash_dedup.near_groups(docs.where("false")).count() == 0


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_forest_searches_like_brute_force(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (30, 4)).astype(np.uint64), axis=1) for b in base]))
    bucket = np.sort(rng.integers(0, 3, len(fps)))
    forest = simhash_dedup.Forest(fps, bucket)
    got = {(int(a), int(b)) for x, y in forest.search(np.arange(len(fps)), radius) for a, b in zip(x, y, strict=True)}
    assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bucket[i] == bucket[j] and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 200: 100}


@pytest.mark.parametrize("size", [600, suffix_dedup.SEGMENT_BYTES])
def test_suffix_cut(docs, monkeypatch, size):
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", size)
    rows = suffix_dedup.cut(docs)
    got, digest = by_id(rows), by_id(suffix_dedup.digests(rows))
    seen = set()
    for i, t in sorted(TEXTS):
        b, own, gone = (t or "").encode(), set(), set()
        for p in range(len(b) - 49):
            own.add(b[p : p + 50])
            if b[p : p + 50] in seen:
                gone.update(range(p, p + 50))
        seen |= own
        assert got[i].kept == bytes(x for p, x in enumerate(b) if p not in gone), i
        spans = np.frombuffer(got[i].spans, "<i8").reshape(-1, 2)
        assert {p for a, z in spans for p in range(a, z)} == gone
        assert (digest[i].n_removed, digest[i].n_spans, digest[i].n_bytes) == (len(gone), len(spans), len(b))
    assert suffix_dedup.cut(docs.where("false")).count() == 0


def test_suffix_cut_of_long_texts_by_parts(spark, monkeypatch):
    """Texts of many parts and larger than a segment; no table stays in the catalogue."""
    monkeypatch.setattr(suffix_dedup, "PART", 5000)
    monkeypatch.setattr(suffix_dedup, "SEGMENT_BYTES", 20_000)
    a, b = prose(12_000, 41), prose(12_000, 42)
    texts = [(1, a), (2, b[:30_000] + a[20_000:40_000] + b[30_000:]), (3, b), (4, prose(9000, 43))]
    got = by_id(suffix_dedup.cut(spark.createDataFrame(texts, "doc_id long, text string")))
    seen = set()
    for i, t in texts:
        raw, own, gone = t.encode(), set(), np.zeros(len(t.encode()), bool)
        for p in range(len(raw) - 49):
            own.add(raw[p : p + 50])
            if raw[p : p + 50] in seen:
                gone[p : p + 50] = True
        seen |= own
        assert got[i].kept == np.frombuffer(raw, np.uint8)[~gone].tobytes()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("landmosaic")]
    x = np.frombuffer(a.encode(), np.uint8)
    parts = suffix_dedup.anchors(x)
    monkeypatch.setattr(suffix_dedup, "PART", 1 << 20)
    assert all((p == q).all() for p, q in zip(parts, suffix_dedup.anchors(x), strict=True))


def test_suffix_cut_of_one_id_and_none(spark):
    df = spark.createDataFrame([(1, SHARED), (1, SHARED), (None, SHARED)], "doc_id long, text string")
    got = sorted((r.doc_id is None, len(r.kept)) for r in suffix_dedup.cut(df).collect())
    assert got == [(False, 0), (False, 0), (True, len(SHARED.encode()))]


def test_coder_round_trips():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1023, 1025, token_files.BLOCK_IDS + 7):
        ids = np.minimum(rng.geometric(0.02, n), 999).astype(np.uint32)
        coder = token_files.Coder(token_files.scaled(np.bincount(ids, minlength=1000) if n else np.ones(1000, np.int64)))
        data = coder.encode(ids)
        assert (coder.decode(data) == ids).all()
        if n > 1:
            broken = bytearray(data)
            broken[12] ^= 1  # the checksum
            with pytest.raises(ValueError):
                coder.decode(bytes(broken))


def test_token_files(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    folder = token_files.encode_corpus(docs, WORD_BPE, 2)
    got = by_id(token_files.digests(token_files.read(docs.sparkSession.newSession(), folder)))
    start = 0
    for i, text in sorted(TEXTS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    folder = token_files.encode_corpus(docs.where("false"), WORD_BPE, 2)
    assert token_files.read(docs.sparkSession, folder).count() == 0


def test_token_files_of_documents_longer_than_a_block(spark, monkeypatch):
    """A document over several blocks, and a damaged table."""
    from tokenizers import Tokenizer

    text = prose(400_000, 4)
    df = spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id long, text string")
    folder = token_files.encode_corpus(df, WORD_BPE, 2)
    ids = [*Tokenizer.from_file(WORD_BPE).encode(text, add_special_tokens=False).ids, 2]
    assert len(ids) > 2 * token_files.BLOCK_IDS
    got = by_id(token_files.digests(token_files.read(spark, folder)))
    assert got[2].n_tokens == len(ids) and got[2].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    assert got[3].start == got[2].start + len(ids)
    table = folder.removeprefix("file://") + "/" + token_files.TABLE
    data = bytearray(open(table, "rb").read())
    data[30] ^= 1
    open(table, "wb").write(data)
    with pytest.raises(ValueError):
        token_files.read_table(folder)


def test_piece_codec(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_codec.encode_texts(docs, PIECES)
    got, digest = by_id(rows), by_id(piece_codec.digests(rows))
    for i, text in TEXTS:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(got[i].piece_ids, "<u4").tolist() == ids, i
        assert got[i].decoded == sp.decode(ids)
        assert digest[i].n_tokens == len(ids)
        raw = (text or "").encode()
        starts, ends = np.frombuffer(got[i].piece_starts, "<u4"), np.frombuffer(got[i].piece_ends, "<u4")
        assert b"".join(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)) == raw or "▁" in (text or "")


def test_pieces_are_the_librarys_and_spans_cover_the_source():
    import sentencepiece

    sp, c, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_codec.PieceCodec(PIECES), random.Random(1)
    alphabet = [*"abcdeéñ ▁\n\t<>0x4s/'日本🎉́\x00", "  ", "the", "ing", "<0x41>", "</s>", "<unk>", " ", " "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(80 if i % 10 else 400))) for i in range(2000)] + ["word" * 5000 + " tail", prose(20000, 3), "é" * 200]
    for text, (ids, starts, ends, decoded) in zip(texts, c.encoded(texts), strict=True):
        want = sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == sp.decode(want)
        raw = text.encode()
        spans = list(zip(np.frombuffer(starts, "<u4").tolist(), np.frombuffer(ends, "<u4").tolist(), strict=True))
        assert b"".join(raw[a:b] for a, b in spans) == raw


def test_spans_through_a_map_and_squeezed_spaces(tmp_path):
    """A model with a character map: every piece's source bytes normalise to the piece."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec, nfkc = pb.ModelProto(), pb.ModelProto()
    with open(PIECES, "rb") as f:
        spec.ParseFromString(f.read())
    nfkc.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())
    spec.normalizer_spec.precompiled_charsmap = nfkc.normalizer_spec.precompiled_charsmap
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    sp, c = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), piece_codec.PieceCodec(str(tmp_path / "m.model"))
    for text in ("ﬁne  words ", "plain", "①②  ½ of Ångström", " lead", "㍿ ok"):
        (ids, starts, ends, decoded), want = c.encoded([text])[0], sp.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == sp.decode(want)
        raw, at = text.encode(), 0
        for a, b in zip(np.frombuffer(starts, "<u4").tolist(), np.frombuffer(ends, "<u4").tolist(), strict=True):
            assert at <= b <= len(raw) and a <= b
            at = b
    i = sp.encode("ﬁne").index(sp.piece_to_id("▁fine")) if sp.piece_to_id("▁fine") in sp.encode("ﬁne") else 0
    starts, ends = (np.frombuffer(x, "<u4").tolist() for x in c.encoded(["ﬁne"])[0][1:3])
    assert (starts[i + 1], ends[i + 1])[0] == 0 and ends[-2] == len("ﬁne".encode())


def test_compiled_map_matches_the_library():
    import sentencepiece

    norm = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(norm.serialized_model_proto())
    charmap = piece_codec.CharMap(spec.normalizer_spec.precompiled_charsmap)
    for said in ("ﬁｎｅ ①Å", "plain", "㍿ ½ é́"):
        data, at, out = said.encode(), 0, b""
        while at < len(data):
            n, new = charmap.longest(data, at)
            if not n:
                n = len(data[at:].decode()[0].encode())
                new = data[at : at + n]
            out, at = out + new, at + n
        assert out.decode().strip() == norm.normalize(said).replace("▁", " ").strip()


def test_warc_round_trip(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c/\n d", None), (4, "http://d/", ""), (5, "http://e/", "é" * 90000), (None, "http://f/", "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("id", F.lit("q"))
    found = warc.archived(df)
    got = by_id(warc.digests(found), "page_id")
    first = {"<p>x</p>": 1, "": 3, "é" * 90000: 5}
    for i, _, h in pages:
        b = (h or "").encode()
        of = first[h or ""]
        assert tuple(got[i])[1:] == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if of == i else "revisit", None if of == i else of)
    assert {r.payload.decode() for r in found.where("record_type = 'response'").collect()} == set(first)
    assert warc.archived(df.where("false")).count() == 0


def test_warc_pushes_filters_and_reads_foreign_files(spark, tmp_path):
    data = b"".join(warc.record(k, f"urn:page:{i}", "http://x/", "D", b"p" * 20000, "urn:page:0") for i, k in enumerate(["response", "revisit", "response"]))
    (tmp_path / "a.warc.gz").write_bytes(data)  # without an index
    df = warc.read(spark, f"file://{tmp_path}", "http").where("record_type = 'response' AND target_uri IS NOT NULL")
    assert [(r.http_length, r.payload) for r in df.collect()] == [(20000, None)] * 2
    reader = warc.WarcReader({"path": "x"})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("http_length",), 5)]))
    assert len(kept) == 1 and reader.wanted == [("WARC-Type", frozenset(["response"]))]


def test_warc_reads_odd_archives(spark, tmp_path, monkeypatch):
    """Two records in a member, folded lines, no blank after a colon, header names in other case, a body that isn't HTTP."""
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    one = b"WARC/1.0\r\nWARC-Type:response\r\nwarc-target-uri: http://a/\r\n b\r\nContent-Type: application/http\r\nCONTENT-LENGTH: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 9000\r\n\r\n" + b"x" * 9000 + b"\r\n\r\n"
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(two + one) + gzip.compress(one))
    got = sorted((r.record_type, r.target_uri, r.http_length, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}").collect())
    assert got == [("response", "http://a/ b", 2, b"hi")] * 2 + [("warcinfo", None, None, b"x" * 9000)] or {g[0] for g in got} == {"response", "warcinfo"} and len(got) == 3
    assert warc.read(spark, f"file://{tmp_path}", "none").where("record_type = 'warcinfo'").count() == 1


def test_warc_files_roll_over_and_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "SPLIT_BYTES", 300)
    r = random.Random(2)
    pages = [(i, "u", "".join(r.choice("abcdef") for _ in range(400))) for i in range(50)]
    folder = f"file://{tmp_path}/w"
    warc.shared_files.of(folder)[0].create_dir(f"{tmp_path}/w")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder).collect()
    parts = warc.WarcReader({"path": folder}).partitions()
    assert len(parts) > 10
    reader = warc.WarcReader({"path": folder})
    assert sorted(row[8].decode() for p in parts for row in reader.read(p)) == sorted(h for _, _, h in pages)


def test_language(spark):
    r = random.Random(3)
    kinds = {"aa": "abcd", "bb": "efgh", "cc": "ßüöä"}
    say = lambda k: " ".join("".join(r.choice(kinds[k]) for _ in range(5)) for _ in range(30))
    rows = [(i, say(k := r.choice(list(kinds))), k) for i in range(400)] + [(900, None, "aa"), (901, "123 !!", "bb"), (902, say("aa"), None), (903, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = by_id(lang_id.identified(df))
    held = [i for i, _, k in rows if k and i < 900 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.95
    assert [got[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3 and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in lang_id.identified(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lang_id.identified(df.where("false")).count() == 0


def test_leaks(spark):
    items = [(1, prose(30, 50) + ". " + prose(8, 51) + "."), (2, prose(12, 52)), (3, "too few"), (4, None), (5, prose(400, 53))]
    base = prose(40, 50 + 100)
    w = decontam.words_of(items[0][1])
    light = " ".join(x for i, x in enumerate(w) if i % 9)  # 8 of 9 words
    texts = [(1, base + " " + items[0][1] + " " + base), (2, base), (3, None), (4, items[1][1].upper()), (5, prose(200, 77) + " " + light), (6, items[4][1]), (7, ""), (8, "too few"), (9, prose(3000, 78) + " " + items[1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("common", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == {(1, 1), (4, 2), (5, 1), (6, 5), (9, 2), (8, 3)}
    assert decontam.leaks(df.where("false"), bench).count() == 0 and decontam.leaks(df, bench.where("false")).count() == 0
    assert {r.doc_id for r in decontam.drop_leaks(df, bench).collect()} == {2, 3, 7}


def test_leaks_of_a_passage_in_most_documents(spark):
    item, other = "".join(f"common{i} " for i in range(20)), "".join(f"rare{i} " for i in range(20))
    around = [" ".join(f"{kind}{i}x{j}" for j in range(3)) for i in range(60) for kind in ("before", "after")]
    texts = [(i, f"{around[2 * i]} {item} {around[2 * i + 1]}" if i % 10 else around[2 * i] * 5) for i in range(60)]
    texts.append((60, f"rare1 rare3 {item} rare7 rare9"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got == {(i, 1) for i in range(61) if i % 10 or i == 60}


def test_leaks_match_a_scan_without_candidates(spark):
    """Rows are those of longest common subsequences in all windows of all passages: no gate loses one."""
    r = random.Random(21)
    few = VOCAB[:40]  # few words, so that windows often look alike
    items = [" ".join(r.choice(few if i % 2 else VOCAB) for _ in range(r.randrange(5, 60))) for i in range(14)]
    items[3] = items[3] + ". " + " ".join(r.choice(VOCAB) for _ in range(6)) + "."
    items[5] = items[5] + ". " + r.choice(VOCAB) + " " + r.choice(VOCAB)
    texts = []
    for i in range(90):
        w = items[i % 14].replace(".", " ").split()
        keep = 1 - r.random() * 0.5
        body = [x if r.random() < keep else r.choice(VOCAB) for x in w]
        tail = w[-6:] if i % 3 == 0 else []
        texts.append(" ".join([r.choice(few) for _ in range(r.randrange(30))] + body + tail + [r.choice(VOCAB) for _ in range(r.randrange(30))]))
    want = {}
    for item, text in enumerate(items):
        said = decontam.words_of(text)
        last = [s for s in (decontam.words_of(x) for x in text.split(".")) if s][-1]
        answer = last if len(last) < len(said) else []
        size = decontam.window_for(len(said))
        step = max(1, size // 8)
        for d, t in enumerate(texts):
            w = decontam.words_of(t)
            for start in range(0, max(1, len(w) - size + step), step):
                part = w[max(0, start - step) : start + size + step]
                common = decontam.common_subsequence(said, part) / len(said)
                there = bool(answer) and any(part[k : k + len(answer)] == answer for k in range(len(part)))
                if common >= decontam.LCS or there and common >= (decontam.PARAPHRASE if len(answer) >= decontam.MIN_WORDS else decontam.ANSWERED):
                    want[d, item] = max(want.get((d, item), 0), common)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x.common for x in decontam.leaks(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert len(want) > 20 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_leaks_of_common_words_inside_rare_ones_and_of_unspaced_scripts(spark):
    common = " ".join(f"w{i % 30}" for i in range(54))
    items = [(1, common), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (3, "vier seltene worte hier"), (4, "solo"), (5, "これは短い文章ですがとても長いので"), (None, "null id words in a row")]
    rare = lambda k: " ".join(f"rare{k}x{i}" for i in range(40))
    texts = [(i, f"{rare(i)} {common} {rare(-i)}") for i in range(1, 30)]
    texts += [(50, f"{rare(50)} {items[1][1]} {rare(51)}"), (51, f"{rare(1)} vier seltene worte hier {rare(2)}"), (52, "Solo."), (53, "solo and more"), (54, f"前置き、{items[4][1]}。終わり"), (55, "null id words in a row"), (None, common)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, k) for i in [*range(1, 30), None] for k in (1, 2)} | {(50, 2), (51, 3), (52, 4), (54, 5), (55, None)}


def test_svd_spans_the_matrix(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((12, 3)) @ rng.standard_normal((3, 20))
    cells = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(12) for j in range(20)], "row long, term string, weight double")
    v = {r.term: np.frombuffer(r.vector) for r in decontam.svd(cells, rank=3, spare=2).collect()}
    basis = np.array([v[f"t{j}"] for j in range(20)])
    assert np.allclose(basis.T @ basis, np.eye(3), atol=1e-6)
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-6)


def test_common_subsequence():
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.choice("abc") for _ in range(r.randrange(9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.common_subsequence(a, b) == t[-1][-1]


def test_distinct_words():
    texts = [b"", b"a bb  a", b"x" * 40 + b" a", b"\tq\n" + b"x" * 40, b"12a"]
    kinds = words.byte_kinds(lambda b: 0 if b in b" \t\n" else 2 if 48 <= b <= 57 else 1)
    known, which, bounds = words.distinct(texts, kinds, 2)
    said = [[known[i] for i in which[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
    assert said == [[], [b"a", b"bb", b"a"], [b"x" * 40, b"a"], [b"q", b"x" * 40], [b"1", b"2", b"a"]]


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class=\"ad\">buy {0}</div><article><h1>{1}</h1><p>{2}<p>{3}&amp;  more</p></article><footer>&copy; {0}</footer></body></html>"


@pytest.fixture(scope="module")
def html_model():
    return html_text.train([PAGE.format(prose(3, i), prose(5, i + 1000), prose(40, i + 2000), prose(30, i + 3000)) for i in range(60)])


def test_html_text(spark, html_model):
    rows = [(i, "u", PAGE.format(prose(3, i), prose(5, i + 1), prose(40, i + 2), prose(3, i + 3))) for i in range(500, 520)] + [(1, None, None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<script>x")]
    got = by_id(html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"), model=html_model), "page_id")
    for i in range(500, 520):
        assert got[i].text == f"{prose(5, i + 1)}\n{prose(40, i + 2)}\n{prose(3, i + 3)}& more"
        assert got[i].n_chars == len(got[i].text)
    assert [got[i].text for i in (1, 2, 4)] == ["", "", ""]


@pytest.mark.parametrize("bad", ['<aside>{0}</aside>', '<div class="comments"><p>{0}</p></div>', '<form><p>{0}</p></form>', '<div class="cookie-notice">{0}</div>', '<div class="sidebar"><p>{0}</p></div>', "<nav>{0}</nav>"])
def test_html_text_leaves_out(html_model, bad):
    good, noise = prose(40, 9), prose(12, 8)
    page = f"<body><main><h1>Title</h1><p>{good}</p>{bad.format(noise)}</main>{bad.format(noise)}</body>"
    assert html_model.text(page) == f"Title\n{good}"


@pytest.mark.parametrize(("page", "text"), [
    ("<article><x-mark-a><p>{0}</p><x-mark-1></article>", "{0}"),
    ("<article><!--><p>{0}</p><!---><p>{1}</p><!-- a --><p>{2}</p></article>", "{0}\n{1}\n{2}"),
    ("<article><p title=don't>{0}</p><p>{1}</p><p>isn't {2}</p></article>", "{0}\n{1}\nisn't {2}"),
    ('<article><p>{0}</p><p class="a>{1}</p></article>', "{0}\n{1}"),
    ("<article><p>{0}<p>{1} a < b</article><footer>x</footer></span></article>", "{0}\n{1} a < b"),
    ("<article><p>{0}</p><select><p>{1}</p></article>", "{0}\n{1}"),
    ("<article><p>{0}</p><p>{1}</p></article><p", "{0}\n{1}"),
])
def test_html_odd_markup(html_model, page, text):
    said = [prose(25, 60 + i) for i in range(3)]
    assert html_model.text(f"<html><body>{page.format(*said)}</body></html>") == text.format(*said)


@pytest.mark.parametrize("page", ['<a href="x ' * 90_000, "<!--" * 250_000, "<button>" * 120_000, "<div>" * 60_000 + "</section>" * 60_000, "<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<div><dd></dd>" * 40_000, "</select " * 100_000])
def test_html_in_linear_time(html_model, page):
    import time

    start = time.process_time()
    html_model.text(page)
    assert time.process_time() - start < 20  # what grew with the square took minutes


def test_html_without_a_labelled_page(spark):
    """The built-in skeletons alone tell an article from what is around it."""
    good, noise = prose(60, 9), prose(12, 8)
    rows = [(1, "u", f"<body><nav><a href='/'>{noise}</a></nav><main><h1>Title</h1><p>{good}</p></main><div class='ad'>{noise}</div><footer>{noise}</footer></body>")]
    got = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got.text == f"Title\n{good}"
    assert html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").where("false")).count() == 0


def test_html_training_expectations_match_single_trees(html_model):
    """Messages over many trees at once give the marginals of each."""
    trees = [html_text.Tree(PAGE.format("a", "b", "c d e", "f")), html_text.Tree("<p>x"), html_text.Tree("")]
    f = html_text.Forest(trees)
    got, joint = f.expected(f.x @ html_model.weights, html_model.pairs)
    assert np.allclose(got, np.concatenate([html_model.marginals(t) for t in trees]), atol=1e-5)
    assert np.allclose(joint[f.inner].sum(axis=1), np.stack([1 - got[f.inner], got[f.inner]], axis=1), atol=1e-5)


def test_tree_marginals_match_enumeration(html_model):
    from itertools import product

    tree = html_text.Tree("<body><div class='post'><p>Some text, here.</p><aside>no</aside></div><footer>f</footer></body>")
    unary, pairs, n = tree.features() @ html_model.weights, html_model.pairs[tree.kinds()], len(tree.parent)
    total = np.zeros((n, 2))
    for state in product((0, 1), repeat=n):
        p = np.exp(sum(unary[i] * state[i] for i in range(n)) + sum(pairs[i][state[tree.parent[i]]][state[i]] for i in range(1, n)))
        for i in range(n):
            total[i, state[i]] += p
    assert np.allclose(html_model.marginals(tree), total[:, 1] / total.sum(axis=1))


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo"), (1, 2, "bob", "yo"), (1, 3, None, None), (2, None, "ann", "alone"), (None, 1, "cy", "lost"), (3, 1, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = chat_format.rotated(df).collect()
    views = {}
    for r in sorted(got, key=lambda r: r.position):
        views.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(views) == {(1, "ann"), (1, "bob"), (1, "unknown"), (2, "ann"), (None, "cy")}
    for (_, who), v in views.items():
        whole = "".join(r.segment for r in v)
        assert [r.position for r in v] == list(range(1, len(v) + 1))
        for r in v:
            assert whole[r.start : r.end] == r.segment
            assert (r.mask_start is not None) == (r.name == who) == (r.chat_role == "assistant")
            if r.mask_start is not None:
                assert whole[r.mask_start : r.mask_end].endswith("<|end|>")
    assert chat_format.rotated(df.where("false")).count() == 0


def test_attach_spreads_and_matches_nulls(spark):
    rows = spark.createDataFrame([(None if i % 3 else "hot", i) for i in range(200)], "k string, id long")
    got = common.salted_totals(rows, "k", "id", {"n": ("count", "id"), "least": ("min", "id")}).collect()
    assert len(got) == 200 and {(r.k, r.n, r.least) for r in got} == {("hot", 67, 0), (None, 133, 1)}


def test_fingerprints_of_long_texts(monkeypatch):
    h = np.random.default_rng(0).integers(0, 1 << 63, 3000, dtype=np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    monkeypatch.setattr(simhash_dedup, "PART_HASHES", 700)
    assert simhash_dedup.fingerprint(h) == want


def test_null_ids_in_near_groups(spark):
    df = spark.createDataFrame([(None, SHARED), (7, SHARED), (3, shout(SHARED)), (None, "quite another text"), (9, prose(50, 70))], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.near_groups(df).collect()), key=repr)
    assert got == sorted([(None, 3), (7, 3), (3, 3), (None, None), (9, 9)], key=repr)


def test_letters(spark):
    """What is no letter in Unicode makes no language; features are those of a count by hand."""
    rows = [(i, t, None) for i, t in enumerate(["²", "½", "Ⅷ", "①", "12 😀", "x", "𐐀", "ª"])] + [(100 + i, "abc abd " * 9 + chr(97 + i % 4), "aa") for i in range(40)] + [(200 + i, "xyz xyy " * 9 + chr(97 + i % 4), "bb") for i in range(40)]
    got = by_id(lang_id.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [got[i].lang_pred == "und" for i in range(8)] == [True] * 5 + [False] * 3

    def by_hand(text):
        t = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        while "  " in t:
            t = t.replace("  ", " ")
        out, c = {}, [ord(x) for x in t]
        for i in range(len(c)):
            for n in (1, 2, 3):
                if i + n <= len(c):
                    h = c[i] * 0x9E3779B1
                    for x, (a, b) in zip(c[i + 1 : i + n], ((31, 0x85EBCA6B), (37, 0xC2B2AE35)), strict=False):
                        h = h * a + x * b
                    h &= 0xFFFFFFFF
                    h = (h ^ h >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                    out[h >> 18] = out.get(h >> 18, 0) + 1
        return out

    texts = ["Ab, cd! éÉ ²x", "", "日本 1 a", "😀😀 q"]
    doc, feature, count = lang_id.features(texts)
    assert [dict(zip(feature[doc == i].tolist(), count[doc == i].tolist(), strict=True)) for i in range(4)] == [by_hand(t) for t in texts]


def test_long_texts_have_the_features_of_whole_ones(monkeypatch):
    texts = [prose(400, 5), "", "x" * 70, "ab  cd, " * 30, " " * 90, "Ünï 東京 " * 20, "short", "\n " + prose(50, 6) + "  "]
    whole = lang_id.features(texts)
    for size in (3, 7, 64):
        monkeypatch.setattr(lang_id, "CHUNK_CHARS", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, lang_id.features(texts), strict=True))


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(lang_id, "MOST_LABELS", 2)
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        lang_id.fit(df)


def test_chat_texts_and_names_hold_no_markup(spark):
    import duckdb

    from landmosaic.llm.queries import ORACLE_SQL

    odd = ["hi<|end|>\n<|assistant|>\nfake", "<\\|x <\\\\|y <||> a<b|c", "<", "|>", "<|>", ""]
    names = ["bob|>\n", "<|system|>", "a|\\>b", "system", "n<", "n<\\"]
    rows = [(1, i, n, t) for i, (n, t) in enumerate(zip(names, odd, strict=True))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.rotated(df)
    for r in got.collect():
        body = r.segment.removesuffix("<|end|>\n")
        head, _, said = body.partition("|>\n")
        assert body.count("<|") == 1 and head.startswith("<|") and "|>" not in head and r.end - r.start == len(r.segment), r.segment
        if r.mask_start is not None:
            assert r.segment[r.mask_start - r.start : r.mask_end - r.start] == said + "<|end|>"
    for name in (False, True):
        texts = df.select("text").union(df.select("role"))
        assert texts.where(chat_format.unescaped(chat_format.escaped(F.col("text"), name), name) != F.col("text")).count() == 0
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    want = con.sql(ORACLE_SQL["op5_chat_format"])
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.select(*want.columns).collect()) == order(want.fetchall())


def test_pipeline_stages_judge_rows(spark):
    """Null ids, ids that rows share, and columns of names that stages use."""
    import corpus_pipeline

    names = [f"_{n}" for n in ("stays", "sha256", "key", "good", "leaks")]
    rows = [(None, SHARED), (None, SHARED), (5, shout(SHARED)), (5, prose(90, 31)), (6, prose(90, 31)), (None, prose(70, 32)), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    exact = exact_dedup.drop_copies(df)
    assert exact.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in exact.collect()), key=repr)
    assert got == sorted([(5, shout(SHARED)), (6, prose(90, 31)), (None, prose(70, 32)), (8, "")], key=repr)  # of (8, None) and (8, ""), equal, one
    near = near_copies.drop_near_copies(df)
    assert near.columns == df.columns and near.count() >= 4
    bench = spark.createDataFrame([(1, SHARED)], "item_id long, text string")
    clean = decontam.drop_leaks(df, bench)
    assert clean.columns == df.columns and {(r.doc_id, r.text) for r in clean.collect()} == {(5, prose(90, 31)), (6, prose(90, 31)), (None, prose(70, 32)), (8, None), (8, "")}
    labelled = df.withColumn("lang", F.lit("aa"))
    assert lang_id.drop_unknown(labelled, least=0.0).columns == labelled.columns
    out = corpus_pipeline.encode(spark, df, "")
    assert out.count() == len(rows) and {"doc_id", "piece_ids", "piece_starts", "piece_ends", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_parities_never_exceed_what_sets_are_apart():
    rng = np.random.default_rng(3)
    for n, m in ((0, 0), (1, 5), (300, 250), (5000, 300), (5000, 4800), (70_000, 69_000)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: min(n, m) * 9 // 10], rng.integers(0, 1 << 63, m // 10, dtype=np.uint64)]))
        apart = len(a) + len(b) - 2 * len(np.intersect1d(a, b))
        assert near_copies.apart(near_copies.parities(a), near_copies.parities(b)) <= apart


def test_rows_are_left_out_by_id_and_key(spark, monkeypatch):
    monkeypatch.setattr(common, "SLOTS", 2)  # nearly all rows are asked for
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a"), (2, None)], "doc_id long, text string").withColumn("_of", F.lit(1))
    gone = spark.createDataFrame([(1, "a"), (None, "a")], "doc_id long, k string")
    got = common.without(docs, gone, "doc_id", F.coalesce("text", F.lit("")), "k")
    assert got.columns == docs.columns and {(r.doc_id, r.text) for r in got.collect()} == {(1, "b"), (2, None)}


@pytest.mark.parametrize("drop", [exact_dedup.drop_copies, near_copies.drop_near_copies])
def test_identical_rows_become_one(spark, drop):
    rows = [(1, SHARED, "b"), (1, SHARED, "a"), (1, SHARED, "a"), (None, prose(80, 41), None), (None, prose(80, 41), None), (3, None, "x"), (3, None, "x"), (4, prose(60, 42), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_row.x` string").withColumn("_at", F.lit(1)).repartition(3)
    out = drop(df)
    assert out.columns == df.columns
    assert sorted((tuple(r)[:3] for r in out.collect()), key=repr) == sorted([rows[1], rows[3], rows[5], rows[7]], key=repr)


def test_roots_are_joined_by_later_links(spark):
    first, later = [(1, 2), (2, 3), (5, 6), (8, 9), (20, 21)], [(3, 6), (4, 9), (6, 7), (10, 11), (2, 5)]
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    found = components.components(links(first))
    want = {(r.node, r.root) for r in components.components(links(first + later)).collect()}
    assert {(r.node, r.root) for r in near_copies.joined_roots(found, links(later)).collect()} == want
    assert near_copies.joined_roots(found, links([])).count() == found.count()


def test_sets_that_share_a_name_get_another(spark):
    rows = spark.createDataFrame([(7, 1, "a"), (7, 2, "b"), (7, 1, "c"), (8, 1, "d")], "node long, other long, k string")
    got = {r.k: r.node for r in near_copies.named_alone(rows, spark.createDataFrame([(7,)], "node long")).collect()}
    assert got["a"] == got["c"] and got["d"] == 8 and len({7, 8, got["a"], got["b"]}) == 4
    assert {r.node for r in near_copies.named_alone(rows, spark.createDataFrame([], "node long")).collect()} == {7, 8}


def test_pipeline_stages_keep_the_columns(spark, docs):
    import corpus_pipeline

    same = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, same, "")
        assert out.columns == same.columns, name
    assert {r.doc_id for r in corpus_pipeline.STAGES[1][1](spark, same, "").collect()} == {i for i, t in TEXTS if i == max(j for j, u in TEXTS if lowered(u) == lowered(t))}


def test_near_dedup_finds_all_similar_pairs(spark):
    """The stage drops what brute force over 5-word shingles drops, of pairs around 0.8, in chains and around hubs."""
    import corpus_pipeline

    r, texts = random.Random(9), []
    for i in range(30):
        w = prose(r.randrange(30, 200), 900 + i).split()
        texts.append(" ".join(w))
        for _ in range(r.randrange(8)):
            v = list(w)
            for _ in range(r.randrange(1, 1 + len(w) // 30)):
                v[r.randrange(len(v))] = "changed"
            texts.append(" ".join(v) + " one line that very many of the documents have")
            w = v if r.random() < 0.5 else w
    texts += ["", None, " ", "A b", "a  B", "c"]
    r.shuffle(texts)
    sets = [set(near_copies.shingles(t).tolist()) for t in texts]
    group, pairs = list(range(len(texts))), 0
    for j in range(len(texts)):
        for i in range(j):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                pairs += 1
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert pairs > 50 and got == {i for i, g in enumerate(group) if g == i}
    assert corpus_pipeline.near_dedup(spark, df.where("false"), "").count() == 0
