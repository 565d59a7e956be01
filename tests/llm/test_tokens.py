import random
import struct
import zlib

import pytest

from sievework.llm import encoding, packing, token_files
from sievework.runtime import new_folder

ODD = ["", None, " ", "  ", "a  b", "a \n b", "a\n  b", " a b ", "it's  'quoted' x'y", "é́ ́x", "Straße ΣΑΣ ΑΣ.", "\x1c a\x85 b c　 d", "x" * 5000, "<|endoftext|> a<|endoftext|>", "1234 5 67\t\t89 ", "\r\n\r\n q", "日本 語 テキスト", "🙂 🙂🙂 a🙂"]


def direct(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,keep", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_encode_as_whole_texts(name, keep):
    path = encoding.vocabulary(name)
    rng, whole = random.Random(5), direct(path)
    alphabet = ["a", "B", "é", "1", "'s", " ", "  ", "\n", "\t", ".", "!?", " ", "\x1d", "word", "_", "́", "ſ", "İ"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(1500)]
    got = encoding.ChunkEncoder(path, keep).encode(texts)
    for t, ids in zip(texts, got):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole(t), repr(t)


def rows_of(texts):
    return [(i * 3, t, "x") for i, t in enumerate(texts)] + [(3, texts[1], "y"), (None, "no id", "z")]


def test_token_files_round_trip(spark):
    path = encoding.vocabulary("word_bpe_49k.json")
    rows = rows_of(ODD)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)
    folder = new_folder(spark, "t")
    manifest = token_files.write_token_files(docs, path, folder, seq_len=16)
    got = token_files.read_token_files(manifest, folder).orderBy("start").collect()
    whole, start = direct(path), 0
    want = []
    for key, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text) + [2]
        want.append((key, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [r[0] for r in got] == [w[0] for w in want]
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((w[0] or -1, w[2], w[3]) for w in want)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    part = manifest.orderBy("part").first()
    ids, mask = token_files.sequence(folder, part.file, 0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    empty = token_files.token_digest(spark, docs.limit(0), path)
    assert empty.count() == 0


def test_packing_covers_every_token_once(spark):
    path = encoding.vocabulary("byte_bpe_50k.json")
    rng = random.Random(2)
    rows = rows_of(ODD + [" ".join(rng.choices(["the", "of", "nation"], k=rng.randint(1, 90))) for _ in range(200)])
    docs = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string").repartition(3)
    packed = packing.pack(docs, path, seq_len=64, with_ids=True)
    got = packed.collect()
    whole = direct(path)
    want = sorted((r[0] if r[0] is not None else -1, len(whole(r[1])) + 1) for r in rows)
    total = {}
    for r in got:
        assert 0 < r.length <= 64 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    assert sum(r.length for r in got) == sum(n for _, n in want)
    for r in got:
        total.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in total.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    pieces = [r for r in got if r.doc_id == 36]  # the 5,000 x
    assert [r.length for r in sorted(pieces, key=lambda r: r.piece)][1:] == [64] * (len(pieces) - 1)
    ids = b"".join(r.ids for r in sorted(pieces, key=lambda r: r.piece))
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole(ODD[12]) + [2]
    least = -(-sum(n for _, n in want) // 64)
    assert len(total) <= least * 1.1 + 1
    seqs = packing.sequences(packed).collect()
    assert sum(len(s.ids) for s in seqs) == 4 * sum(n for _, n in want)
    assert packing.pack(docs.limit(0), path).count() == 0


def test_plan_slots_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(50):
        cap = rng.choice([16, 50, 128])
        counts = {rng.randint(1, cap): rng.randint(0, 40) for _ in range(20)}
        slots, fill = packing.plan_slots(counts, cap), {}
        for length, a, b, seq, at in slots:
            for k in range(b - a):
                fill.setdefault(seq + k, []).append((at, length))
        assert {k: sum(b - a for n, a, b, _, _ in slots if n == k) for k in counts} == counts
        bins = []
        for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
            fits = [i for i, left in enumerate(bins) if left >= length]
            if fits:
                bins[min(fits, key=lambda i: bins[i])] -= length
            else:
                bins.append(cap - length)
        assert len(fill) == len(bins)
        for parts in fill.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= cap


def test_cuts_at_lone_line_ends_and_odd_spaces():
    rng = random.Random(5)
    gaps = [" ", " ", " ", "\n", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　"]
    signs = ["a", "b", "Ab", "é", "é", "́", "ß", "İ", "中", "१", "1", "22", "'s", "'t", "'", "§", "¶", ",", ".", "!!", "\U0001f511", "-", "_", "don't", "‍", "﻿", "Σ", "ς"]
    for name, keep_space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        path = encoding.vocabulary(name)
        whole, chunked = direct(path), encoding.ChunkEncoder(path, keep_space)
        texts = ["".join(rng.choices(gaps + signs, k=rng.randint(0, 25))) for _ in range(1500)]
        texts += [" ".join("".join(rng.choices(signs, k=rng.randint(1, 4))) + rng.choice(["", "", "\n" + rng.choice(signs)]) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
        for t, ids in zip(texts, chunked.encode(texts)):
            assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole(t), repr(t)


def test_chunks_that_come_once_are_not_kept():
    """Half of the chunks come once, in every text others; only those that come again stay, and ids are those of whole texts."""
    from sievework.llm.encoding import ChunkEncoder, vocabulary

    enc = ChunkEncoder(vocabulary("byte_bpe_50k.json"), True)
    texts = [" ".join(f"w{k}x{i} again{i % 50}" for i in range(2_000)) for k in range(5)]
    for t in texts:
        assert enc.encode([t])[0] == b"".join(i.to_bytes(4, "little") for i in enc.tokenizer.encode(t, add_special_tokens=False).ids)
    assert 50 <= len(enc.rest) < 1_000


def test_a_word_is_one_chunk_whatever_its_case_and_sign():
    """Before, each case of a word with each sign after it was a chunk of its own, encoded for itself."""
    enc = encoding.ChunkEncoder(encoding.vocabulary("word_bpe_49k.json"), False)
    whole = direct(encoding.vocabulary("word_bpe_49k.json"))
    signs, given = ["", ".", ",", ".$$$", "***", "'s"], []
    encode = enc.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return encode(texts, **kw)

    enc.tokenizer = Counted()
    text = " ".join(case(f"né{a}{b}") + s for a in "abcdefghij" for b in "abcdefghij" for case in (str.lower, str.title, str.upper) for s in signs)
    ids = enc.encode([text])[0]
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole(text)
    assert sum(t.count("né") for t in given) == 100


def test_latin_texts_encode_as_whole_texts():
    """All of Latin-1 in short words, and the same with one wider sign in the text, which is not folded."""
    rng = random.Random(7)
    path = encoding.vocabulary("word_bpe_49k.json")
    whole, enc = direct(path), encoding.ChunkEncoder(path, False)
    chars = [chr(i) for i in range(256)] + list("''' \n    ..,_") + ["'s", "'LL", "'tx"]
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(2_000)]
    texts += [t + rng.choice(["", " "]) + w for t in texts[:500] for w in ("́.", "İ.", "Σ,", "≠")]
    texts += [x + s + y for x in "aÉµª²½×_'" for s in map(chr, range(32, 127)) for y in ("", "b", "'s", "!", "́", "\xa0")]
    for t, ids in zip(texts, enc.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == whole(t), repr(t)


def test_vocabularies_that_tell_case_or_join_signs_are_not_folded(tmp_path):
    import json

    with open(encoding.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        plain = json.load(f)
    cased = plain | {"normalizer": {"type": "NFC"}}
    split = {"type": "Split", "pattern": {"Regex": r"[\p{L}\p{N}]+\.?|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
    joined = plain | {"pre_tokenizer": plain["pre_tokenizer"] | {"pretokenizers": [split, plain["pre_tokenizer"]["pretokenizers"][1]]}}
    added = plain | {"added_tokens": plain["added_tokens"] + [plain["added_tokens"][0] | {"id": 49408, "content": "word.", "special": False}]}
    text = "A Word. a word, É. é Word.. word. WORD and More. more"
    for name, vocabulary in (("cased", cased), ("joined", joined), ("added", added)):
        path = str(tmp_path / f"{name}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(vocabulary, f)
        enc = encoding.ChunkEncoder(path, False)
        ids = enc.encode([text])[0]
        assert not enc.folds and list(struct.unpack(f"<{len(ids) // 4}I", ids)) == direct(path)(text), name
