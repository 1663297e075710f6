"""BPE, packing and id files against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lathe.llm import batches, bpe, idfiles, packing, tokens
from lathe.llm.batches import rebatch, split_words
from tests.llm.conftest import HARD, SF

PATH = tokens.default_vocabulary()
LETTERS = "abcdeTHEthe'sSdD'll0129 .,!-_é́ßÉİΣς 　\x85\x1c\x1e€漢字かなا🙂\n\t½²ⅷﬁ"


def reference(texts):
    library = tokens.load_tokenizer(PATH)
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_words_split_at_ascii_white_space_only():
    rng = random.Random(1)
    texts = ["".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0abé\x00", k=rng.randint(0, 12))) for _ in range(2000)]
    offsets, flat = split_words(pa.array(texts))
    flat = flat.to_pylist()
    for k, text in enumerate(texts):
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        assert flat[offsets[k] : offsets[k + 1]] == [w for w in text.split(" ") if w]


def test_rebatch_keeps_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * (k % 70) for k in range(500)], "k": list(range(500))})
    parts = list(rebatch([batch.slice(0, 200), batch.slice(200, 0), batch.slice(200)], "t", 300))
    assert sum((p.column("k").to_pylist() for p in parts), []) == list(range(500)) and len(parts) > 20


def test_a_worker_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(batches, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"t": ["one two", "two three"]})
    tokens.encode_texts(batch.column("t"), PATH)
    # Tasks that encode keep the units; the first of others doesn't.
    assert len(list(rebatch([batch], "t", holds="units"))) == 1 and tokens._memo.cache_info().currsize == 1
    assert len(list(rebatch([batch], "t"))) == 1 and tokens._memo.cache_info().currsize == 0
    assert tokens.load_tokenizer.cache_info().currsize == 0 and given == [1, 1]
    offsets, ids = tokens.encode_texts(batch.column("t"), PATH)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(["one two", "two three"])


@pytest.mark.parametrize("encode", [lambda a: tokens.encode_texts(a, PATH), lambda a: bpe.load_bpe(PATH).encode_texts(a)])
def test_ids_equal_the_library(encode):
    rng = random.Random(3)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>x<|startoftext|> y", "<|EndOfText|>", "", "ſ K Å"] + [t for _, t in HARD if t]
    offsets, ids = encode(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert got == reference(texts)


def test_round_trip(spark, hard, empty, rows):
    library = tokens.load_tokenizer(PATH)
    got = sorted((r["doc_id"] is not None, r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.round_trip(hard).collect())
    want = []
    for (i, text), ids in zip(HARD, reference([t for _, t in HARD])):
        want.append((i is not None, i, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.round_trip(empty).collect() == []
    found = {r["doc_id"]: r for r in bpe.op8_bpe_prefix(spark, SF).collect()}
    for (i, text), ids in zip(rows, reference([t for _, t in rows])):
        assert found[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        shown = library.decode(ids, skip_special_tokens=False)
        assert found[i]["decoded_sha256"] == hashlib.sha256(shown.encode()).hexdigest()


def _check_pieces(pieces, rows):
    """Each document's ids lie in its pieces once; sequences are gapless; returns the ids of padding."""
    want = defaultdict(list)
    for (i, _), ids in zip(rows, reference([t for _, t in rows])):
        want[i].append(np.array([*ids, 1], "<u4"))
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(p["length"] for p in pieces) == total
    for p in pieces:
        cut = [zlib.crc32(x[p["start"] : p["start"] + p["length"]].tobytes()) for x in want[p["doc_id"]] if len(x) == p["doc_tokens"]]
        assert p["ids_crc32"] in cut and p["length"] > 0
    sequences, padding = defaultdict(list), 0
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        padding += 0 if at & (at - 1) == 0 else packing.CAPACITY - at
    return padding


def test_packing(spark, hard, empty, rows):
    assert _check_pieces(packing.op6_packing(spark, SF).collect(), rows) == 0
    assert _check_pieces(packing.digest(packing.pack(hard)).collect(), HARD) == 0
    assert packing.pack(empty).collect() == []
    pieces = packing.pack(hard, capacity=64, classes=4).collect()
    assert all(p["length"] <= 64 for p in pieces) and len({p["sequence_id"] for p in pieces}) > 100


def test_packing_classes_hold_fixed_counts():
    packer = packing.HarmonicPacker(64, 8)
    for k in range(400):
        packer.add(k, np.arange(1 + (k * 37) % 150, dtype="<u4"))
        assert all(len(v) < kind for kind, v in packer.open.items())
    packer.finish()
    lengths = defaultdict(int)
    for _, _, ids, _, sequence, _ in packer.rows:
        lengths[sequence] += len(ids)
    assert all(n == 64 or n & (n - 1) == 0 for n in lengths.values())


@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**31, 2**32])
def test_blocks(top):
    rng = np.random.default_rng(top)
    ids = rng.integers(0, top, 5000, dtype=np.uint64).astype(np.uint32)
    ids[::97] = top - 1
    blocks = idfiles.encode_blocks(ids)
    assert np.array_equal(np.concatenate([idfiles.decode_block(b) for b in blocks]), ids)
    skewed = np.concatenate([rng.integers(0, 16, 1000), [2**31] * 24]).astype(np.uint32)
    assert len(idfiles.encode_blocks(skewed)[0]) < 1024 and np.array_equal(
        idfiles.decode_block(idfiles.encode_blocks(skewed)[0]), skewed
    )


def test_id_files(spark, hard, empty, rows, tmp_path):
    def brute(rows):
        out, at = [], 0
        texts = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        for (i, _), ids in zip(texts, reference([t for _, t in texts])):
            own = np.array([*ids, 2], "<u4")
            out.append((i, at, len(own), zlib.crc32(own.tobytes())))
            at += len(own)
        return out

    got = [tuple(r) for r in idfiles.op9_id_files(spark, SF).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    folder = f"file://{tmp_path}/ids"
    files = idfiles.write(hard, folder, files=3)
    found = idfiles.read(spark, folder, files).collect()
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in found]
    assert sorted(got, key=lambda r: r[1]) == brute(HARD)
    assert idfiles.read(spark, folder, idfiles.write(empty, f"{folder}-none")).collect() == []
    name = files[0][0]
    with open(f"{tmp_path}/ids/{name}", "rb") as file:
        stream = pa.PythonFile(file, "r")
        reader = idfiles.IdFileReader(stream)
        whole = reader.blocks(0, len(reader.starts) - 1)
        assert len(whole) == reader.ids and np.array_equal(reader.blocks(0, 1), whole[: idfiles.BLOCK])


def test_class_bins_hold_their_count_of_tails():
    """A bin closed by its class has exactly its count of whole tails; what else it holds was cut to fill its gap."""
    rng = np.random.default_rng(3)
    packer = packing.HarmonicPacker(64, 8)
    sizes = rng.integers(1, 150, 3000).tolist()
    for k, n in enumerate(sizes):
        packer.add(k, np.full(n, k, "<u4"))
        assert packer.gap == sum(g for _, g in packer.short) <= 64 + 64
        assert all(len(p) >= 1 and sum(len(x[2]) for x in p) + g == 64 for p, g in packer.short)
    for kind, pieces in packer.open.items():
        assert len(pieces) < kind and all(min(64 // len(x[2]), 8) == kind for x in pieces)
    packer.finish()
    filled = {}
    for doc, start, ids, total, sequence, offset in packer.rows:
        assert total == sizes[doc] and (ids == doc).all() and offset == filled.get(sequence, 0)
        filled[sequence] = offset + len(ids)
    assert sum(filled.values()) == sum(sizes) == packer.placed
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values()) and 0 < packer.gaps < packer.placed / 2
